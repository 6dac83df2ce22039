"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII bytes that belong to no word become a space, A-Z become a-z, all other bytes stay.
_WORD_TABLE = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32
    for c in range(256)
)


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that very long texts can't fill a Python worker.

    Spark reads these session settings when a result is computed, so they have to stay; smaller ones are left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 500), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        now = int(re.match(r"-?\d+", spark.conf.get(key))[0])
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; it is deleted when the session's JVM ends.

    Where the setting is missing, a run in one process takes a temporary folder of its machine, and a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.match(r"local(\[[^-]*\])?$", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = f"{(base or tempfile.gettempdir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def stored(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written as Parquet to a shared folder and read again: lineage ends there and survives lost executors."""
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_column(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn labels from: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sampled_texts(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The whole texts of the ids in ``ids``, which are broadcast; of rows that share an id, the text of the smallest hash."""
    found = docs.select(id_col, text_column().alias("text")).join(F.broadcast(ids), id_col)
    return found.groupBy(*ids.columns).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id") -> list[tuple[str, int]]:
    """At most ``per_class`` labelled (whole text, label) rows of each class that aren't held out, for the driver.

    The rows with the smallest hash of doc_id are taken, so the sample doesn't follow order or place. ``per_class``
    bounds the ids that are broadcast and the rows that are collected.
    """
    known = (
        labels.select(F.col(id_col), F.col(label).cast("int").alias("y"))
        .where(F.col("y").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(id_col)
        .agg(F.max("y").alias("y"))
    )
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = sampled_texts(docs, picked, id_col).collect()
    return [(r["text"], int(r["y"])) for r in sorted(rows, key=lambda r: (r[id_col], r["text"]))]


def packed(docs: DataFrame) -> DataFrame:
    """_row: all columns of a row in one, so that no name of theirs clashes with what an operator adds; ``_row.*`` unpacks them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def annotated(df: DataFrame, text_col: str, start: Callable[[], Callable[[list[str]], list[pa.Array]]], fields: dict[str, str]) -> DataFrame:
    """All columns of ``df`` and one for each of ``fields`` (name: Spark type), worked out from the texts of an Arrow batch.

    ``start`` runs once in each task and returns the function from texts, null ones as empty, to arrays. Nothing is
    shuffled, and no column needs a join to come back. A field that ``df`` has already is replaced.
    """
    from pyspark.sql.types import DataType, StructType

    prepare(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in fields]
    schema = StructType(list(kept))
    for name, kind in fields.items():
        schema = schema.add(name, DataType.fromDDL(kind))
    n, names = len(kept), schema.names
    source = df.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text_of_row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *work(batch.column(n).to_pylist())], names=names)

    return source.mapInArrow(run, schema)


def normal_words(text: str | None) -> bytes:
    """UTF-8 words with A-Z lower-cased, joined by one space: a word is a run of letters, digits or non-ASCII."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_WORD_TABLE).split())


_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))


class SpanHasher:
    """64-bit hashes of many byte ranges of one buffer in a few numpy passes.

    S[i] is the sum of byte j times MULT^j over j < i, modulo 2^64; MULT is odd, so a range's hash
    (S[end] - S[start]) * MULT^-start doesn't depend on where the range lies. A final mix spreads the bits.
    """

    def __init__(self) -> None:
        self._pow = self._inv = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._pow) < n:
            n = 1 << max(16, math.ceil(math.log2(n)))
            self._pow = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, _MULT))])
            self._inv = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(n, _INV))])

    def spans(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(data, np.uint8)
        self._grow(len(raw) + 1)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self._pow[: len(raw)], out=total[1:])
        return mixed((total[ends] - total[starts]) * self._inv[starts] + (ends - starts).astype(np.uint64))

    def shingles(self, words: bytes, size: int) -> np.ndarray:
        """Distinct hashes of the ``size``-word shingles of normalised words; a shorter text is one shingle, an empty one has none."""
        if not words:
            return np.empty(0, np.uint64)
        gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
        starts = np.concatenate([[0], gaps + 1])
        ends = np.concatenate([gaps, [len(words)]])
        if len(starts) < size:
            return self.spans(words, starts[:1], ends[-1:])
        return np.unique(self.spans(words, starts[: len(starts) - size + 1], ends[size - 1 :]))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Directions are centred, and rotations learned by iterative quantisation turn each into a binary code of ``m`` substrings of at
most 16 bits. A block of the index keeps, for each substring, lists of rows by the substring's value. A query probes all
values within ``reach`` bits of its own in every substring. By the pigeonhole principle that retrieves every code within the
Hamming radius m * (reach + 1) - 1: were all substrings of a code farther, so would be the whole. What is retrieved is
reranked by the cosine of the original vectors. How many substrings and which reach are needed is measured on the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepare, shared_folder, stored

#: Bits of a substring at most, and substrings of a code at most.
BITS, SUBSTRINGS = 16, 128


@dataclass
class Codes:
    """Rotations (dimension x bits of all substrings), and the bits by which probed values may differ."""

    mean: np.ndarray
    rotations: np.ndarray
    bits: int
    reach: int

    @property
    def substrings(self) -> int:
        return self.rotations.shape[1] // self.bits

    @property
    def radius(self) -> int:
        """Hamming radius within which every code is retrieved."""
        return self.substrings * (self.reach + 1) - 1

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """A row of substring values per vector."""
        return values((directions(vectors) - self.mean) @ self.rotations > 0, self.bits)


def values(signs: np.ndarray, bits: int) -> np.ndarray:
    return (signs.reshape(len(signs), -1, bits) @ (1 << np.arange(bits))).astype(np.uint16)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near 1: exact, and products can't overflow."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def directions(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def ball(bits: int, reach: int) -> np.ndarray:
    """The masks of at most ``reach`` of ``bits`` bits."""
    x = np.arange(1 << bits, dtype=np.uint32)
    return x[np.bitwise_count(x) <= reach].astype(np.uint16)


def fit(sample: np.ndarray, k: int, recall: float = 0.96, rounds: int = 8, probes: int = 256, seed: int = 7) -> Codes:
    """Learn rotations on the sample; then, of the pairs of reach and number of substrings that retrieve ``recall`` of the ``k``
    nearest of ``probes`` sample vectors, take the one that retrieves the smallest share of other vectors. In a sample neighbours
    are farther than among all rows, so that the choice errs to the safe side."""
    x = directions(sample)
    mean = x.mean(axis=0)
    centred, rng, n = x - mean, np.random.default_rng(seed), x.shape[1]
    bits = min(BITS, n)
    parts = []
    for _ in range(math.ceil(SUBSTRINGS / (n // bits))):
        r = np.linalg.qr(rng.standard_normal((n, n)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(centred.T @ np.where(centred @ r > 0, 1.0, -1.0))
            r = u @ v
        parts.append(r[:, : n // bits * bits])
    rotations = np.hstack(parts)[:, : SUBSTRINGS * bits]
    own = values(centred @ rotations > 0, bits)
    near, other = [], []
    for i in rng.permutation(len(x))[:probes]:
        score = x @ x[i]
        score[i] = -np.inf
        apart = lambda j, i=i: np.bitwise_count(own[j] ^ own[i])
        near.append(apart(np.argsort(-score)[: min(k, len(x) - 1)]))
        other.append(apart(rng.integers(0, len(x), 64)))
    near, other = np.concatenate(near), np.concatenate(other)
    best = (math.inf, SUBSTRINGS, bits)
    for reach in range(bits + 1):
        found = np.logical_or.accumulate(near <= reach, axis=1).mean(axis=0) if len(near) else np.ones(own.shape[1])
        fine = np.flatnonzero(found >= recall)
        if len(fine):
            m = int(fine[0]) + 1
            best = min(best, (float((other[:, :m] <= reach).any(axis=1).mean()) if len(other) else 1.0, m, reach))
    _, m, reach = best
    return Codes(mean, rotations[:, : m * bits], bits, reach)


class Block:
    """The index of a block of rows: per substring, the rows in order of its value, and where each value's rows begin."""

    def __init__(self, vectors: np.ndarray, codes: np.ndarray, bits: int, reach: int) -> None:
        self.vectors, self.bits, self.reach = scaled(vectors), bits, reach
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        n, m = codes.shape
        self.order = np.concatenate([np.argsort(codes[:, s], kind="stable") for s in range(m)]).astype(np.int32)
        self.first = np.zeros((m, (1 << bits) + 1), np.int32)
        for s in range(m):
            np.cumsum(np.bincount(codes[:, s], minlength=1 << bits), out=self.first[s, 1:])
        self.base = np.arange(m, dtype=np.int32)[:, None] * n
        self.masks = {reach: ball(bits, reach)}
        #: Index entries read so far.
        self.read = 0

    def probed(self, code: np.ndarray, reach: int) -> np.ndarray:
        """Rows that hold, in some substring, a value within ``reach`` bits of the query's."""
        if reach not in self.masks:
            self.masks[reach] = ball(self.bits, reach)
        wanted = (code[:, None] ^ self.masks[reach]).astype(np.int64)
        at = np.arange(len(code))[:, None]
        begin, end = self.first[at, wanted], self.first[at, wanted + 1]
        held = end > begin
        starts, lengths = (begin + self.base)[held], (end - begin)[held]
        entries = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum()) if len(lengths) else np.zeros(0, np.int64)
        self.read += len(entries)
        seen = np.zeros(len(self.vectors), bool)
        seen[self.order[entries]] = True
        return np.flatnonzero(seen)

    def candidates(self, code: np.ndarray, least: int) -> np.ndarray:
        """The rows probed at the learned reach; where they are fewer than ``least``, at the next one that has so many."""
        for reach in range(self.reach, self.bits + 1):
            rows = self.probed(code, reach)
            if len(rows) >= min(least, len(self.vectors)):
                break
        return rows

    def cosines(self, rows: np.ndarray, vector: np.ndarray) -> np.ndarray:
        v = scaled(vector[None, :])[0]
        return (self.vectors[rows] @ v) / (self.norms[rows] * math.sqrt(v @ v))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v array<double>: without null ids and without vectors that are null, empty, zero or not finite throughout."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def _array(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return pa.concat_arrays(column.chunks).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.zeros((0, width))


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def search(
    df: DataFrame,
    query_every: int,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    sample: int = 4096,
    block_rows: int = 16384,
    query_rows: int = 8192,
    recall: float = 0.96,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest cosine found for each row whose id ``query_every`` divides.

    Equal vectors share one index entry, addressed by 128 bits of hash, that keeps their k + 1 smallest ids, which is all a top
    k can need; a hot vector thus costs no more than another. Each length of vectors is searched by itself, with a fit of its
    own: a cosine is defined within a length only, and an id that has several vectors is a row for each and is answered for
    each. Index blocks of about ``block_rows`` entries meet query blocks of about ``query_rows`` in even cells; each cell
    builds its block's lists, probes them for every query and keeps k + 1 entries a query; a rank limit merges the cells.
    The fit alone uses a sample, of the ``sample`` entries of a length with the smallest hash; every row is indexed. Vectors
    that are null, empty, zero or hold null or non-finite components, and null ids take no part; rows repeated with equal id
    and vector count once; ties go to the smaller id; fewer than k candidates are all returned, other columns aren't read,
    and an empty table gives no rows.
    """
    spark = df.sparkSession
    prepare(spark)
    folder = shared_folder(spark, "ann")
    schema = "query_id long, rank int, vec_id long, score double"
    hashed = usable(df, id_col, vector_col).withColumns({"e": F.xxhash64("v"), "f": F.xxhash64(F.lit(1), "v")})
    rows = stored(hashed.groupBy("e", "f", "vec_id").agg(F.first("v").alias("v")), f"{folder}/rows")
    asks = F.col("vec_id") % query_every == 0
    first = F.row_number().over(Window.partitionBy("e", "f").orderBy("vec_id"))
    kept = rows.withColumn("rn", first).where(F.col("rn") <= k + 1).groupBy("e", "f").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    queries = rows.where(asks).select("e", "f", F.col("vec_id").alias("query_id"))
    asked = queries.select("e", "f").distinct().withColumn("asked", F.lit(True))
    entries = stored(kept.join(asked, ["e", "f"], "left").select(F.size("v").alias("width"), "e", "f", "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), f"{folder}/entries")

    counts = {r["width"]: (r["n"], r["n_asked"]) for r in entries.groupBy("width").agg(F.count("*").alias("n"), F.count(F.when(F.col("asked"), 1)).alias("n_asked")).collect() if r["n_asked"]}
    codes = {}
    for width in sorted(counts):
        own = entries.where(F.col("width") == width)
        chosen = own.select("e", "f").orderBy("e", "f").limit(sample)
        picked = sorted(own.select("e", "f", "v").join(F.broadcast(chosen), ["e", "f"]).collect(), key=lambda r: (r["e"], r["f"]))
        codes[width] = fit(np.array([r["v"] for r in picked]), k, recall)
    if not codes:
        return spark.createDataFrame([], schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = b.column(0).to_numpy()
            for width in np.unique(widths):
                part = b.take(pa.array(np.flatnonzero(widths == width)))
                own = codes[int(width)].of(_array(pa.chunked_array([part.column(3)]), int(width)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in own], pa.binary())], names=["width", "e", "f", "v", "asked", "code"])

    plan = spark.createDataFrame([(w, math.ceil(n / block_rows), math.ceil(a / query_rows)) for w, (n, a) in counts.items()], "width int, blocks int, sets int")
    searched = entries.select("width", "e", "f", "v", "asked").join(F.broadcast(plan.select("width")), "width", "left_semi")
    index = stored(searched.mapInArrow(encode, "width int, e long, f long, v array<double>, asked boolean, code binary"), f"{folder}/index").join(F.broadcast(plan), "width")
    place = lambda parts, by: F.pmod(F.col(by), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    left = index.select("width", "e", "f", "v", "code", place("blocks", "e").alias("i"), every("sets").alias("j"))
    right = index.where("asked").select(*[F.col(c).alias(c) for c in ("width", "e", "f", "v", "code")], every("blocks").alias("i"), place("sets", "f").alias("j"))
    probing = {w: (c.bits, c.reach) for w, c in codes.items()}

    def cell(own: pa.Table, asking: pa.Table) -> pa.Table:
        out: dict[str, list] = {"width": [], "qe": [], "qf": [], "e": [], "f": [], "score": []}
        if own.num_rows and asking.num_rows:
            width = own["width"][0].as_py()
            block = Block(_array(own["v"], width), _codes(own["code"]), *probing[width])
            e, f = own["e"].to_numpy(), own["f"].to_numpy()
            for qe, qf, v, code in zip(asking["e"].to_pylist(), asking["f"].to_pylist(), _array(asking["v"], width), _codes(asking["code"])):
                got = block.candidates(code, k + 1)
                score = block.cosines(got, v)
                if len(got) > k + 1:
                    top = np.flatnonzero(score >= np.partition(score, -k - 1)[-k - 1])
                    got, score = got[top], score[top]
                best = np.lexsort((e[got], -score))[: k + 1]
                for name, column in zip(out, ([width] * len(best), [qe] * len(best), [qf] * len(best), e[got[best]].tolist(), f[got[best]].tolist(), score[best].tolist())):
                    out[name] += column
        return pa.table(out, schema=pa.schema([("width", pa.int32()), ("qe", pa.int64()), ("qf", pa.int64()), ("e", pa.int64()), ("f", pa.int64()), ("score", pa.float64())]))

    found = left.groupBy("width", "i", "j").cogroup(right.groupBy("width", "i", "j")).applyInArrow(cell, "width int, qe long, qf long, e long, f long, score double")
    best = F.row_number().over(Window.partitionBy("qe", "qf").orderBy(F.desc("score"), "e"))
    top = (
        found.withColumn("rn", best).where(F.col("rn") <= k + 1)
        .join(entries.select("e", "f", "ids"), ["e", "f"])
        .groupBy(F.col("qe").alias("e"), F.col("qf").alias("f"))
        .agg(F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("far"), i.alias("vec_id")))))).alias("near"))
    )
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return (
        queries.join(top, ["e", "f"])
        .select("query_id", F.posexplode(own).alias("place", "x"))
        .select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
    )

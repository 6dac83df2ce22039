"""Token ids in binary shards: one zstandard dictionary for all documents, one frame per document, an offset index.

A shard file holds, in this order: the magic ``LFTOK001``; the 32 bytes of the dictionary's SHA-256; a zstandard frame
per document (its ids as little-endian unsigned 32-bit integers); the index, 32 bytes per document (doc_id as int64, the
frame's offset as uint64, its length as uint32, the number of ids as uint64, flags as uint32: 1 for a null doc_id); and a
footer of 24 bytes (offset of the index as uint64, number of documents as uint64, the magic again). Any one document is
read with two short reads. The folder also has ``dictionary.bin`` and ``manifest.json``, which names the shards in order with
the first and the last doc_id of each.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import CutEncoder
from .common import prepare, sampled_texts, text_column

MAGIC = b"LFTOK001"
_ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u4"), ("n_ids", "<u8"), ("flags", "<u4")])
_INDEX, _FOOTER = struct.Struct("<qQIQI"), struct.Struct("<QQ8s")
_encoders: dict[tuple[str, bool], CutEncoder] = {}


def _encoder(path: str, special: bool = False) -> CutEncoder:
    """Of a tokenizer file. ``special``: strings of its special tokens in a text become those tokens, as the library has it
    unless told otherwise; without, they are ordinary text, so that no text can forge the end of a document."""
    if (path, special) not in _encoders:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            split = (json.load(f).get("pre_tokenizer") or {}) if path.endswith(".json") else {}
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not special
        _encoders[path, special] = CutEncoder(tokenizer, split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space"))
    return _encoders[path, special]


def _files(folder: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _put(folder: str, name: str, data: bytes) -> None:
    files, path = _files(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{name}") as f:
        f.write(data)


class _Writer:
    """One shard file while it is written: what is kept of a document is its packed index entry."""

    def __init__(self, folder: str, name: str, digest: bytes) -> None:
        files, path = _files(folder)
        self.name, self.out, self.index, self.at = name, files.open_output_stream(f"{path}/{name}"), bytearray(), len(MAGIC) + len(digest)
        self.docs = self.tokens = 0
        self.first = self.last = None
        self.out.write(MAGIC + digest)

    def add(self, doc_id: int | None, frame: bytes, n: int) -> None:
        self.out.write(frame)
        self.index += _INDEX.pack(doc_id or 0, self.at, len(frame), n, int(doc_id is None))
        self.at, self.docs, self.tokens = self.at + len(frame), self.docs + 1, self.tokens + n
        if doc_id is not None:
            self.first, self.last = doc_id if self.first is None else self.first, doc_id

    def close(self) -> None:
        self.out.write(bytes(self.index) + _FOOTER.pack(self.at, self.docs, MAGIC))
        self.out.close()


def train_dictionary(docs: DataFrame, tokenizer_path: str, size: int, sample_docs: int) -> bytes:
    """A dictionary trained on the serialised ids of ``sample_docs`` whole documents, those with the smallest hash of doc_id.

    Too few or too short samples give a raw dictionary of their bytes, and no samples an empty one.
    """
    import zstandard

    ids = (
        docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
        .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample_docs)
    )
    samples = [x for x in _encoder(tokenizer_path).encode(sorted(r["text"] for r in sampled_texts(docs, ids).collect())) if x]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int | None = None,
    shards: int | None = None,
    dictionary_size: int = 64 << 10,
    sample_docs: int = 300,
    level: int = 3,
    shard_bytes: int = 256 << 20,
    special: bool = False,
) -> dict:
    """Encode every whole text and write the ids to shards in ascending doc_id order; returns the manifest.

    Null texts are empty; ``end_id`` is appended to each document. Strings of special tokens in a text are ordinary text, unless
    ``special`` is set. Null doc_ids come first; rows of equal doc_id follow
    one another by a hash of their text, and other columns aren't read. One range shuffle on doc_id moves the texts; a task
    streams its rows and begins a new shard after ``shard_bytes``, so memory holds one Arrow batch and the index of such a shard,
    however many rows a task has. A shard is written under a name of its own attempt and is named in
    the manifest only by the attempt that succeeded, so a lost executor leaves no half-written shard in use. An empty
    table gives a manifest without shards. The driver gets one row per shard.
    """
    spark = docs.sparkSession
    prepare(spark)
    dictionary = train_dictionary(docs, tokenizer_path, dictionary_size, sample_docs)
    _put(folder, "dictionary.bin", dictionary)
    digest = hashlib.sha256(dictionary).digest()
    shards = shards or max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        encoder = _encoder(tokenizer_path, special)
        pack = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        end = b"" if end_id is None else struct.pack("<I", end_id)
        task, out = TaskContext.get().partitionId(), None
        attempt, listed = uuid.uuid4().hex[:12], []

        def finish() -> None:
            out.close()
            listed.append({"part": task, "place": len(listed), "file": out.name, "docs": out.docs, "tokens": out.tokens, "first": out.first, "last": out.last})

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                if out is None:
                    out = _Writer(folder, f"shard-{task:06d}-{len(listed):04d}-{attempt}.bin", digest)
                out.add(doc_id, pack.compress(ids + end), (len(ids) + len(end)) // 4)
                if out.at >= shard_bytes:
                    finish()
                    out = None
        if out is not None:
            finish()
        if listed:
            yield pa.RecordBatch.from_pylist(listed, schema=pa.schema([("part", pa.int32()), ("place", pa.int32()), ("file", pa.string()), *((n, pa.int64()) for n in ("docs", "tokens", "first", "last"))]))

    rows = (
        docs.select("doc_id", text_column().alias("text"))
        .withColumn("_tie", F.xxhash64("text"))
        .repartitionByRange(shards, "doc_id", "_tie")
        .sortWithinPartitions("doc_id", "_tie")
        .select(F.col("doc_id").cast("long"), "text")
        .mapInArrow(write, "part int, place int, file string, docs long, tokens long, first long, last long")
        .collect()
    )
    listed, start = [], 0
    for r in sorted(rows, key=lambda r: (r["part"], r["place"])):
        listed.append({**{k: r[k] for k in ("file", "docs", "tokens", "first", "last")}, "start": start})
        start += r["tokens"]
    manifest = {"dictionary_sha256": digest.hex(), "end_id": end_id, "tokens": start, "shards": listed}
    _put(folder, "manifest.json", json.dumps(manifest).encode())
    return manifest


class Shard:
    """One shard file: the index, and any document by its place. To be closed after use."""

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def __init__(self, folder: str, name: str, dictionary: bytes) -> None:
        import zstandard

        files, path = _files(folder)
        self.file = files.open_input_file(f"{path}/{name}")
        size = self.file.size()
        self.file.seek(size - _FOOTER.size)
        at, n, magic = _FOOTER.unpack(self.file.read(_FOOTER.size))
        self.file.seek(0)
        if magic != MAGIC or self.file.read(8) != MAGIC:
            raise ValueError(f"{name} isn't a token shard")
        if self.file.read(32) != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} was written with another dictionary")
        self.file.seek(at)
        self.index = np.frombuffer(self.file.read(n * _ENTRY.itemsize), _ENTRY)
        self._unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, place: int) -> bytes:
        e = self.index[place]
        self.file.seek(int(e["offset"]))
        return self._unpack.decompress(self.file.read(int(e["length"])), max_output_size=max(1, 4 * int(e["n_ids"])))


def read_dictionary(folder: str) -> bytes:
    files, path = _files(folder)
    with files.open_input_stream(f"{path}/dictionary.bin") as f:
        return f.read()


def read_manifest(folder: str) -> dict:
    files, path = _files(folder)
    with files.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())


def read_tokens(spark: SparkSession, folder: str, rows_per_batch: int = 500) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, payload (ids as little-endian uint32), a task per shard."""
    prepare(spark)
    manifest = read_manifest(folder)
    schema = "doc_id long, start long, n_tokens long, payload binary"
    if not manifest["shards"]:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = read_dictionary(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with Shard(folder, name, dictionary) as shard:
                    before = start + np.concatenate([[0], np.cumsum(shard.index["n_ids"].astype(np.int64))])
                    for i in range(0, len(shard.index), rows_per_batch):
                        part = shard.index[i : i + rows_per_batch]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(part["doc_id"].astype(np.int64), mask=part["flags"] == 1),
                                pa.array(before[i : i + len(part)].astype(np.int64)),
                                pa.array(part["n_ids"].astype(np.int64)),
                                pa.array([shard.ids(i + k) for k in range(len(part))], pa.binary()),
                            ],
                            names=["doc_id", "start", "n_tokens", "payload"],
                        )

    shards = manifest["shards"]
    listed = spark.createDataFrame([(s["file"], s["start"]) for s in shards], "file string, start long")
    return listed.repartition(min(len(shards), 10_000)).mapInArrow(read, schema)


def read_document(folder: str, doc_id: int) -> np.ndarray | None:
    """The ids of one document by the index alone, without Spark; None if no shard has it. Of rows that share the id, the first.

    Only shards whose range of ids holds ``doc_id`` are opened, and the index is searched as the sorted list that it is.
    """
    dictionary = read_dictionary(folder)
    for s in read_manifest(folder)["shards"]:
        if s["first"] is None or not s["first"] <= doc_id <= s["last"]:
            continue
        with Shard(folder, s["file"], dictionary) as shard:
            nulls = int((shard.index["flags"] == 1).sum())
            at = nulls + int(np.searchsorted(shard.index["doc_id"][nulls:], doc_id))
            if at < len(shard.index) and shard.index[at]["doc_id"] == doc_id:
                return np.frombuffer(shard.ids(at), "<u4")
    return None

"""N-gram Jaccard self-join by a MinHash LSH forest, with exact verification.

Each distinct text gets a label per tree of the forest: a sequence of ``LABEL`` MinHash values of its word shingles. The labels of
a tree, sorted, are its prefix trie; a walk over them finds the longest prefix that each text shares with another. Matching starts with full
labels. What they link is compared exactly; the similarities found tell what share of all links prefixes of that length
reach, and prefixes are shortened until that share is the target recall. The floor is the length at which texts that are only
just similar enough are met with the target recall. What is joined by candidate links is gathered in cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, mixed, normal_words, packed, prepare, shared_folder, shuffle_parts, stored, text_column
from .components import components

#: Words of a shingle, and the Jaccard similarity from which two texts are linked.
SHINGLE, THRESHOLD = 5, 0.8
#: Trees of the forest, values of a full label, and the recall that is to be reached.
TREES, LABEL, RECALL = 40, 10, 0.9999
#: Bits in which a label keeps each value beyond the floor.
LEVEL_BITS = 12
#: Shingles of a block of candidates: a cell compares at most two blocks.
BLOCK_SHINGLES = 64_000
#: Bins of similarity in which verified links are counted.
BINS = 100


def recall_at(depth: int, similarity: float = THRESHOLD, trees: int = TREES) -> float:
    """The chance that two texts match on a prefix of ``depth`` in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(recall: float = RECALL, similarity: float = THRESHOLD, trees: int = TREES, label: int = LABEL) -> int:
    """The floor: the longest prefix that reaches the recall for texts of just this similarity; at least 1."""
    depth = label
    while depth > 1 and recall_at(depth, similarity, trees) < recall:
        depth -= 1
    return depth


def shortened(found: np.ndarray, depth: int, floor: int, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix, not longer than ``depth``, that reaches the recall by the links that ``depth`` found.

    ``found`` counts verified links by similarity, in ``BINS`` bins from 0 to 1. A link of similarity s stands for
    1 / recall_at(depth, s) links; one more, at the threshold, stands for those that no count shows.
    """
    at = np.maximum(threshold, np.arange(len(found)) / BINS)
    total = found / recall_at(depth, at, trees)
    while depth > floor:
        lost = (total * (1 - recall_at(depth, at, trees))).sum() + 1 - recall_at(depth, threshold, trees)
        if lost <= (1 - recall) * max(1.0, total.sum()):
            break
        depth -= 1
    return depth


class Forest:
    """Labels of shingle sets, one per tree."""

    def __init__(self, trees: int, floor: int, label: int, seed: int = 11) -> None:
        self.trees, self.floor, self.label = trees, floor, label
        rng = np.random.default_rng(seed)
        n = trees * label
        self.a = (rng.integers(0, 1 << 32, n, np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)[:, None]

    def labels(self, shingles: np.ndarray) -> np.ndarray:
        """Two 64-bit numbers per tree: a hash of tree and values up to the floor, and the values beyond it, first ones on top."""
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = None
        for i in range(0, len(x), 1024):
            part = (self.a * x[i : i + 1024] + self.b).min(axis=1)
            low = part if low is None else np.minimum(low, part)
        least = low.reshape(self.trees, self.label).astype(np.uint64)
        key = mixed(np.arange(1, self.trees + 1, dtype=np.uint64))
        for level in range(self.floor):
            key = mixed(key ^ least[:, level])
        rest = np.zeros(self.trees, np.uint64)
        for level in range(self.floor, self.label):
            rest = rest << np.uint64(LEVEL_BITS) | mixed(least[:, level]) >> np.uint64(64 - LEVEL_BITS)
        return np.stack([key, rest], axis=1).view(np.int64)


class TrieWalk:
    """A walk over the sorted labels of a part, for the length of the longest prefix that each shares with a neighbour, which is the
    longest that it shares with any. The first and the last label of a part count as matched throughout, as their other
    neighbour lies in another part."""

    def __init__(self, floor: int, label: int) -> None:
        self.floor, self.label = floor, label
        self.held: tuple[np.ndarray, ...] | None = None
        self.common = label

    def matched(self, key: np.ndarray, rest: np.ndarray, node: np.ndarray, last: bool = False) -> tuple[np.ndarray, ...]:
        """key, rest, node and length for the labels that match up to the floor at least; the last label given so far waits for its
        next neighbour, or the end."""
        if self.held is not None:
            key, rest, node = (np.concatenate([h, x]) for h, x in zip(self.held, (key, rest, node)))
        n = len(key)
        if not n:
            return key, rest, node, key
        other, levels = (rest[1:] ^ rest[:-1]).astype(np.uint64), self.label - self.floor
        common = np.full(n - 1, self.floor)
        for level in range(1, levels + 1):
            common += (other >> np.uint64(LEVEL_BITS * (levels - level))) == 0
        common = np.where(key[1:] == key[:-1], common, 0)
        length = np.maximum(np.concatenate([[self.common], common]), np.concatenate([common, [self.label]]))
        done = n if last else n - 1
        self.held, self.common = (key[n - 1 :], rest[n - 1 :], node[n - 1 :]), int(common[-1]) if n > 1 else self.common
        fine = np.flatnonzero(length[:done] >= self.floor)
        return key[fine], rest[fine], node[fine], length[fine]


_shared: dict[tuple, tuple[SpanHasher, Forest]] = {}


def _tools(trees: int, floor: int, label: int) -> tuple[SpanHasher, Forest]:
    key = (trees, floor, label)
    if key not in _shared:
        _shared[key] = SpanHasher(), Forest(*key)
    return _shared[key]


def node_of(words: bytes) -> int:
    """The signed 64-bit address of normalised words: equal words are one class."""
    x = xxhash.xxh3_64_intdigest(words, seed=5)
    return x - (1 << 64) if x >> 63 else x


def signatures(docs: DataFrame, size: int, trees: int, floor: int, label: int) -> DataFrame:
    """doc_id, th, node, n_shingles, labels (key and rest of each tree in turn) of each row; node is null for a text without words."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, th long, node long, n_shingles int, labels array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, forest = _tools(trees, floor, label)
        for batch in batches:
            seen: dict[int, tuple[int, np.ndarray]] = {}
            nodes, sizes, keys, ends = [], [], [], [0]
            for text in batch.column(2).to_pylist():
                words = normal_words(text)
                node = node_of(words) if words else None
                if words and node not in seen:
                    s = hasher.shingles(words, size)
                    seen[node] = len(s), forest.labels(s).ravel()
                n, own = seen[node] if words else (0, np.empty(0, np.int64))
                nodes.append(node)
                sizes.append(n)
                keys.append(own)
                ends.append(ends[-1] + len(own))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), lists], names=["doc_id", "th", "node", "n_shingles", "labels"])

    return docs.mapInArrow(run, schema)


def verified(sets: list[np.ndarray], group: np.ndarray, half: np.ndarray, across: bool, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each set, the places of the sets of its group whose Jaccard similarity reaches the threshold, and the similarities.
    ``across``: only pairs with one set of either half. Exact: common members are counted by way of the members' lists of sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    members, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(ids, kind="stable")
    lists = owner[order]
    first = np.concatenate([[0], np.cumsum(counts)])
    start = np.concatenate([[0], np.cumsum(sizes)])
    shared = counts[ids] > 1
    for i in range(len(sets)):
        own = ids[start[i] : start[i + 1]][shared[start[i] : start[i + 1]]]
        if not len(own):
            continue
        lengths = counts[own]
        at = np.repeat(first[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        common = np.bincount(lists[at], minlength=len(sets))
        near = (common > 0) & (group == group[i])
        near[i] = False
        if across:
            near &= half != half[i]
        j = np.flatnonzero(near)
        both = common[j]
        union = sizes[i] + sizes[j] - both
        fine = both >= threshold * union - 1e-9
        if fine.any():
            yield i, j[fine], both[fine] / union[fine]


def join(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, label: int = LABEL) -> DataFrame:
    """doc_id, class_id, n_links for each row of ``docs`` (doc_id, text).

    n_links counts the other rows whose set of ``size``-word shingles has a Jaccard similarity of at least
    ``threshold``; class_id is the smallest doc_id among the rows that such links connect. A text of fewer words is one
    shingle; texts without words, null ones among them, have no shingles: they link to nothing and are classes of their
    own. Repeated rows and copies are classes' members like any others. Other columns aren't read; an empty table gives an
    empty one; where all doc_ids of a class are null, so is its class_id.

    Copies are one class before anything is compared, by a 64-bit address of their words, and shingles are compared by 64-bit
    hashes: different words count as equal with a chance of n² / 2^65 among n texts, or shingles of two texts. Labels are
    range-partitioned, so that however many texts share a prefix, no task walks over more than its part. Candidates form a star
    around the smallest text of a prefix, never all pairs; what the links connect is split into blocks of
    about ``BLOCK_SHINGLES`` shingles, and each pair of blocks is a cell of its own; small components share cells, of which there
    are as many as their shingles need. Links leave a cell as counts and as the smallest linked class, a row per class. The time
    of a group of n different near copies still grows with n², by the comparisons that counting its links takes.
    """
    signed, full = _linked(docs, size, threshold, trees, recall, label)
    named = full.join(full.groupBy("component").agg(F.min("least_id").alias("class_id")), "component").select("node", "class_id", "n_links")
    return signed.select("doc_id", "node").join(named, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def matched_prefixes(classes: DataFrame, floor: int, label: int) -> DataFrame:
    """key, rest, node, depth: the labels of ``classes`` (node, labels) that share a prefix of at least ``floor`` values with another
    one of their tree, and the length of the longest such prefix."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("labels") - 1, F.lit(2)), lambda i: F.struct(F.get("labels", i).alias("key"), F.get("labels", i + 1).alias("rest")))
    forest = classes.where(F.size("labels") > 0).select("node", F.inline(pairs)).select("key", "rest", "node")
    names = ["key", "rest", "node", "depth"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, none = TrieWalk(floor, label), np.zeros(0, np.int64)
        for batch in batches:
            found = trie.matched(*(batch.column(i).to_numpy() for i in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=names)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in trie.matched(none, none, none, last=True)], names=names)

    parts = shuffle_parts(classes.sparkSession)
    return forest.repartitionByRange(parts, "key", "rest", "node").sortWithinPartitions("key", "rest", "node").mapInArrow(walk, "key long, rest long, node long, depth long")


def prefix_links(matched: DataFrame, depth: int, label: int) -> DataFrame:
    """u, v: each node with the smallest one that shares a prefix of ``depth`` values with it in some tree, never all pairs."""
    near = matched.where(F.col("depth") >= depth).select("key", F.shiftrightunsigned("rest", LEVEL_BITS * (label - depth)).alias("rest"), "node")
    stars = near.groupBy("key", "rest").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v < last").drop("last")
    return near.join(stars, ["key", "rest"]).where("node != v").select(F.col("node").alias("u"), "v").distinct()


def _linked(docs: DataFrame, size: int, threshold: float, trees: int, recall: float, label: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows; and node, least_id, kept (place of the row that stands for the node), component, n_links of each node."""
    spark = docs.sparkSession
    prepare(spark)
    folder = shared_folder(spark, "ngramjoin")
    floor = depth_for(recall, threshold, trees, label)
    label = min(label, floor + 63 // LEVEL_BITS)
    rows = docs.select("doc_id", F.xxhash64(text_column()).alias("th"), text_column().alias("text"))
    signed = stored(signatures(rows, size, trees, floor, label), f"{folder}/signed")
    classes = stored(
        signed.where("node IS NOT NULL").groupBy("node").agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.min(F.struct("th", "doc_id")).alias("at"), F.min(_place()).alias("kept"), F.first("n_shingles").alias("n_shingles"), F.first("labels").alias("labels")
        ),
        f"{folder}/classes",
    )
    matched = stored(matched_prefixes(classes, floor, label), f"{folder}/matched")
    known = classes.select("node", "copies", "at", "n_shingles")

    depth = label
    while True:
        here = f"{folder}/{depth}"
        near = stored(_verified(rows, known, components(prefix_links(matched, depth, label), f"{here}/candidates"), size, threshold, (trees, floor, label)), f"{here}/near")
        found = np.zeros(BINS + 1)
        for r in near.select(F.posexplode("found").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect():
            found[r["bin"]] = r["n"] / 2
        shorter = shortened(found, depth, floor, threshold, trees, recall)
        if shorter == depth:
            break
        depth = shorter

    joined = components(near.where("node IS NOT NULL").select(F.col("node").alias("u"), F.col("hub").alias("v")), f"{folder}/joined")
    counted = near.where("node IS NOT NULL").groupBy("node").agg(F.sum("links").alias("links"))
    full = (
        classes.select("node", "copies", "least_id", "kept")
        .join(joined, "node", "left").join(counted, "node", "left")
        .select("node", "least_id", "kept", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return signed, full


def _verified(rows: DataFrame, known: DataFrame, candidates: DataFrame, size: int, threshold: float, forest: tuple[int, int, int]) -> DataFrame:
    """node, hub, links: for each node with links, the smallest node that its cell connects it with and the rows it links to
    there; and a row per cell without a node, found: the cell's links by bin of similarity, each link twice."""
    grouped = candidates.join(known, "node")
    blocks = grouped.groupBy("component").agg(F.sum("n_shingles").alias("size")).withColumn("blocks", F.ceil(F.col("size") / BLOCK_SHINGLES).cast("int"))
    small = blocks.where("blocks = 1").agg(F.sum("size")).first()[0] or 0
    cells = max(shuffle_parts(rows.sparkSession), int(4 * small // BLOCK_SHINGLES))
    split = F.col("blocks") > 1
    own = F.when(split, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(0).cast("int")
    placed = (
        grouped.join(blocks, "component")
        .withColumn("block", own)
        .select("node", "component", "copies", F.col("at.th").alias("th"), F.col("at.doc_id").alias("id"), "block", "blocks")
    )
    texts = rows.select("th", F.col("doc_id").alias("id"), "text")
    with_text = placed.join(texts, (placed["th"] == texts["th"]) & placed["id"].eqNullSafe(texts["id"])).select("node", "component", "copies", "block", "blocks", "text")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    in_cells = with_text.withColumn("other", other).select(
        F.when(split, F.xxhash64("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(cells))).alias("cell"),
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "component", "copies", "block", "text",
    )
    schema = pa.schema([("node", pa.int64()), ("hub", pa.int64()), ("links", pa.int64()), ("found", pa.list_(pa.int64()))])

    def compare(cell: pa.Table) -> pa.Table:
        at: dict[int, int] = {}
        for i, node in enumerate(cell["node"].to_pylist()):
            at.setdefault(node, i)
        cell = cell.take(pa.array(list(at.values()), pa.int64()))
        hasher, _ = _tools(*forest)
        sets = [hasher.shingles(normal_words(t), size) for t in cell["text"].to_pylist()]
        copies = cell["copies"].to_numpy()
        nodes = cell["node"].to_numpy()
        root = np.arange(len(sets))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        linked, found = np.zeros(len(sets), np.int64), np.zeros(BINS + 1, np.int64)
        for i, near, similar in verified(sets, cell["component"].to_numpy(), cell["block"].to_numpy(), cell["i"][0].as_py() != cell["j"][0].as_py(), threshold):
            linked[i] = copies[near].sum()
            found += np.bincount((similar * BINS + 1e-9).astype(np.int64), minlength=BINS + 1)
            for j in near[near > i]:
                a, b = top(i), top(int(j))
                root[max(a, b)] = min(a, b)
        have = np.flatnonzero(linked)
        if not len(have):
            return schema.empty_table()
        tops = nodes[[top(int(i)) for i in have]]
        return pa.table([pa.array([*nodes[have], None], pa.int64()), pa.array([*tops, None], pa.int64()), pa.array([*linked[have], None], pa.int64()), pa.array([None] * len(have) + [found.tolist()], pa.list_(pa.int64()))], schema=schema)

    return in_cells.groupBy("cell", "i", "j").applyInArrow(compare, "node long, hub long, links long, found array<long>")


def _place(th: Column | str = "th") -> Column:
    """The order in which rows of a class are preferred: doc_id, nulls last, then the hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", (F.col(th) if isinstance(th, str) else th).alias("th"))


def deduplicated(docs: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, label: int = LABEL) -> DataFrame:
    """The rows of ``docs`` of which each class of :func:`join` keeps exactly one. Columns stay.

    The row of the smallest doc_id stays, null ids last; then that of the smallest hash of the text. Classes are told apart by
    their texts, so different texts under one doc_id, or under none, each keep a row. Rows of equal doc_id and text are one
    document, of which the smallest hash of the row stays; so are those of a text without words. Columns may have any name; an empty table
    gives an empty one; very long texts are one more set of shingles.
    """
    signed, full = _linked(docs, size, threshold, trees, recall, label)
    kept = full.groupBy("component").agg(F.min("kept").alias("_place")).select("_place").union(signed.where("node IS NULL").select(_place().alias("_place")).distinct())
    own = packed(docs).withColumn("_place", F.struct(F.col("_row.doc_id").isNull().alias("none"), F.col("_row.doc_id").alias("doc_id"), F.xxhash64(text_column("_row.text")).alias("th")))
    hashed = F.xxhash64(*[F.col(f"_row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    rows = own.join(kept, "_place", "left_semi")
    return rows.groupBy("_place").agg(F.min_by("_row", F.struct(F.col("_row.text").isNull(), hashed)).alias("_row")).select("_row.*")

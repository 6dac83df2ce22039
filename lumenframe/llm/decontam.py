"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive benchmark words, or a whole shorter item. Patterns of one length share a shift
table: it tells, for the block of two words at the end of the current position, how far the search may jump because no
pattern has that block nearer to its end. Where the shift is 0, the block selects a bucket of patterns, the first words
narrow it, and a direct comparison of all words confirms an occurrence.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import annotated, normal_words, packed, shared_folder, stored, text_column

#: Words of a window.
WINDOW = 13
#: A document is contaminated if it has a hit and at least one word in so many is hit.
ONE_IN = 20


class WuManber:
    """Occurrences of word windows in word lists; ``patterns`` maps a window (tuple of words) to its items."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list]) -> None:
        self.by_length: list[tuple[int, int, dict, dict]] = []
        lengths = defaultdict(dict)
        for words, items in patterns.items():
            lengths[len(words)][words] = items
        for m, own in sorted(lengths.items()):
            block = min(2, m)
            shift: dict[tuple, int] = {}
            bucket: dict[tuple, dict] = defaultdict(lambda: defaultdict(list))
            for words, items in own.items():
                for end in range(block, m + 1):
                    key = words[end - block : end]
                    shift[key] = min(shift.get(key, m), m - end)
                bucket[words[m - block :]][words[:block]].append((words, items))
            self.by_length.append((m, block, shift, {k: dict(v) for k, v in bucket.items()}))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, list]]:
        """(start, end, items) of each occurrence."""
        n = len(words)
        for m, block, shift, bucket in self.by_length:
            jump, at = m - block + 1, m
            far = shift.get
            while at <= n:
                key = tuple(words[at - block : at])
                step = far(key, jump)
                if step:
                    at += step
                    continue
                for pattern, items in bucket[key].get(tuple(words[at - m : at - m + block]), ()):
                    if tuple(words[at - m : at]) == pattern:
                        yield at - m, at, items
                at += 1


def windows(words: list[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    """All runs of ``size`` words; a shorter list that isn't empty is one window."""
    for i in range(max(1, len(words) - size + 1) if words else 0):
        yield tuple(words[i : i + size])


def _searcher(texts: list[tuple[str, bytes]], size: int) -> WuManber:
    patterns: dict[tuple[bytes, ...], set] = defaultdict(set)
    for item, words in texts:
        for w in windows(words.split(), size):
            patterns[w].add(item)
    return WuManber({w: sorted(items) for w, items in patterns.items()})


_searchers: dict[int, WuManber] = {}


def _searcher_of(key: int, shared, size: int) -> WuManber:
    """One searcher at a time stays in a worker."""
    if key not in _searchers:
        _searchers.clear()
        _searchers[key] = _searcher(shared.value, size)
    return _searchers[key]


def _with_hits(docs: DataFrame, shared, size: int, b: int, text_col: str) -> DataFrame:
    key = shared._jbroadcast.id()

    def start():
        search = _searcher_of(key, shared, size).search

        def work(texts: list[str]) -> list[pa.Array]:
            n_words, spans, found = [], [], []
            for text in texts:
                words = normal_words(text).split()
                parts, items = [], set()
                for begin, end, own in sorted(search(words), key=lambda x: x[:2]):
                    items.update(own)
                    if parts and begin <= parts[-1][1]:
                        parts[-1][1] = max(parts[-1][1], end)
                    else:
                        parts.append([begin, end])
                n_words.append(len(words))
                spans.append(parts)
                found.append(sorted(items))
            return [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(found, pa.list_(pa.string()))]

        return work

    return annotated(docs, text_col, start, {"n_words": "long", f"_hits_{b}": "array<array<bigint>>", f"_items_{b}": "array<string>"})


def with_hits(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_chars: int = 32 << 20, blocks_at_once: int = 2, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` with n_words, hits (disjoint word ranges [start, end) that occurrences cover, ascending) and
    items (ids of the items with an occurring window, as text, sorted).

    Null texts have no words; items without words have no window; a null item_id is the text "null"; repeated rows stay;
    empty tables give no hits or no rows. Each document is searched whole where it lies, and nothing of ``docs`` is
    shuffled; very long texts take time in proportion. The benchmark is broadcast in blocks of about ``block_chars`` characters of
    text (an item longer than that makes a block longer). At most ``blocks_at_once`` blocks are held at a time: beyond them,
    what has been found is written to the shared folder, their broadcasts are destroyed, and the next ones are searched, so that
    memory doesn't grow with the benchmark. The ranges of all blocks are made one. Columns n_words, hits and items of ``docs``
    are replaced.
    """
    total = benchmark.agg(F.sum(F.length(text_column()))).first()[0] or 0
    blocks = int(total // block_chars) + 1
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), text_column().alias("text"))
    spark = docs.sparkSession
    names, out, held = list(docs.columns), docs, []
    for b in range(blocks):
        if len(held) == blocks_at_once:
            out = stored(out, shared_folder(spark, "decontam"))
            for shared in held:
                shared.destroy()
            held = []
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        held.append(spark.sparkContext.broadcast([(r["item"], normal_words(r["text"])) for r in own.toLocalIterator()]))
        out = _with_hits(out, held[-1], size, b, text_col)
    if blocks == 1:
        hits, found = F.col("_hits_0"), F.col("_items_0")
    else:
        out = out.withColumn("_hits", F.array_sort(F.concat(*[F.col(f"_hits_{b}") for b in range(blocks)])))
        hits, found = _union("_hits"), F.array_sort(F.array_distinct(F.concat(*[F.col(f"_items_{b}") for b in range(blocks)])))
    return out.select(*[F.col(f"`{c}`") for c in names if c not in ("n_words", "hits", "items")], "n_words", hits.alias("hits"), found.alias("items"))


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_chars: int = 32 << 20, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, n_words, hits and items of each row, as :func:`with_hits` has them."""
    return with_hits(docs.select(id_col, "text"), benchmark, size, block_chars).drop("text")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their columns, whatever these are called.

    Each row is judged by its own whole text: null and empty ones have no words and stay, repeated rows stay or go together,
    and an empty table gives an empty one; without items every row stays.
    """
    found = with_hits(packed(docs), benchmark, size, text_col="_row.text")
    return found.where(~contaminated(F.col("n_words"), n_hit(F.col("hits")))).select("_row.*")


def _union(column: str) -> Column:
    """Sorted ranges, overlapping and touching ones made one."""
    last = lambda done: F.try_element_at(done, F.lit(-1))  # noqa: E731  null for an empty array
    joined = lambda done, x: F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.array(last(done)[0], F.greatest(last(done)[1], x[1]))))
    return F.aggregate(F.col(column), F.array().cast("array<array<bigint>>"), lambda done, x: F.when(last(done)[1] >= x[0], joined(done, x)).otherwise(F.concat(done, F.array(x))))


def n_hit(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])


def contaminated(n_words: Column, hit: Column) -> Column:
    """At least one word is hit, and at least one in ``ONE_IN``."""
    return (hit > 0) & (ONE_IN * hit >= n_words)

"""Connected components of an edge table, without collecting links or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, folder: str, rounds: int = 64) -> DataFrame:
    """node, component for the nodes of ``edges`` (u, v: long): the smallest node of each connected component.

    Each round moves every node to the first of itself and its neighbours and contracts the edges to where their ends have
    moved, so that stars are gone after one round and what is left to join shrinks round by round. Rounds order nodes by
    themselves and by a hash in turn: with the latter, long paths shrink by a constant share too. Rounds are written to
    ``folder``; null ends and loops are left out; an empty table gives an empty one. Nodes with many edges are aggregated
    before they are shuffled.
    """
    left = stored(edges.where("u IS NOT NULL AND v IS NOT NULL AND u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{folder}/edges-0")
    moves: list[DataFrame] = []
    while len(moves) < rounds:
        i = len(moves)
        order = (lambda c: F.struct(F.col(c))) if i % 2 == 0 else (lambda c, i=i: F.struct(F.xxhash64(F.col(c), F.lit(i)), F.col(c)))
        both = left.select(F.col("u").alias("node"), F.col("v").alias("next")).union(left.select(F.col("v"), F.col("u")))
        first = both.groupBy("node").agg(F.min_by("next", order("next")).alias("next")).select("node", F.when(order("next") < order("node"), F.col("next")).otherwise(F.col("node")).alias("to"))
        moves.append(stored(first, f"{folder}/moves-{i}"))
        ends = left.join(moves[i].select(F.col("node").alias("u"), F.col("to").alias("a")), "u").select("a", "v").distinct()
        moved = ends.join(moves[i].select(F.col("node").alias("v"), F.col("to").alias("b")), "v").where("a != b")
        left = stored(moved.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{folder}/edges-{i + 1}")
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    to = moves[-1]
    for earlier in reversed(moves[:-1]):
        later = to.select(F.col("node").alias("to"), F.col("to").alias("end"))
        to = earlier.join(later, "to", "left").select("node", F.coalesce("end", "to").alias("to"))
    to = stored(to, f"{folder}/ends")
    return to.join(to.groupBy("to").agg(F.min("node").alias("component")), "to").select("node", "component")

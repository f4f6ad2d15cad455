"""Connected components of an edge table by alternating large-star and small-star
rounds (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. ``edges`` has u > v, each pair once.

    Large star: every larger neighbour of u is hung on u's smallest neighbour.
    Small star: u and its smaller neighbours are hung on the smallest of them.
    The per-node minimum is combined before the shuffle; only a join follows, which
    Spark splits where a hub has many edges.
    """
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        hung = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = hung.union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node reachable.

    ``edges``: two long columns u, v in any order; repeats, self-edges and nulls are
    allowed (the last two are ignored). Empty edges give an empty result. Each round is
    written to the shared folder, so a lost executor never repeats earlier rounds.
    """
    current = staged(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    signature = None
    for _ in range(max_rounds):
        current = staged(_star(_star(current, True), False))
        # Sums of hashes tell whether a round changed anything, without collecting edges.
        now = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 998_244_353)
        ).first()
        if now == signature:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        signature = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")

"""Connected components as DataFrames: alternating large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v of one ordered type, no nulls. Returns node, root for each node of an edge; root: the least node reachable.

    Each round costs two shuffles of the edges, which shrink to one per node; rounds grow with the logarithm of the
    longest path. What a round leaves is written to the shared folder. An empty table gives an empty result.
    """
    edges = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    while True:
        # Large star: each node links its larger neighbours to the least of its neighbours and itself.
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: each node links its smaller neighbours and itself to the least of them.
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(pairs.union(small.select("u", F.col("m").alias("v"))).distinct())
        drop_cut(edges)
        edges, state = after, _state(after)
        if state == before:
            break
        before = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

"""Sharding by Karmarkar-Karp differencing: near-equal bytes over shards, equal texts kept together.

Sizes are summed by group of equal texts, then by item: a group that holds over 1 / (shards * 64) of all bytes is an item of its own, the
others meet in 4096 bins by hash. So there are at most 64 * shards + 4096 items at any size of the table; only
these go to the driver, which differences them: the two partial partitions of the largest spread are combined in opposite order until one
is left. The law is ``bytes``.

Slots number a shard's rows without gaps in two steps, within cells of about sqrt(rows) rows and over the cells of a shard, so no task
sees a whole shard.

Defined results: a null text has no bytes and is in one group with the empty text; repeated rows get slots of their own in one shard; an empty
table gives an empty result; other columns are ignored. A null id is ordered before others.
"""

from __future__ import annotations

import heapq
from math import ceil, sqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import cut, table, text_or_empty

SHARDS, PER_ROW, BINS, FINE = 40, 16, 4096, 64


def differenced(sizes: list[int], k: int) -> list[int]:
    """The part, 0 to k - 1, of each size; parts are numbered from the largest sum down."""
    heap = []
    for i, s in enumerate(sizes):
        sums = (s, *[0] * (k - 1))
        heap.append((-s, i, sums, [[i], *([] for _ in range(k - 1))]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a, of_a = heapq.heappop(heap)
        _, _, b, of_b = heapq.heappop(heap)
        pairs = sorted(((x + y, p + q) for x, y, p, q in zip(a, reversed(b), of_a, reversed(of_b), strict=True)), key=lambda t: -t[0])
        least = pairs[-1][0]
        sums = tuple(x - least for x, _ in pairs)
        heapq.heappush(heap, (-sums[0], i, sums, [m for _, m in pairs]))
    part = [0] * len(sizes)
    for n, members in enumerate(heap[0][3] if heap else []):
        for i in members:
            part[i] = n
    return part


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per row of df: id, size, text_crc32, law, shard, slot, grown_shard."""
    text = text_or_empty(F.col(text_col))
    rows = cut(df.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + PER_ROW).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_group"),
    ))
    groups = rows.groupBy("_group").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    total, count = groups.agg(F.sum("size"), F.sum("n")).first()
    large = F.col("size") > (total or 0) / (shards * FINE)
    bin_ = F.pmod(F.xxhash64("_group"), F.lit(BINS)).cast("int")
    items = groups.select(F.when(~large, bin_).alias("bin"), F.when(large, F.col("_group")).alias("g"), "size")
    items = items.groupBy("bin", "g").agg(F.sum("size").alias("size")).orderBy("bin", "g").collect()  # BINS + FINE * shards rows at most
    parts = differenced([x["size"] for x in items], shards)
    of_bin, of_group = [0] * BINS, []
    for x, p in zip(items, parts, strict=True):
        if x["g"] is None:
            of_bin[x["bin"]] = p
        else:
            of_group.append((bytes(x["g"]), p))
    heavy = df.sparkSession.createDataFrame(of_group, "_of binary, _part int")
    lookup = F.from_json(F.lit(str(of_bin)), "array<int>")
    # At most FINE * shards rows, so it may be broadcast at any size of the table.
    placed = rows.join(F.broadcast(heavy), rows["_group"] == heavy["_of"], "left")
    placed = placed.withColumn("shard", F.coalesce("_part", F.get(lookup, bin_)))
    cells = ceil(4 * sqrt((count or 0) / shards)) or 1
    placed = placed.withColumn("_cell", F.pmod(F.xxhash64("_id", "_group"), F.lit(cells)))
    counts = placed.groupBy("shard", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("shard", "_cell").orderBy("_id", "_group")
    return placed.withColumn("_at", F.row_number().over(inside) - 1).join(starts, ["shard", "_cell"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_start") + F.col("_at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))

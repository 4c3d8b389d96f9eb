"""Merkle manifest of a table: digests of rows, a tree for each group, one tree over the groups, and proofs checked against a changed table.

A row's leaf is the SHA-256 of its fields. A group's leaves, in the order of their ids, are combined in runs of ``ARITY`` level by level until one node is left, and the
groups' roots are combined the same way. Trees are cut into aligned buckets of ``ARITY ** HEIGHT`` = 4096 neighbours, which are whole subtrees. Spark numbers the leaves, deals the
buckets out and joins the tiers; on the executors DuckDB takes each bucket as an Arrow table and computes its levels by ordered ``string_agg`` and ``sha256``. A first pass up gives
each bucket's root, which is a node of the next tier (4096 times smaller); a second pass down hands each bucket the path above it once, as the siblings on its left and right by level, so that
no proof of a row is ever stored or moved: only its digest and the root that it leads to are.

Rows are numbered within ranges of group and id, so neither a group nor the table meets in one task; a group of any size is as many buckets as it needs.

Defined results: a null field is written as ``-`` and an empty one as ``0:``; a null group comes first, before the empty text; null ids come first in their group, and rows that repeat an id are ordered by their
leaves, equal rows being interchangeable; an empty table gives an empty result; other columns are ignored; a row of a null id is never a changed one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import ascii_lower, cut, table
from tessera.llm.resampling import CRC_TABLE, crc_sql

ARITY, HEIGHT = 8, 4
NODE, PATH = "grp string, pos long, h string, levels int", "grp string, pos long, lefts array<string>, rights array<string>, top string"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's fields, each with its length, so that no two rows write the same."""
    return F.sha2(F.concat(*map(field, values)), 256)


def group_key(value: Column) -> Column:
    """A group's name that is never null and sorts as the groups do, null first."""
    return F.when(value.isNull(), "").otherwise(F.concat(F.lit("="), value))


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with pos, 0, 1, 2... within grp, and levels, those of the group's tree: rows are dealt out by ranges and numbered within each."""
    ranged = cut(rows.repartitionByRange("grp", *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part", "grp").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy("grp")
    before = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a group has as many rows here as there are ranges at most
    n = F.sum("_n").over(whole)
    levels = F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, ARITY))).cast("int")
    starts = counts.select(F.col("_part").alias("_p"), F.col("grp").alias("_g"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"), levels.alias("levels"))
    own = ranged.withColumn("_own", F.row_number().over(W.partitionBy("_part", "grp").orderBy(*order)) - 1)
    both = own.join(starts, (F.col("_part") == F.col("_p")) & (F.col("grp") == F.col("_g")))
    return both.select(*rows.columns, (F.col("_start") + F.col("_own")).cast("long").alias("pos"), "levels")


@cache
def engine() -> duckdb.DuckDBPyConnection:
    """A worker's DuckDB: in memory, on one thread."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})


def levels_sql(height: int) -> str:
    """Tables l0 to l<height>, the levels of a bucket (node: pos, h), and s0 to s<height - 1>, what lies left and right of each node in its run."""
    parts = ["l0 AS (SELECT pos, h FROM node)"]
    for k in range(height):
        run = f"PARTITION BY pos // {ARITY} ORDER BY pos ROWS BETWEEN"
        parts.append(
            f"s{k} AS (SELECT pos, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM l{k})"
        )
        parts.append(f"l{k + 1} AS (SELECT pos // {ARITY} AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM l{k} GROUP BY 1)")
    return "WITH " + ", ".join(parts)


def sides_sql(height: int) -> str:
    return "".join(f" JOIN s{k} ON s{k}.pos = n.pos // {ARITY**k}" for k in range(height))


def bucket_roots(group: pa.Table) -> pa.Table:
    """The root of a bucket, as a node of the next tier."""
    levels = group.column("levels")[0].as_py()
    height = min(levels, HEIGHT)
    con = engine()
    con.register("node", group.select(["pos", "h"]))
    found = con.execute(f"{levels_sql(height)} SELECT h FROM l{height}").fetchall()
    con.unregister("node")
    return pa.table({"grp": group.column("grp")[:1], "pos": group.column("bucket")[:1], "h": [found[0][0]], "levels": pa.array([levels - height], pa.int32())})


def bucket_paths(group: pa.Table, above: pa.Table) -> pa.Table:
    """For each node of a bucket what lies left and right of its ancestors, level by level up to the top; above: the bucket's own path."""
    if not len(group):
        return pa.table({"grp": pa.array([], pa.string()), "pos": pa.array([], pa.int64()), **{c: pa.array([], pa.list_(pa.string())) for c in ("lefts", "rights")}, "top": pa.array([], pa.string())})
    height = min(group.column("levels")[0].as_py(), HEIGHT)
    path = above.to_pylist()[0]
    con = engine()
    con.register("node", group.select(["pos", "h"]))
    lists = [f"list_concat([{', '.join(f's{k}.{c}' for k in range(height))}]::VARCHAR[], ?::VARCHAR[]) AS {name}" for c, name in (("l", "lefts"), ("r", "rights"))]
    out = con.execute(f"{levels_sql(height)} SELECT ?::VARCHAR AS grp, n.pos, {', '.join(lists)}, ?::VARCHAR AS top FROM l0 n{sides_sql(height)}", [path["grp"], path["lefts"], path["rights"], path["top"]]).to_arrow_table()
    con.unregister("node")
    return out


def bucket_proofs(root: str, group: pa.Table, above: pa.Table) -> pa.Table:
    """For each leaf of a bucket the digest of its proof, and the root that the leaf given now leads to along the proof."""
    if not len(group):
        return pa.table({"id": pa.array([], pa.int64()), **{c: pa.array([], pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")}, "verified": pa.array([], pa.bool_())})
    height = min(group.column("levels")[0].as_py(), HEIGHT)
    path = above.to_pylist()[0]
    con = engine()
    con.register("node", group.select(["pos", "h"]))
    con.register("given", group.select(["pos", "id", "given"]))
    steps = [levels_sql(height), "f0 AS (SELECT pos, given AS f, '' AS proof FROM given)"]
    for k in range(height):
        steps.append(f"f{k + 1} AS (SELECT f.pos, sha256(s.l || f.f || s.r) AS f, f.proof || s.l || s.r AS proof FROM f{k} f JOIN s{k} s ON s.pos = f.pos // {ARITY**k})")
    for k in range(height, height + len(path["lefts"])):
        steps.append(f"f{k + 1} AS (SELECT pos, sha256(? || f || ?) AS f, proof || ? || ? AS proof FROM f{k})")
    values = [x for lr in zip(path["lefts"], path["rights"], strict=True) for x in lr * 2]
    last = f"f{height + len(path['lefts'])}"
    sql = f"{', '.join(steps)} SELECT g.id, n.h AS leaf, ?::VARCHAR AS subroot, ?::VARCHAR AS root, sha256(p.proof) AS proof_sha256, p.f AS folded_root, p.f = ? AS verified FROM given g JOIN l0 n USING (pos) JOIN {last} p USING (pos)"
    out = con.execute(sql, [*values, path["top"], root, root]).to_arrow_table()
    con.unregister("node")
    con.unregister("given")
    return out


def _bucketed(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("bucket", F.floor(F.col("pos") / ARITY**HEIGHT).cast("long"))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The tiers of the trees of nodes (grp, pos, h, levels), from the nodes themselves up to one node for each group."""
    tiers = [nodes]
    while (nodes.agg(F.max("levels")).first()[0] or 0) > 0:
        nodes = cut(_bucketed(nodes).select("grp", "pos", "h", "levels", "bucket").groupBy("grp", "bucket").applyInArrow(bucket_roots, NODE))
        tiers.append(nodes)
    return tiers


def descend(tiers: list[DataFrame], paths: DataFrame) -> DataFrame:
    """The paths of the lowest of the tiers (grp, pos, lefts, rights, top), from those of the nodes above the highest."""
    for nodes in reversed(tiers):
        here = _bucketed(nodes).select("grp", "pos", "h", "levels", "bucket").groupBy("grp", "bucket")
        paths = cut(here.cogroup(paths.groupBy("grp", "pos")).applyInArrow(bucket_paths, PATH))
    return paths


def proven(rows: DataFrame) -> DataFrame:
    """rows: grp (as by group_key), id, h (a leaf) and given (the leaf as it is now). Returns id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    leaves = cut(numbered(rows.select("grp", "id", "h", "given"), ["id", "h", "given"]))
    tiers = climb(leaves)
    tops = cut(numbered(tiers[-1].select(F.lit("").alias("grp"), F.col("grp").alias("of"), "h"), ["of"]))
    upper = climb(tops.select("grp", "pos", "h", "levels"))
    root = upper[-1].first()
    root = root["h"] if root else ""
    start = rows.sparkSession.createDataFrame([("", 0, [], [], root)], PATH)
    # The highest tier is a single node, whose path is empty; those below it get theirs from the tier above.
    outer = descend(upper[:-1], start) if len(upper) > 1 else start
    of = tops.select(F.col("pos").alias("_pos"), "of", "h")
    outer = outer.join(of, F.col("pos") == F.col("_pos")).select(F.col("of").alias("grp"), F.lit(0).cast("long").alias("pos"), "lefts", "rights", F.col("h").alias("top"))
    outer = descend(tiers[1:-1], outer)
    here = _bucketed(leaves).groupBy("grp", "bucket")
    shape = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return here.cogroup(outer.groupBy("grp", "pos")).applyInArrow(lambda group, above: bucket_proofs(root, group, above), shape)


def manifest(df: DataFrame, changed: Column, changes: dict[str, Column], id_col: str = "doc_id", group_col: str = "lang", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """One row per row of df: its leaf, the roots above it, its proof's digest, and whether the row as it is now (``changes`` replace columns where ``changed`` holds) still leads to the root."""
    first = leaf([F.col(c) for c in columns])
    now = leaf([changes.get(c, F.col(c)) for c in columns])
    rows = df.select(group_key(F.col(group_col)).alias("grp"), F.col(id_col).cast("long").alias("id"), first.alias("h"), F.when(changed, now).alias("_now"))
    return proven(rows.withColumn("given", F.coalesce("_now", "h"))).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    return manifest(table(spark, sf_dir, "documents"), tampered, {"text": ascii_lower(F.col("text"))})


def _sql(levels: int = 7, upper: int = 2) -> str:
    """The manifest in SQL, for groups of up to 8 ** levels rows and up to 8 ** upper groups."""
    field_sql = "CASE WHEN {0} IS NULL THEN '-' ELSE octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR END"
    leaf_sql = lambda text: "sha256(" + " || ".join(field_sql.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"crc AS ({CRC_TABLE})",
        "d AS (SELECT *, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g FROM documents)",
        f"b AS (SELECT doc_id, g, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS p0, {leaf_sql('text')} AS leaf, CASE WHEN {crc_sql('doc_id::VARCHAR')} % 3 = 0 THEN {leaf_sql(small)} ELSE {leaf_sql('text')} END AS given FROM d, crc)",
        "n0 AS (SELECT g, p0 AS p, leaf AS h FROM b)",
        "x0 AS (SELECT doc_id, g, p0 AS p, given AS f, '' AS proof FROM b)",
    ]
    run = "PARTITION BY g, p // 8 ORDER BY p ROWS BETWEEN"
    for k in range(levels + upper):
        if k == levels:
            parts.append(f"t{k} AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS p FROM n{k})")
            parts.append(f"n{k}u AS (SELECT '' AS g, p, h FROM t{k})")
            parts.append(f"x{k}u AS (SELECT x.doc_id, '' AS g, t.p, x.f, x.proof FROM x{k} x JOIN t{k} t USING (g))")
        n, x = (f"{c}{k}u" if k == levels else f"{c}{k}" for c in "nx")
        parts.append(f"c{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM {n})")
        parts.append(f"s{k} AS (SELECT g, p, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, m FROM c{k})")
        parts.append(f"n{k + 1} AS (SELECT g, p // 8 AS p, CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h FROM c{k} GROUP BY g, p // 8)")
        parts.append(f"x{k + 1} AS (SELECT doc_id, g, p // 8 AS p, CASE WHEN m = 1 THEN f ELSE sha256(l || f || r) END AS f, CASE WHEN m = 1 THEN proof ELSE proof || l || r END AS proof FROM {x} JOIN s{k} USING (g, p))")
    top = levels + upper
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, b.leaf, t.h AS subroot, n.h AS root, sha256(x.proof) AS proof_sha256, x.f AS folded_root, x.f = n.h AS verified "
        f"FROM b JOIN x{top} x USING (doc_id) JOIN t{levels} t ON t.g = b.g, n{top} n"
    )


SQL = _sql()

"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so (an anchor pattern after a least length), so equal texts give equal
chunks wherever they are stored. Each chunk gets an identifier, which is verified: one pass groups the chunks by their
bytes and looks for identifiers that two different chunks share. Where none do, the identifier is the chunk's
XXH64; those of a shared hash are numbered by their bytes. Documents are then compared by their ordered identifier lists, 8 bytes
for some 550 characters, and long texts aren't moved again.

Defined results: a null text counts as empty; empty texts are equal to each other; of rows that tie on the largest id one stays; an empty table gives an empty result; other columns are ignored and
keep their names. A null id is smaller than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import ascii_lower, cut, drop_cut, text_or_empty

#: Characters of a chunk, and what ends one: a vowel, white space and a consonant of these.
LEAST, MOST, ANCHOR = 512, 4096, r"[aeiou][ \n][bdfglmpst]"


def chunks(text: Column) -> Column:
    pattern = rf"(?s).{{{LEAST},{MOST}}}?{ANCHOR}|.{{1,{MOST}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def clashes(chunk: DataFrame) -> DataFrame:
    """The hashes (h) that different chunks share; chunk: columns h and chunk."""
    return chunk.groupBy("h", "chunk").agg(F.lit(1).alias("n")).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")


def numbered(rows: DataFrame, bad: DataFrame, hashed) -> DataFrame:
    """Recipes whose shared hashes carry the number of the chunk among those of its hash (the exact way past a clash)."""
    long = rows.select("_row", F.posexplode(chunks(F.col("_norm"))).alias("at", "chunk")).withColumn("h", hashed(F.col("chunk")))
    kinds = long.join(bad, "h", "left_semi").groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    smaller = kinds.alias("a").join(kinds.alias("b"), (F.col("a.h") == F.col("b.h")) & (F.col("b.chunk") < F.col("a.chunk")), "left")
    ranks = smaller.groupBy(F.col("a.h").alias("h"), F.col("a.chunk").alias("chunk")).agg(F.count("b.h").alias("rank"))
    long = long.join(ranks, ["h", "chunk"], "left")
    pair = F.struct("at", "h", F.coalesce("rank", F.lit(0)).alias("rank"))
    lists = long.groupBy("_row").agg(F.sort_array(F.collect_list(pair)).alias("pairs"))
    flat = F.flatten(F.transform("pairs", lambda x: F.array(x["h"], x["rank"])))
    return rows.join(lists.select("_row", flat.alias("_listed")), "_row", "left").withColumn(
        "_recipe", F.coalesce("_listed", F.array().cast("array<bigint>"))
    ).drop("_listed")


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=F.xxhash64) -> DataFrame:
    """One row per row of df: id, keep_id, group_size, kept, text_sha256."""
    rows = df.select(F.col(id_col).alias("_id"), ascii_lower(text_or_empty(F.col(text_col))).alias("_norm"))
    chunk = rows.select(F.explode(chunks(F.col("_norm"))).alias("chunk"))
    bad = clashes(chunk.select(hashed(F.col("chunk")).alias("h"), "chunk"))
    bad = cut(bad)
    if bad.isEmpty():
        listed = rows.withColumn("_recipe", F.transform(chunks(F.col("_norm")), lambda c: hashed(c)))
    else:
        named = rows.withColumn("_row", F.struct("_id", F.sha2("_norm", 256)))
        listed = numbered(named.dropDuplicates(["_row"]), bad, hashed).select("_row", "_recipe")
        listed = named.join(listed, "_row")
    # Written once, so a row's number stays what it is; it tells rows of one id and text apart.
    listed = cut(listed.select("_id", "_recipe", F.sha2("_norm", 256).alias("_sha"), F.monotonically_increasing_id().alias("_at")))
    drop_cut(bad)
    groups = listed.groupBy("_recipe").agg(F.max(F.struct("_id", "_at")).alias("_keep"), F.count(F.lit(1)).alias("_size"))
    # A key of their own makes Spark deal out both sides for the join, so that it can split what a hot group fills.
    key = F.xxhash64("_recipe", F.lit(1)).alias("_key")
    alone = groups.filter("_size > 1").select(key, F.col("_recipe").alias("_of"), "_keep", "_size")
    here = listed.select("*", key)
    both = here.join(alone, (here["_key"] == alone["_key"]) & (here["_recipe"] == alone["_of"]), "left")
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep._id"))
    return both.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("_size").isNull() | (F.col("_at") == F.col("_keep._at"))).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the rows whose text equals that of a row with a larger id; of equal ids and texts one row stays."""
    marks = cut(annotate(df, id_col, text_col).filter("group_size > 1").select(F.col(id_col).alias("__exact_id"), F.unhex("text_sha256").alias("__exact_sha"), F.col(id_col).eqNullSafe(F.col("keep_id")).alias("stays")))
    sha = F.unhex(F.sha2(ascii_lower(text_or_empty(F.col(text_col))), 256))
    left = df.withColumn("__text_sha", sha)
    gone = marks.filter("NOT stays").select("__exact_id", "__exact_sha").distinct()
    left = left.join(gone, left[id_col].eqNullSafe(gone["__exact_id"]) & (left["__text_sha"] == gone["__exact_sha"]), "left_anti")
    if not marks.filter("stays").groupBy("__exact_id", "__exact_sha").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates([id_col, "__text_sha"])
    return left.drop("__text_sha")


def query(spark, sf_dir: str) -> DataFrame:
    from tessera.llm.common import table

    return annotate(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
"""

import hashlib

from pyspark.sql import functions as F

from tessera.llm import exact_dedup
from tests.llm.helpers import DOC_SCHEMA, documents, edge_texts


def norm(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    return sorted((i, max(groups[norm(t)]), len(groups[norm(t)]), i == max(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


def test_equal_texts_meet(spark):
    texts = edge_texts()
    df = documents(spark, texts).withColumn("kept", F.lit("mine")).withColumn("_key", F.lit(1))
    got = sorted(tuple(r) for r in exact_dedup.annotate(df).collect())
    assert got == brute(list(enumerate(texts)))


def test_chunks_hold_the_whole_text(spark):
    texts = ["word and more text " * 900, "é\nü " * 3000, "x" * 20000, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(exact_dedup.chunks(F.col("t")).alias("c"))
    for t, r in zip(texts, df.collect(), strict=True):
        assert "".join(r["c"]) == t and all(len(c) <= exact_dedup.MOST + 3 for c in r["c"])


def test_shared_hashes_are_told_apart(spark):
    texts = ["abc", "abd", "abc", "xyz " * 600, "xyy " * 600, "xyz " * 600]
    bad = lambda c: F.length(c).cast("long")
    got = sorted(tuple(r) for r in exact_dedup.annotate(documents(spark, texts), hashed=bad).collect())
    assert got == brute(list(enumerate(texts)))


def test_one_of_each_stays(spark):
    df = documents(spark, ["a", "A", "b", None, ""])
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(df).collect()) == [1, 2, 4]
    twice = df.union(df)
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(twice).collect()) == [1, 2, 4]
    assert exact_dedup.deduplicate(df).columns == df.columns


def test_empty_table(spark):
    empty = spark.createDataFrame([], DOC_SCHEMA)
    assert exact_dedup.annotate(empty).count() == 0 == exact_dedup.deduplicate(empty).count()


def test_of_tied_rows_one_stays(spark):
    df = documents(spark, ["a", "A", "b"])
    got = exact_dedup.annotate(df.union(df).union(df.filter("doc_id = 1"))).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [(0, 1, 5)] * 2 + [(1, 1, 5)] * 3 + [(2, 2, 2)] * 2
    assert sorted(r["doc_id"] for r in got if r["kept"]) == [1, 2]
    assert sorted(r["doc_id"] for r in exact_dedup.deduplicate(df.union(df)).collect()) == [1, 2]

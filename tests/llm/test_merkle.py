import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle
from tests.llm.helpers import DOC_SCHEMA


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    """The root, and for each node its levels of (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(paths):
            a = at[k] - at[k] % 8
            run = nodes[a : a + 8]
            p.append((run[: at[k] - a], run[at[k] - a + 1 :]))
        nodes, at = [digest(*nodes[a : a + 8]) for a in range(0, len(nodes), 8)], [x // 8 for x in at]
    return nodes[0] if nodes else None, paths


def brute(rows, changed, change):
    """rows: tuples in the order of DOC_SCHEMA."""
    leaf = lambda r: digest(*map(field, (r[0], r[3], r[2], r[4], r[1])))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf(r) for r in sorted(groups[g])]) for g in names}
    root, upper = tree([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, upper, strict=True):
        for r, path in zip(sorted(groups[g]), trees[g][1], strict=True):
            now = leaf((r[0], change(r[1]), *r[2:])) if changed(r) and r[1] is not None else leaf(r)
            for left, right in path + above:
                now = digest(*left, now, *right)
            proof = digest(*(x for left, right in path + above for x in left + right))
            out.append((r[0], leaf(r), trees[g][0], root, proof, now, now == root))
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame(rows, DOC_SCHEMA).withColumn("grp", F.lit("x")).withColumn("pos", F.lit(7)).withColumn("given", F.lit(1))
    return sorted(tuple(r) for r in merkle.manifest(df, F.col("doc_id") % 3 == 0, {"text": F.lower("text")}).collect())


@pytest.mark.parametrize("sizes", [{"de": 1}, {"de": 8, None: 9, "": 1}, {"en": 65, "é": 64, "f": 1, None: 3}, {k: 2 for k in "abcdefghijk"}])
def test_equals_the_definition(spark, sizes):
    rows = [(100 * k + i, (None, "", "Some Text", "plain é")[i % 4], lang, (None, "web")[i % 2], (None, i)[i % 5 > 0]) for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    assert found(spark, rows) == brute(rows, lambda r: r[0] % 3 == 0, str.lower)


def test_several_buckets_of_a_group(spark):
    rows = [(i, f"Row {i}", "en" if i % 40 else "de", "s", i) for i in range(9000)]
    got, want = found(spark, rows), brute(rows, lambda r: r[0] % 3 == 0, str.lower)
    assert got == want and {r[6] for r in got} == {True, False}


def test_repeats_null_ids_and_an_empty_table(spark):
    rows = [(None, "a", "en", "s", 1), (1, "B", "en", "s", 1), (1, "B", "en", "s", 1), (None, "c", None, None, None)]
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    got = merkle.manifest(df, F.lit(False), {}).collect()
    assert len(got) == 4 and all(r["verified"] for r in got) and len({r["root"] for r in got}) == 1
    assert merkle.manifest(df.limit(0), F.lit(True), {}).count() == 0


def test_tampering_shows_only_where_it_is(spark):
    rows = [(i, "Text", "en", "s", 4) for i in range(30)]
    bad = merkle.manifest(spark.createDataFrame(rows, DOC_SCHEMA), F.col("doc_id") == 17, {"text": F.lit("text")}).filter("NOT verified").collect()
    assert [r["doc_id"] for r in bad] == [17]

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import resampling
from tests.llm.helpers import DOC_SCHEMA, documents, edge_texts

POEM = "the river runs past seven old mills and a chapel where no bell has rung since the flood of that year"


def counted(text, n, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return len(words), Counter(zlib.crc32(r.encode()) % buckets for r in runs)


def brute(rows, target, n=1, buckets=10_000, percent=10, least=20):
    """id, features, weight, score, rank of each row, from the definitions."""
    each = [(i, *counted(t, n, buckets)) for i, t in rows]
    s, t = sum((c for _, _, c in each), Counter()), sum((counted(x, n, buckets)[1] for x in target), Counter())
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: floor(1000 * log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, words, c in each:
        total = sum(c.values())
        weight = sum(gain(b) * k for b, k in c.items()) // total if total else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, words, total, weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out))


def test_equals_the_definition(spark):
    texts = edge_texts() + [f"{POEM} {k} {POEM if k % 3 else 'Zwölf Boxkämpfer jagen Viktor'}" for k in range(150)] + ["Many a MILL, many-a mill!" * (k % 7) for k in range(60)]
    target = [POEM, "old mills 7", None, ""]
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    df = documents(spark, texts).withColumn("score", F.lit("mine")).withColumn("bucket", F.lit(0))
    for how in ({}, {"n": 2, "buckets": 97, "percent": 37, "least": 1}):
        found = resampling.resample(df, aim, **{{"least": "least_words"}.get(k, k): v for k, v in how.items()})
        assert sorted(tuple(r) for r in found.collect()) == brute(list(enumerate(texts)), target, **how)


def test_ties_and_repeats(spark):
    df = documents(spark, [POEM] * 30)
    rows = resampling.resample(df.union(df), df.limit(0), percent=50).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 31))
    assert len({r["doc_id"] for r in rows if r["rank"]}) == 15
    assert resampling.sample(df, df, percent=50).count() == 15


def test_null_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(None, POEM, None, None, None), (1, POEM, None, None, None), (2, None, None, None, None)], DOC_SCHEMA)
    found = {r["doc_id"]: r for r in resampling.resample(df, df, percent=100).collect()}
    assert sorted(found[i]["rank"] for i in (None, 1)) == [1, 2] and found[2]["rank"] is None and found[2]["weight"] == 0
    assert resampling.resample(df.limit(0), df).count() == 0
    assert resampling.resample(df, df.limit(0)).count() == 3


def test_blocks_hold_the_counts(spark):
    rows = resampling.count_matrix(documents(spark, ["a b a", None, "c"]), "doc_id", "text", 1, 50).collect()
    flat = {}
    for r in rows:
        for k, i in enumerate(r["id"]):
            a, b = r["start"][k : k + 2]
            flat[i] = dict(zip(r["bucket"][a:b], r["times"][a:b], strict=True))
    assert flat == {0: dict(counted("a b a", 1, 50)[1]), 1: {}, 2: dict(counted("c", 1, 50)[1])}


def test_blocks_stay_small(spark, monkeypatch):
    # A block of a thousand long documents, and a task's blocks as Python lists, outgrew an executor.
    monkeypatch.setattr(resampling, "CELLS", 100)
    texts = [" ".join(f"w{k * j}" for j in range(40)) for k in range(60)] + [None] * 3
    blocks = [b for b in resampling.csr_blocks(pa.array(range(63), pa.int64()), pa.array([t and t.encode() for t in texts]), 1, 10_000)]
    assert len(blocks) > 15 and all(len(b.column("bucket")[0]) < 140 for b in blocks)
    assert [i for b in blocks for i in b.column("id")[0].as_py()] == list(range(63))


def test_scoring_holds_one_block():
    # 30 blocks in one batch of 60 MB: their numbers as Python objects were 396 MB.
    got = {}
    matrix = type("Matrix", (), {"mapInArrow": lambda self, run, schema: got.setdefault("run", run)})()
    resampling.scored(matrix, np.arange(10_000))
    cells, rows = 1 << 18, 1024
    flat = [np.arange(rows), np.full(rows, cells // rows), np.full(rows, cells // rows), np.arange(0, cells + 1, cells // rows, dtype=np.int32), np.arange(cells, dtype=np.int32) % 10_000, np.ones(cells, np.int32)]
    batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(31) * len(x), pa.int32()), pa.array(np.tile(x, 30))) for x in flat], names=["id", "words", "features", "start", "bucket", "times"])
    tracemalloc.start()
    out = [b for b in got["run"]([batch])]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in out) == 30 * rows and most < 50e6

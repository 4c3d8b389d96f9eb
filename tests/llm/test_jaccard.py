import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard
from tests.llm.helpers import DOC_SCHEMA, documents, edge_texts, find_roots, shaken


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def brute(texts, n=5, percent=80):
    sets = [shingle_set(t, n) for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and 100 * len(a & b) >= percent * len(a | b)]
    return sorted((i, len(s), r) for i, (s, r) in enumerate(zip(sets, find_roots(len(sets), links), strict=True)))


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    passage = shaken(rng, words, 40)
    texts = edge_texts() + ["One  two\tthree four FIVE", "one two three four five", "\x1cone two\x1c", "one two"]
    for _ in range(25):
        base = shaken(rng, words, rng.choice([6, 9, 30, 120, 400])).split()
        for _ in range(rng.choice([1, 3, 12])):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25 + 1)):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    # A passage that makes up most of many texts, which are near 0.8 or below.
    texts += [f"{passage} {shaken(rng, words, rng.randrange(1, 8))}" for _ in range(60)]
    # A chain: each text is near the next, and the ends are far apart.
    chain = shaken(rng, words, 100).split()
    for k in range(20):
        texts.append(" ".join(chain[3 * k : 3 * k + 45]))
    return texts


@pytest.mark.parametrize("how", [{}, {"n": 2, "percent": 60}, {"piece": 3, "group": 2, "meet": 2}])
def test_equals_all_pairs(spark, how):
    texts = corpus()
    df = documents(spark, texts).withColumn("digest", F.lit("mine")).withColumn("root", F.lit(1)).withColumn("_key", F.lit(2))
    got = sorted(tuple(r) for r in jaccard.cluster(df, **how).collect())
    assert got == brute(texts, **{k: v for k, v in how.items() if k in ("n", "percent")})


def test_groups_alone_find_what_keys_miss(spark, monkeypatch):
    """Without the links within keys, each is found through the matrix."""
    monkeypatch.setattr(jaccard, "near_links", lambda sets, percent, piece: spark.createDataFrame([], "u binary, v binary"))
    texts = corpus(5)
    assert sorted(tuple(r) for r in jaccard.cluster(documents(spark, texts)).collect()) == brute(texts)


def test_repeats_and_null_ids(spark):
    long = shaken(random.Random(1), [f"v{i}" for i in range(90)], 60)
    rows = [(5, long), (5, long), (3, long + " end"), (None, long), (None, "alone here"), (7, None), (8, "")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC_SCHEMA)
    got = [tuple(r) for r in jaccard.cluster(df).collect()]
    assert sorted(got, key=str) == sorted([(5, 56, 3)] * 2 + [(3, 57, 3), (None, 56, 3), (None, 1, None), (7, 0, 7), (8, 0, 8)], key=str)
    assert jaccard.cluster(df.limit(0)).count() == 0


def test_packed_tokens_come_back():
    x = np.array([0, 1, (1 << 48) - 1, 123456789012], np.uint64)
    assert (jaccard.unpack(jaccard.pack(x)) == x).all()


def test_a_block_sends_each_token_once():
    sets = [np.array([5 << 20, 9 << 20, 1 << 63], np.uint64), np.array([9 << 20, 1 << 63], np.uint64), np.array([], np.uint64)]
    *rows, own = jaccard.block_rows(1, [10, 11, 12], sets, 5)
    assert [(r["to"], len(r["one"]) // 6, len(r["many"]) // 6) for r in rows] == [(0, 1, 1), (16, 0, 1)]
    assert own["to"] == -2 and own["n"] == [3, 2, 0] and np.frombuffer(own["places"], np.uint16).tolist() == [0, 1, 0, 1]

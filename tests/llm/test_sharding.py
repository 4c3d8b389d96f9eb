import random
import zlib
from collections import defaultdict

from tessera.llm import sharding
from tests.llm.helpers import DOC_SCHEMA, documents, edge_texts


def test_differencing_is_tight():
    rng = random.Random(1)
    sizes = [rng.randint(1, 10_000) for _ in range(800)]
    sums = defaultdict(int)
    for s, p in zip(sizes, sharding.differenced(sizes, 8), strict=True):
        sums[p] += s
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) < 50
    assert sharding.differenced([], 3) == [] and sorted(sharding.differenced([5, 1, 1], 3)) == [0, 1, 2]


def test_groups_slots_and_sizes(spark):
    rng = random.Random(2)
    texts = edge_texts() + [rng.choice("abc") * rng.randint(0, 300) for _ in range(300)]
    rows = {r["doc_id"]: r for r in sharding.shard(documents(spark, texts), shards=6).collect()}
    assert len(rows) == len(texts)
    shards, slots, load = defaultdict(set), defaultdict(list), defaultdict(int)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        assert (rows[i]["size"], rows[i]["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
        assert rows[i]["law"] == "bytes" and rows[i]["grown_shard"] is None
        shards[t or ""].add(rows[i]["shard"])
        slots[rows[i]["shard"]].append(rows[i]["slot"])
        load[rows[i]["shard"]] += rows[i]["size"]
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = defaultdict(int)
    for i, t in enumerate(texts):
        groups[t or ""] += rows[i]["size"]
    assert max(load.values()) - min(load.values()) <= max(groups.values())


def test_repeated_and_no_rows(spark):
    df = documents(spark, ["a", "b"])
    assert sorted(r["slot"] for r in sharding.shard(df.union(df), shards=1).collect()) == [0, 1, 2, 3]
    assert sharding.shard(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def plainly_differenced(sizes, k):
    """The method by its definition: lists of partial partitions, the two of the largest spread are combined in opposite order."""
    left = [(i, [(s, [i])] + [(0, [])] * (k - 1)) for i, s in enumerate(sizes)]
    while len(left) > 1:
        left.sort(key=lambda x: (-(x[1][0][0] - x[1][-1][0]), x[0]))
        (i, a), (_, b) = left[:2]
        both = sorted(((x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b), strict=True)), key=lambda t: -t[0])
        left[:2] = [(i, both)]
    part = {j: p for p, (_, members) in enumerate(left[0][1]) for j in members}
    return [part[j] for j in range(len(sizes))]


def test_differencing_is_that_of_its_definition():
    rng = random.Random(4)
    for _ in range(60):
        sizes, k = [rng.choice([1, 1, 2, 3, rng.randint(1, 1000)]) for _ in range(rng.randint(1, 30))], rng.randint(1, 6)
        assert sharding.differenced(sizes, k) == plainly_differenced(sizes, k)

import random
from collections import Counter
from math import ceil

import numpy as np
import xxhash

from tessera.llm import graph, simhash
from tests.llm.helpers import DOC_SCHEMA, documents, edge_texts, find_roots, shaken


def brute_print(text, n=3):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def check(spark, texts, **options):
    prints = [brute_print(t) for t in texts]
    roots = find_roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
    got = sorted(tuple(r) for r in simhash.cluster(documents(spark, texts), **options).collect())
    assert got == [(i, f"{p:016x}", r) for i, (p, r) in enumerate(zip(prints, roots, strict=True))]


def near_texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    out = edge_texts()
    for _ in range(6):
        base = shaken(rng, words, 200).split()
        for _ in range(6):
            copy = base[:]
            copy[rng.randrange(200)] = "other"
            out.append(" ".join(copy))
    return out


def test_components_are_those_of_all_pairs(spark):
    check(spark, near_texts())


def test_hot_keys_lose_no_link(spark):
    check(spark, near_texts(), hot=1)


def test_links_at_each_distance(spark):
    prints = [0, 1, 3, 7, 1 << 63, (1 << 63) | (1 << 40), 0xFFFF, 0xFFFF0000]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "f long")
    for hot in (64, 1):
        links = [(r["u"], r["v"]) for r in simhash.links(df, hot=hot).collect()]
        own = find_roots(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])
        assert find_roots(len(prints), [(signed.index(u), signed.index(v)) for u, v in links]) == own


def test_long_paths_close(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r["node"]: r["root"] for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_stage_keeps_one_of_each(spark):
    texts = ["a b c d e f g", "a b c d e f g", "something else that is here now", None, ""]
    df = documents(spark, texts)
    kept = simhash.deduplicate(df.union(df), n=5)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3] and kept.columns == df.columns
    assert simhash.cluster(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_bits_are_counted_by_planes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 100, 1001):
        x = rng.integers(0, 1 << 63, (n, 3), dtype=np.uint64)
        bits = (x[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        assert (simhash.vertical_counts(x) == bits.sum(0).astype(int).ravel()).all()


def test_similar_texts_meet_and_others_stay(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts, near = [], []
    for g in range(30):
        base = shaken(rng, words, 400).split()
        copy = base[:]
        for k in rng.sample(range(400), 3):
            copy[k] = "other"
        texts += [" ".join(base), " ".join(copy), shaken(rng, words, 300)]
        near.append(3 * g + 1)
    kept = {r["doc_id"] for r in simhash.deduplicate(documents(spark, texts), n=5).collect()}
    assert set(range(len(texts))) - kept == set(near)


def wide_links(wide, similarity=0.8):
    """All pairs that share a key and differ in few enough bits."""
    words, most, (bits, pairs) = wide.view(np.uint64), simhash.most_bits(similarity), simhash.layout(len(wide), similarity)
    keys = simhash.wide_keys(wide, bits, pairs)
    return [(i, j) for i in range(len(wide)) for j in np.flatnonzero((np.bitwise_count(words[:i] ^ words[i]).sum(1) <= most) & (keys[:i] == keys[i]).any(1)).tolist()]


def variants(n, share, seed):
    """n variants of an original of random bits, each bit flipped with the chance ``share``; the original comes last."""
    rng = np.random.default_rng(seed)
    original = rng.random(simhash.WIDE * 64) < 0.5
    return np.packbits(np.vstack([original ^ (rng.random((n, simhash.WIDE * 64)) < share), original]), axis=1, bitorder="little")


def wide_roots(spark, wide, **options):
    df = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(wide)], "f long, wide binary")
    found = {r["node"]: r["root"] for r in simhash.similar_roots(df, 0.8, **options).collect()}
    return [found.get(i, i) for i in range(len(wide))]


def test_keys_are_pairs_of_blocks():
    rng = np.random.default_rng(1)
    wide = rng.integers(0, 256, (20, simhash.WIDE * 8), dtype=np.uint8)
    for n in (1000, 5_000_000):
        bits, pairs = simhash.layout(n, 0.8)
        assert len({frozenset(p) for p in pairs}) == len(pairs) and all(a != b for a, b in pairs)
        keys, flat = simhash.wide_keys(wide, bits, pairs), np.unpackbits(wide, axis=1, bitorder="little")
        assert len(np.unique(keys)) == keys.size
        wide2 = wide.copy()
        wide2[:, -1] ^= 255  # bits of the last block that a key can hold, or of none
        changed = {j for j in range(len(pairs)) if (simhash.wide_keys(wide2, bits, pairs)[:, j] != keys[:, j]).any()}
        last = np.flatnonzero((flat != np.unpackbits(wide2, axis=1, bitorder="little")).any(0)) // bits
        assert changed == {j for j, p in enumerate(pairs) if set(p) & set(last.tolist())}


def test_thousands_of_variants_join_their_original(spark):
    # At 0.85 to the original, below 0.8 to one another.
    wide = variants(2500, np.arccos(2 * 0.85 / 1.85) / np.pi, 4)
    got = wide_roots(spark, wide)
    assert got == find_roots(len(wide), wide_links(wide)) and got.count(got[-1]) > 0.97 * len(wide)


def test_hot_keys_link_as_all_pairs_do(spark):
    # Chains as well: variants at half the distance link to one another, those of the second group to some of the first.
    wide = np.vstack([variants(150, 0.129, 5), variants(150, 0.09, 6), variants(60, 0.16, 5)])
    wide = np.unique(wide, axis=0)
    own = find_roots(len(wide), wide_links(wide))
    for options in ({}, {"piece": 40}):
        assert wide_roots(spark, wide, **options) == own


def jaccard_pairs(texts, least):
    """All pairs at a similarity of five-word shingles, by an inverted list of each text's rarest shingles: equal sets share one of the first n - least n + 1."""
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for t in texts]
    count = Counter(x for s in sets for x in s)
    lists, out = {}, {}
    for i, s in enumerate(sets):
        for x in sorted(s, key=lambda x: (count[x], x))[: len(s) - ceil(least * len(s)) + 1]:
            lists.setdefault(x, []).append(i)
    for members in lists.values():
        for k, i in enumerate(members):
            for j in members[:k]:
                if (j, i) not in out:
                    out[j, i] = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    return {p for p, v in out.items() if v >= least}


def edited(rng, words, edits):
    words = words[:]
    for k in rng.sample(range(len(words)), edits):
        words[k] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def test_recall_against_all_pairs_of_ten_thousand(spark):
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = [shaken(rng, vocabulary, 120) for _ in range(9000)]
    for _ in range(350):  # edits of one to three words: similarities from 0.77 to 0.92
        base = shaken(rng, vocabulary, 120).split()
        texts += [" ".join(base), edited(rng, base, 1), edited(rng, base, 2), edited(rng, base, 3)]
    hot = shaken(rng, vocabulary, 120).split()
    texts += [" ".join(hot), *(edited(rng, hot, 2) for _ in range(400))]  # one original's variants, most below 0.8 to one another
    rng.shuffle(texts)
    pairs = jaccard_pairs(texts, 0.8)
    root = {r["id"]: r["root"] for r in simhash._similar(documents(spark, texts), "doc_id", "text", 5, 0.8, simhash.PIECE).select("id", "root").collect()}
    found = sum(root[i] == root[j] for i, j in pairs)
    assert len(texts) > 10_000 and len(pairs) > 1500 and found >= 0.97 * len(pairs)
    alone = set(range(len(texts))) - {x for p in jaccard_pairs(texts, 0.6) for x in p}
    sizes = Counter(root.values())
    assert sum(sizes[root[i]] > 1 for i in alone) == 0


def test_what_is_closed_is_not_linked_again(spark, monkeypatch):
    # Keys of one hot group each gave a forest of their members, though stars had closed most of it: 57299 links on check_h for 172 between components.
    wide = np.unique(np.vstack([variants(400, 0.129, 5), variants(150, 0.09, 6), variants(60, 0.16, 5)]), axis=0)
    own, given = find_roots(len(wide), wide_links(wide)), []
    monkeypatch.setattr(simhash, "components", lambda edges: given.append(edges.count()) or graph.components(edges))
    assert wide_roots(spark, wide) == own
    assert len(given) == 3 and sum(given[1:]) < len(wide)


def test_links_between_components_close_a_key():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, (1, simhash.WIDE), dtype=np.uint64) ^ (np.uint64(1) << np.arange(40, dtype=np.uint64))[:, None] * (np.arange(simhash.WIDE) == 0).astype(np.uint64)
    assert simhash.close_links(x, np.zeros(40, np.int64), 2) == []
    assert len(simhash.close_links(x, np.arange(40) // 10, 2)) == 3 and len(simhash.close_links(x, np.arange(40), 2)) == 39
    assert simhash.close_links(x, np.arange(40) // 10, 1) == []

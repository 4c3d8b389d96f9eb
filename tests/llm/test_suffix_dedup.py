import hashlib
import random

import numpy as np

from tessera.llm import suffix_dedup
from tests.llm.helpers import DOC_SCHEMA, documents, edge_texts


def brute(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def passages():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 400))) for _ in range(40)]
    out = edge_texts() + ["a" * 500, "a" * 99, "a" * 100, "ab" * 300]
    for _ in range(120):
        text = ""
        for _ in range(rng.randint(0, 4)):
            x = rng.choice(base)
            at = rng.randint(0, max(0, len(x) - 1))
            text += x[at : at + rng.randint(50, 300)] + rng.choice(["", "z", "yy"])
        out.append(text)
    return out


def test_cover_has_all_differences():
    assert {(a - b) % suffix_dedup.V for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.V))


def test_removed_bytes_are_those_of_all_windows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    texts = passages()
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.deduplicate(documents(spark, texts)).collect()}
    assert got == brute(texts)


def flags_of(docs, names=None):
    data = np.frombuffer(b"".join(docs), np.uint8)
    lengths = np.array([len(d) for d in docs])
    at = np.flatnonzero(suffix_dedup.window_mask(lengths, len(data))[: len(data) - 99])
    seen, own = set(), []
    for i in at.tolist():
        text = data[i : i + 100].tobytes()
        own.append(text in seen)
        seen.add(text)
    got = suffix_dedup.sorted_later(data, at, suffix_dedup.phases(lengths, len(data)), names)
    return got.tolist(), own


def test_equal_names_of_different_strings_are_told_apart():
    same = lambda at, n: np.zeros(len(at), np.uint64)
    docs = [b"x" * 130, b"x" * 32 + b"y" * 98, b"x" * 64 + b"y" * 66, b"x" * 130]
    got, own = flags_of(docs, same)
    assert got == own


def test_ties_beyond_the_head_are_resolved_as_by_all_bytes():
    rng = random.Random(7)
    head, end = b"h" * 40, bytes(rng.randrange(256) for _ in range(40))
    middles = [bytes(rng.choice(b"ab") for _ in range(30)) for _ in range(9)]
    docs = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) + head + rng.choice(middles) + end for _ in range(150)]
    docs += [head * 3 + m for m in middles] + [b"a" * 400, b"ab" * 200, b""]
    got, own = flags_of(docs)
    assert got == own and 0 < sum(own) < len(own)


def test_shifts_take_both_into_the_sample():
    sampled, shift = suffix_dedup.shifts()
    for i in range(suffix_dedup.V):
        for j in range(suffix_dedup.V):
            k = shift[i, j]
            assert k < suffix_dedup.V and sampled[(i + k) % suffix_dedup.V] and sampled[(j + k) % suffix_dedup.V]


def test_kept_bytes_and_empty_table(spark):
    rows = {r["doc_id"]: r for r in suffix_dedup.deduplicate(documents(spark, ["a" * 120, "b", None]), keep=True).collect()}
    assert bytes(rows[0]["kept"]) == b"" or len(rows[0]["kept"]) < 120
    assert bytes(rows[1]["kept"]) == b"b" and bytes(rows[2]["kept"]) == b""
    assert suffix_dedup.deduplicate(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


def test_what_repeats_within_a_block_is_found_once_and_travels_as_runs(spark):
    packed = suffix_dedup.blocks(documents(spark, ["ab" * 300, "x"]), "doc_id", "text")
    ranks = suffix_dedup.ranked(suffix_dedup.sampled(packed, 64), 1)
    marks = suffix_dedup.sorted_buckets(suffix_dedup.suffixes(packed, ranks, 64, 64, 1), 1).localCheckpoint()
    found = [np.frombuffer(r[c], np.int32) for r in marks.collect() for c in ("starts", "counts")]
    assert [x.tolist() for x in found] == [[2], [499]]
    none, all_ = (suffix_dedup.removed(packed, m, False, 1).agg({"n_removed": "sum"}).first()[0] for m in (marks.limit(0), marks))
    assert (none, all_) == (0, 598)


def test_heads_are_grouped_in_the_order_of_their_bytes():
    rng = random.Random(9)
    data = np.frombuffer(bytes(rng.choice(b"a\xffb") for _ in range(400)) + b"\0" * 200 + b"ba" * 100, np.uint8)
    at = np.arange(0, len(data) - 100)
    order, group = suffix_dedup.by_head(suffix_dedup.words_at(data), at)
    heads = [data[i : i + suffix_dedup.HEAD].tobytes() for i in at.tolist()]
    by = {}
    for i, h in enumerate(heads):
        by.setdefault(h, []).append(i)
    want = [by[h] for h in sorted(by) if len(by[h]) > 1]
    got = [sorted(order[group == g].tolist()) for g in np.unique(group)]
    assert got == want and (np.diff(group) >= 0).all()
    assert [len(x) for x in suffix_dedup.by_head(suffix_dedup.words_at(data), at[:0])] == [0, 0]


def test_sample_places_and_phases_are_those_of_each_document():
    lengths = np.array([0, 99, 100, 1, 131, 400])
    total, start, places, offsets = int(lengths.sum()), 0, [], []
    for n in lengths.tolist():
        offsets += [i % suffix_dedup.V for i in range(n)]
        places += [start + i for i in range(n - suffix_dedup.SAMPLE + 1) if n >= 100 and i % suffix_dedup.V in suffix_dedup.COVER]
        start += n
    assert suffix_dedup.sample_places(lengths).tolist() == places and suffix_dedup.phases(lengths, total).tolist() == offsets
    assert not len(suffix_dedup.sample_places(lengths[:0])) and not len(suffix_dedup.phases(lengths[:0], 0))
    assert suffix_dedup.words_at(np.arange(1, 10, dtype=np.uint8)).tolist() == [0x0102030405060708, 0x0203040506070809]
    assert not len(suffix_dedup.words_at(np.zeros(7, np.uint8))) and not len(suffix_dedup.words_at(np.zeros(0, np.uint8)))

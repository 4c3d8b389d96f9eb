"""Exact substring deduplication by difference-cover blockwise suffix sorting: one suffix bucket at a time, long ties by cover-sample ranks.

Wanted are all positions whose next ``DEPTH`` bytes start earlier too, so suffixes are ordered to that depth. Texts are packed into blocks of disjoint id ranges, once. Then:

1. Cover sample. Positions of a document with offset mod V in a difference cover D are its sample (|D| / V = 19 %). Any two positions have a shift k below V that takes
   both into the sample. Sample strings of ``SAMPLE`` = DEPTH - V + 1 bytes are ranked bucket by bucket over all blocks as single or repeated. A position without a
   repeated one in its next V - 1 bytes can't tie with any other: that settles most positions without moving their text.
2. Suffix buckets. Equal suffixes must meet, and neighbours should travel as one substring: a position's bucket is that of the least hashed 16-gram in its DEPTH bytes. One bucket
   is sorted at a time (``sorted_later``): by the first ``HEAD`` bytes, then ties against the first of their group. What is left of two tied suffixes is the bytes that the
   sample strings at their common shift k cover, [k, k + SAMPLE), and the edges before and after: different ranks of the two sample strings settle the tie without
   reading between them. Suffixes that differ from the first of their group go on to the group's next, and after ``ROUNDS`` of that to deeper bytes, so a hot prefix costs n log n.
   The first in id order stays.
3. Blocks mark what the repeated positions cover. Positions that repeat within their own block are found once, where the block is, and only their runs are moved.

A task holds one block or one bucket. Buckets grow in number with the bytes; a string is in a bucket once for each block that has it. Ranks come from 64-bit names, so what they
call equal is compared by its bytes before it counts.

Defined results: a null text counts as empty; a text under DEPTH bytes keeps all; of rows with one id the text of the smaller SHA-256 counts as
earlier; rows equal in id and text are in some order; a null id comes before all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_cut, table, text_or_empty

DEPTH, V, GRAM, HEAD, ROUNDS = 100, 31, 16, 16, 3
#: A perfect difference set modulo 31 (every residue is a difference of two of them).
COVER = (1, 5, 11, 24, 25, 27)
SAMPLE = DEPTH - V + 1
BLOCK_BYTES, BUCKET_SAMPLES, BUCKET_BYTES, LEAST_BUCKETS = 2 << 20, 1_000_000, 4 << 20, 64
BASE, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_U = np.uint64


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    both = []
    for b in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.full(n, b, np.uint64)
        x[0] = 1
        both.append(np.cumprod(x, dtype=np.uint64))
    return both[0], both[1]


class Names:
    """64-bit names of the substrings of one byte array, by position and length."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        size = 1 << max(10, (n + 1).bit_length())
        self.up, self.down = _powers(size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_letters()[data] * self.up[:n], out=self.sums[1:])

    def __call__(self, at: np.ndarray, length: int) -> np.ndarray:
        h = (self.sums[at + length] - self.sums[at]) * self.down[at]
        h ^= h >> _U(30)
        h *= _U(MIX1)
        h ^= h >> _U(27)
        h *= _U(MIX2)
        return h ^ (h >> _U(31))

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        h = (self.sums[length:] - self.sums[:n]) * self.down[:n]
        h ^= h >> _U(30)
        h *= _U(MIX1)
        return h ^ (h >> _U(29))


def sample_places(lengths: np.ndarray) -> np.ndarray:
    """The sample positions of documents that lie end to end, where a whole sample string fits."""
    residues = np.array(sorted(COVER))
    fit = np.where(lengths >= DEPTH, lengths - SAMPLE + 1, 0)
    grid = (np.arange(0, fit.max(initial=0), V)[:, None] + residues).ravel()
    counts = np.searchsorted(grid, fit)
    return np.concatenate([grid[:0], *(grid[:n] for n in counts.tolist())]) + np.repeat(np.cumsum(lengths) - lengths, counts)


def window_mask(lengths: np.ndarray, total: int) -> np.ndarray:
    """Which positions have DEPTH bytes in their document."""
    mask = np.ones(total, bool)
    ends = np.cumsum(lengths)
    for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
        mask[max(a, b - DEPTH + 1) : b] = False
    return mask


def sample_keys(names: Names, places: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 bits of each sample string: a filter, which may keep a few single strings but never loses a repeated one."""
    h = names(places, SAMPLE)
    return ((((h >> _U(32)) * _U(buckets)) >> _U(32)) << _U(32)) | (h & _U(0xFFFFFFFF))


@lru_cache(1)
def shifts() -> tuple[np.ndarray, np.ndarray]:
    """Which residues are sampled, and for two residues the least shift that takes both into the sample."""
    sampled_ = np.zeros(V, bool)
    sampled_[list(COVER)] = True
    table_ = np.full((V, V), V, np.int64)
    for k in range(V - 1, -1, -1):
        on = sampled_[(np.arange(V) + k) % V]
        table_[np.ix_(on, on)] = k
    return sampled_, table_


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as numbers that order as the bytes do."""
    n = max(0, len(data) - 7)
    wide = ceil(n / 8)
    padded = np.zeros(8 * wide + 8, np.uint8)
    padded[: len(data)] = data
    out = np.empty(8 * wide, np.uint64)
    for j in range(8):
        out[j::8] = padded[j : j + 8 * wide].view(">u8")
    return out[:n]


def cover_ranks(at: np.ndarray, phase: np.ndarray, names: Names) -> np.ndarray:
    """The rank of the sample string at each sampled position that a tie of the suffixes at can ask for; -1 elsewhere."""
    sampled_, _ = shifts()
    marks = np.zeros(len(phase) + V, np.int32)
    marks[at + V] = 1
    near = np.cumsum(marks)
    places = np.flatnonzero((near[V:] > near[:-V]) & sampled_[phase])  # of the V positions up to here one is asked for
    out = np.full(len(phase), -1, np.int32)
    out[places] = np.unique(names(places, SAMPLE), return_inverse=True)[1]
    return out


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys, and the rank of each in that order among the different ones."""
    order = np.argsort(keys)
    there = keys[order]
    return order, np.cumsum(np.r_[True, there[1:] != there[:-1]][: len(there)])


def by_head(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions at whose first HEAD bytes another one has, ordered by those bytes, and their groups. Within a group they are in any order."""

    def tied(order, group):
        more = np.bincount(group)[group] > 1
        return order[more], group[more]

    # Eight bytes at a time, as numpy sorts single numbers several times as fast as it orders by two keys.
    order, group = tied(*_grouped(words[at]))
    for j in range(8, HEAD, 8):
        below, rank = _grouped(words[at[order] + j])
        key = group << 32
        key[below] |= rank
        again, group = _grouped(key)
        order, group = tied(order[again], group)
    return order, group


def sorted_later(data: np.ndarray, at: np.ndarray, phase: np.ndarray, names: Names | None = None) -> np.ndarray:
    """Which of the positions at, in order, have DEPTH bytes that an earlier one of them has too. phase: the offset of each byte in its document modulo V."""
    flags = np.zeros(len(at), bool)
    if len(at) < 2:
        return flags
    words = words_at(data)
    order, group = by_head(words, at)
    if not len(order):
        return flags
    _, shift = shifts()
    ranks = cover_ranks(at[order], phase, names or Names(data))
    # Bytes of a tie that no sample string covers at every shift, and those that one does: ranks are of names, so the bytes decide.
    compared = [*range(HEAD, DEPTH - 7, 8), DEPTH - 8]
    for _ in range(ROUNDS):
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        first = np.repeat(np.minimum.reduceat(order, starts), np.diff(np.r_[starts, len(order)]))
        # Compared in the order of positions, as neighbours mostly tie with neighbours, so that memory is read in sequence.
        of = np.arange(len(at))
        of[order] = first
        later = np.flatnonzero(of != np.arange(len(at)))
        a, b = at[later], at[of[later]]
        k = shift[phase[a], phase[b]]
        same = np.flatnonzero(ranks[a + k] == ranks[b + k])
        for j in compared:
            same = same[words[a[same] + j] == words[b[same] + j]]
        flags[later[same]] = True
        other = (order != first) & ~flags[order]
        order, group = order[other], group[other]
        if not len(order):
            return flags
    deeper = [words[at[order] + j] for j in compared]
    again = np.lexsort([order, *deeper[::-1], group])
    equal = np.logical_and.reduce([d[again[1:]] == d[again[:-1]] for d in (group, *deeper)])
    flags[order[again[1:][equal]]] = True
    return flags


def runs(flags_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of consecutive numbers in a sorted array."""
    if not len(flags_at):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    cuts = np.flatnonzero(np.diff(flags_at) != 1) + 1
    starts = np.r_[0, cuts]
    return flags_at[starts].astype(np.int32), np.diff(np.r_[starts, len(flags_at)]).astype(np.int32)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each run."""
    counts = counts.astype(np.int64)
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def least_grams(names: Names) -> np.ndarray:
    """For each position with DEPTH bytes the least name of the 16-grams in them, by doubling."""
    m, width, want = names.all(GRAM), 1, DEPTH - GRAM + 1
    while 2 * width <= want:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    return np.minimum(m[: len(m) - (want - width)], m[want - width :]) if want > width else m


def blocks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts in blocks of disjoint id ranges, numbered in id order: block, ids, lengths, data (compressed)."""
    schema = pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])

    def pack(number: int, ids: list, texts: list) -> pa.RecordBatch:
        data = b"".join(texts)
        row = {"block": [number], "n_bytes": [len(data)], "ids": [ids], "lengths": [list(map(len, texts))], "data": [zstandard.ZstdCompressor(3).compress(data)]}
        return pa.RecordBatch.from_pydict(row, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = t.as_py() or b""
                if ids and size + len(text) > BLOCK_BYTES:
                    yield pack(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
        if ids:
            yield pack(number, ids, texts)

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.encode(text_or_empty(F.col(text_col)), "UTF-8").alias("t"))
    size = slim.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, ceil(size / (4 * BLOCK_BYTES)))
    ordered = slim.repartitionByRange(parts, "id").sortWithinPartitions("id", F.sha2("t", 256))
    return ordered.mapInArrow(run, "block long, n_bytes long, ids array<long>, lengths array<long>, data binary")


def _open(row: dict) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, row["n_bytes"])) if row["n_bytes"] else b""
    return np.frombuffer(data, np.uint8), np.array(row["lengths"], np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def sampled(packed: DataFrame, buckets: int) -> DataFrame:
    """bucket, block, keys: the different sample strings of each block, by bucket."""
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary())])

    def run(batches):
        for row in _rows(batches):
            data, lengths = _open(row)
            # Sorted and thinned here: np.unique without counts hashes, which takes eight times as long.
            keys = np.sort(sample_keys(Names(data), sample_places(lengths), buckets))
            keys = keys[np.r_[True, keys[1:] != keys[:-1]][: len(keys)]]
            of = (keys >> _U(32)).astype(np.int64)
            cuts = np.r_[0, np.flatnonzero(np.diff(of)) + 1, len(of)] if len(of) else np.zeros(1, np.int64)
            low = keys.astype(np.uint32)
            parts = [(int(of[a]), row["block"], low[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*parts, strict=True)) or [()] * 3, schema, strict=True)], schema=schema)

    return packed.select("block", "n_bytes", "lengths", "data").mapInArrow(run, "bucket long, block long, keys binary")


def ranked(samples: DataFrame, parts: int) -> DataFrame:
    """block, bucket, repeated: a bit for each key of the block's bucket, set if another block has it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(x, np.uint32) for x in pdf["keys"]]
        sizes = np.array([len(x) for x in lists])
        keys = np.concatenate(lists)
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        found = np.zeros(len(keys), bool)
        found[order] = np.r_[same, False] | np.r_[False, same]
        bits = [np.packbits(x).tobytes() for x in np.split(found, np.cumsum(sizes)[:-1])]
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "repeated": bits})

    return samples.repartition(parts, "bucket").groupBy("bucket").applyInPandas(run, "block long, bucket long, repeated binary")


def phases(lengths: np.ndarray, total: int) -> np.ndarray:
    """The offset of each position in its document modulo V."""
    long = np.resize(np.arange(V, dtype=np.int8), lengths.max(initial=0))
    return np.concatenate([long[:0], *(long[:n] for n in lengths.tolist())], out=np.empty(total, np.int8))


def own_repeats(data: np.ndarray, lengths: np.ndarray, repeated: Elsewhere, names: Names, phase: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block's positions that can tie, and which of them repeat an earlier one of the block. repeated tells which sample keys other blocks have."""
    places = sample_places(lengths)
    keys, inverse, counts = np.unique(sample_keys(names, places, repeated.buckets), return_inverse=True, return_counts=True)
    hits = np.zeros(len(data) + 1, np.int32)
    hits[places[(repeated(keys) | (counts > 1))[inverse]] + 1] = 1
    hits = np.cumsum(hits)
    n = len(data) - DEPTH + 1
    left = np.flatnonzero(window_mask(lengths, len(data))[:n] & (hits[V : V + n] > hits[:n]))
    return left, sorted_later(data, left, phase, names)


class Elsewhere:
    """Which sample keys of a block other blocks have too, from the bits of its buckets."""

    def __init__(self, rows, buckets: int):
        self.rows, self.buckets = rows or (), buckets

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        of, bits = (keys >> _U(32)).astype(np.int64), np.zeros(len(keys), bool)
        for r in self.rows:
            a, b = np.searchsorted(of, [r["bucket"], r["bucket"] + 1])
            bits[a:b] = np.unpackbits(np.frombuffer(r["repeated"], np.uint8), count=b - a)
        return bits


def suffixes(packed: DataFrame, ranks: DataFrame, buckets: int, suffix_buckets: int, tasks: int) -> DataFrame:
    """bucket, block, starts, counts, phases, text: the runs of positions that other blocks may repeat, by suffix bucket; without a text, in any bucket, those that repeat their own block."""
    schema = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("starts", pa.binary()), ("counts", pa.binary()), ("phases", pa.binary()), ("text", pa.binary())])

    def block(row: dict) -> Iterator[tuple]:
        data, lengths = _open(row)
        if len(data) < DEPTH:
            return
        names, phase = Names(data), phases(lengths, len(data))
        left, again = own_repeats(data, lengths, Elsewhere(row["ranks"], buckets), names, phase)
        if again.any():
            starts, sizes = runs(left[again])
            yield (row["block"] * MIX2 % (1 << 64) >> 32) * suffix_buckets >> 32, row["block"], starts.tobytes(), sizes.tobytes(), None, None
        left = left[~again]
        if not len(left):
            return
        least = least_grams(names)[left]
        cuts = np.flatnonzero((np.diff(left) != 1) | (least[1:] != least[:-1])) + 1
        first = np.r_[0, cuts]
        starts, sizes = left[first], np.diff(np.r_[first, len(left)])
        mixed = least[first] * _U(MIX2)
        bucket = ((mixed >> _U(32)) * _U(suffix_buckets) >> _U(32)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bucket, starts, sizes = bucket[order], starts[order], sizes[order]
        ends = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
        pack = zstandard.ZstdCompressor(1)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            text = data[spread(starts[a:b], sizes[a:b] + DEPTH - 1)].tobytes()
            yield int(bucket[a]), row["block"], starts[a:b].astype(np.int32).tobytes(), sizes[a:b].astype(np.int32).tobytes(), phase[starts[a:b]].tobytes(), pack.compress(text)

    def run(batches):
        for row in _rows(batches):
            parts = list(block(row))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*parts, strict=True)) or [()] * 6, schema, strict=True)], schema=schema)

    both = _with(packed, ranks, "ranks", tasks, "bucket", "repeated").select("block", "n_bytes", "lengths", "data", "ranks")
    return both.mapInArrow(run, "bucket long, block long, starts binary, counts binary, phases binary, text binary")


def _with(packed: DataFrame, rows: DataFrame, name: str, tasks: int, *columns: str) -> DataFrame:
    """The blocks, each with the list of its rows; both sides are dealt out by block, in as many parts as the bytes ask for."""
    lists = rows.select(F.col("block").alias("of"), *columns).repartition(tasks, "of").groupBy("of").agg(F.collect_list(F.struct(*columns)).alias(name))
    here = packed.repartition(tasks, "block")
    return here.join(lists.hint("merge"), here["block"] == lists["of"], "left")


def sorted_buckets(parts: DataFrame, tasks: int) -> DataFrame:
    """block, starts, counts: runs of the positions of each block whose DEPTH bytes start earlier."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        settled = pdf["text"].isna()
        own, pdf = pdf.loc[settled, ["block", "starts", "counts"]], pdf[~settled].sort_values("block", kind="stable")
        if len(pdf) < 2:
            return own
        inflate = zstandard.ZstdDecompressor()
        starts = [np.frombuffer(x, np.int32) for x in pdf["starts"]]
        counts = [np.frombuffer(x, np.int32) for x in pdf["counts"]]
        texts = [inflate.decompress(x, max_output_size=int(c.sum()) + len(c) * (DEPTH - 1)) for x, c in zip(pdf["text"], counts, strict=True)]
        data, sizes = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(counts).astype(np.int64)
        ends = np.cumsum(sizes + DEPTH - 1)
        at = spread(ends - (sizes + DEPTH - 1), sizes)
        of_run = np.concatenate([np.frombuffer(x, np.int8) for x in pdf["phases"]]).astype(np.int64)
        flags = sorted_later(data, at, (spread(of_run, sizes + DEPTH - 1) % V).astype(np.int8))
        rows, i = [], 0
        for number, s, c in zip(pdf["block"], starts, counts, strict=True):
            n = int(c.sum())
            mine = np.sort(spread(s.astype(np.int64), c)[flags[i : i + n]])
            i += n
            if len(mine):
                a, b = runs(mine)
                rows.append((number, a.tobytes(), b.tobytes()))
        return pd.concat([own, pd.DataFrame(rows, columns=own.columns)]) if rows else own

    return parts.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(run, "block long, starts binary, counts binary")


def removed(packed: DataFrame, marks: DataFrame, keep: bool, tasks: int) -> DataFrame:
    fields = [("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.binary())] * keep)

    def block(row: dict) -> list[tuple]:
        data, lengths = _open(row)
        change = np.zeros(len(data) + 1, np.int32)
        found = [(np.frombuffer(m["starts"], np.int32), np.frombuffer(m["counts"], np.int32)) for m in row["marks"] or ()]
        for s, c in found:
            np.add.at(change, s, 1)
            np.add.at(change, s + c + (DEPTH - 1), -1)
        gone = np.cumsum(change[:-1]) > 0
        out, at = [], 0
        for i, n in zip(row["ids"], lengths.tolist(), strict=True):
            own = gone[at : at + n]
            spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(n > 0 and own[0])
            kept = data[at : at + n][~own].tobytes() if spans else data[at : at + n].tobytes()
            out.append((i, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), *[kept] * keep))
            at += n
        return out

    def run(batches):
        for row in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block(row), strict=True), schema, strict=True)], schema=schema)

    both = _with(packed, marks, "marks", tasks, "starts", "counts").select("block", "n_bytes", "ids", "lengths", "data", "marks")
    return both.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)


def _release(spark) -> None:
    """Lets Spark delete the shuffle files of steps whose results are written."""
    gc.collect()
    spark._jvm.System.gc()


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per row of df: id, n_bytes, n_removed, n_spans, kept_sha256; with keep also the bytes that stay."""
    spark = df.sparkSession
    packed = cut(blocks(df, id_col, text_col))
    _release(spark)
    total = packed.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, ceil(total * len(COVER) / V / BUCKET_SAMPLES))
    # Tasks in proportion to the bytes, each for some 16 MB of them.
    tasks = ceil(total / (4 * BUCKET_BYTES)) + 1
    ranks = cut(ranked(sampled(packed, buckets), tasks))
    _release(spark)
    marks = cut(sorted_buckets(suffixes(packed, ranks, buckets, max(LEAST_BUCKETS, ceil(total / BUCKET_BYTES)), tasks), tasks))
    drop_cut(ranks)
    _release(spark)
    return removed(packed, marks, keep, tasks).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))

"""Exact Jaccard join of word n-grams by a token-group matrix, closed to components.

A document's set is that of its distinct shingles, as hashes (tokens). Documents of equal sets are one set from then on. Tokens are counted over all documents in columns: a block of about a million
tokens sends each range of tokens (bucket) its own tokens once with the places of their documents, a bucket counts what its blocks sent, and sends back only tokens that several documents
hold. A set keeps those, rarest first. Two sets at 0.8 share one of the first n - ceil(0.8 n) + 1 tokens of each in any order that is the same for all; what a set alone holds comes first and matches nothing, so
most sets have nothing left to look for and are done.

The others are put in groups of similar sets: those of one least mixed token first, which are searched within pieces of a group (exactly, and each piece with one
centre common to the group), then those of one component. A group's row of the matrix is the union of its sets' tokens. A set meets another component's group if one of its first tokens is
among the first of the group's sets and their sizes allow it. The overlap of the set with the group's union bounds that with each of its sets: only if it reaches ceil(0.8 n) the group
is opened, and its sets are compared in full. Groups of the set's own component are never met, so a group of many near copies costs what its members hold and not their pairs, and no link between
components is lost. No token, bucket, group or list of candidates is held whole: hot tokens are counted by block first, groups and the sets that meet them are dealt out in pieces.

Tokens are the upper 48 bits, and one more for each doubling of the buckets, of a 64-bit hash: two different shingles of one pair of documents agree with a chance of about 1 in 10^11.

Defined results: a null or empty text has no words and is linked with nothing; of fewer words than n the whole sequence is the one shingle; rows that repeat are copies; a null id is never a component's id unless the component
has no other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, drop_cut, table
from tessera.llm.graph import components

N, PERCENT, SEED, ROUNDS = 5, 80, 42, 2
#: Tokens and documents of a block, bytes of text for each bucket, sets of a searched piece, of a group, and sets that meet a group in one task.
BLOCK, BLOCK_DOCS, BUCKET_BYTES, PIECE, GROUP, MEET = 1 << 20, 60_000, 1 << 24, 256, 64, 1024
_U8 = np.dtype("<u8")
_MIX = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93)]
_SENT = {"to": "long", "block": "long", "one": "binary", "place": "binary", "many": "binary", "times": "binary", "ids": "array<long>", "n": "array<int>", "digest": "array<binary>", "start": "binary", "places": "binary"}


def least_overlap(n, percent: int):
    """The least overlap of a set of n with one at the similarity: ceil(percent n / 100)."""
    return -(-percent * n // 100)


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """The sorted different hashes of a text's shingles; words lie between blanks and 09-0D, and A-Z are lower-cased."""
    words = text.lower().split()
    parts = [b" ".join(words)] if 0 < len(words) < n else list(map(b" ".join, zip(*(words[i:] for i in range(n)))))
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(p, SEED) for p in parts), _U8, len(parts)))


def pack(tokens: np.ndarray) -> bytes:
    """The lower six bytes of each token."""
    return np.ascontiguousarray(tokens.astype(_U8).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(_U8).ravel()


def block_rows(block: int, ids: list, sets: list[np.ndarray], bits: int):
    """What a block sends: for each bucket its tokens, those of one document with its place, the others with their count; and to itself the documents and the places of the others."""
    width = min(64, 48 + bits)
    flat = (np.concatenate(sets) if sets else np.empty(0, _U8)) >> np.uint64(64 - width)
    doc = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, np.int64)
    times = np.diff(np.r_[first, len(flat)])
    kinds = flat[first]
    ends = np.searchsorted((kinds >> np.uint64(width - bits)).astype(np.int64), np.arange((1 << bits) + 1))
    for bucket, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        if a < b:
            lone = times[a:b] == 1
            yield {"to": bucket, "block": block, "one": pack(kinds[a:b][lone]), "place": doc[first[a:b][lone]].tobytes(), "many": pack(kinds[a:b][~lone]), "times": times[a:b][~lone].astype("<u4").tobytes()}
    start = np.r_[0, np.cumsum(times[times > 1])].astype("<u4")
    yield {
        "to": -1 - block, "block": block, "ids": ids, "n": [len(s) for s in sets], "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
        "start": start.tobytes(), "places": doc[np.repeat(times > 1, times)].tobytes(),
    }


def sent(df: DataFrame, id_col: str, text_col: str, n: int, bits: int) -> DataFrame:
    """The rows of all blocks; a block is part of a task's rows."""
    shape = pa.schema([("to", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in ("one", "place", "many", "times")), ("ids", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("digest", pa.list_(pa.binary())), ("start", pa.binary()), ("places", pa.binary())])

    def run(batches):
        block, ids, sets, held = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                sets.append(shingle_hashes(text or b"", n))
                held += len(sets[-1])
                if held >= BLOCK or len(sets) >= BLOCK_DOCS:
                    yield pa.RecordBatch.from_pylist(list(block_rows(block, ids, sets, bits)), schema=shape)
                    block, ids, sets, held = block + 1, [], [], 0
        if sets:
            yield pa.RecordBatch.from_pylist(list(block_rows(block, ids, sets, bits)), schema=shape)

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("t"))
    return slim.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in _SENT.items()))


def rarity(count: np.ndarray) -> np.ndarray:
    """A count's class: quarters of its binary logarithm."""
    return np.round(4 * np.log2(count)).astype(np.uint8)


def counted(group: pa.Table) -> pa.Table:
    """Of a bucket's rows, for each block: the tokens that several documents hold, with their class. What a block sent itself goes on as it is."""
    if group.column("to")[0].as_py() < 0:
        return group
    rows = group.select(["to", "block", "one", "place", "many", "times"]).to_pylist()
    ones, manys = [unpack(r["one"]) for r in rows], [unpack(r["many"]) for r in rows]
    weight = np.concatenate([np.ones(sum(map(len, ones)), np.int64), *(np.frombuffer(r["times"], "<u4") for r in rows)])
    kinds, at = np.unique(np.concatenate(ones + manys), return_inverse=True)
    count = np.bincount(at, weights=weight, minlength=len(kinds)).astype(np.int64)[at]
    ends = np.cumsum([len(x) for x in ones + manys])
    out = []
    for k, r in enumerate(rows):
        here, there = count[ends[k] - len(ones[k]) : ends[k]], count[ends[k + len(rows)] - len(manys[k]) : ends[k + len(rows)]]
        kept = here > 1
        if kept.any() or len(there):
            out.append(r | {"one": pack(ones[k][kept]), "place": np.frombuffer(r["place"], np.uint16)[kept].tobytes(), "times": rarity(here[kept]).tobytes(), "start": rarity(there).tobytes()})
    return pa.Table.from_pylist(out, schema=group.schema)


def assembled(bits: int, percent: int, group: pa.Table) -> pa.Table:
    """The sets of a block: id, n, digest, and of those that may be linked the shared tokens, rarest first, and how many of them come first."""
    shift = np.uint64(min(64, 48 + bits) - bits)
    rows = sorted(group.to_pylist(), key=lambda r: r["to"])
    own, rows = rows[0], rows[1:]
    base = [np.uint64(r["to"]) << shift for r in rows]
    start = np.frombuffer(own["start"], "<u4").astype(np.int64)
    none = np.empty(0, _U8)
    many = np.concatenate([none, *(unpack(r["many"]) | b for r, b in zip(rows, base, strict=True))])
    many_class = np.frombuffer(b"".join(r["start"] for r in rows), np.uint8)
    times = np.diff(start)
    tokens = np.concatenate([none, *(unpack(r["one"]) | b for r, b in zip(rows, base, strict=True)), np.repeat(many, times)])
    place = np.frombuffer(b"".join(r["place"] for r in rows) + own["places"], np.uint16)
    classes = np.concatenate([np.frombuffer(b"".join(r["times"] for r in rows), np.uint8), np.repeat(many_class, times)])
    order = np.lexsort((tokens, classes, place))
    tokens, place = tokens[order], place[order]
    ends = np.searchsorted(place, np.arange(len(own["ids"]) + 1)).tolist()
    first, lists = [], []
    for k, n in enumerate(own["n"]):
        a, b = ends[k], ends[k + 1]
        first.append(max(0, n - least_overlap(n, percent) + 1 - (n - (b - a))) if n else 0)
        lists.append(tokens[a:b].tobytes() if first[-1] else None)
    return pa.table({"id": pa.array(own["ids"], pa.int64()), "n": pa.array(own["n"], pa.int32()), "digest": pa.array(own["digest"], pa.binary()), "first": pa.array(first, pa.int32()), "tokens": pa.array(lists, pa.binary())})


def token_sets(df: DataFrame, id_col: str, text_col: str, n: int = N, percent: int = PERCENT) -> DataFrame:
    """One row per row of df: id, n, digest, first and tokens, as ``assembled`` says."""
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = min(22, max(5, ceil(log2(max(1, size / BUCKET_BYTES)))))
    rows = sent(df, id_col, text_col, n, bits).groupBy("to").applyInArrow(counted, ", ".join(f"{c} {t}" for c, t in _SENT.items()))
    return rows.groupBy("block").applyInArrow(lambda g: assembled(bits, percent, g), "id long, n int, digest binary, first int, tokens binary")


class Sets:
    """Token sets side by side, with their tokens numbered; overlaps of all of them with one are a sum over marked tokens."""

    def __init__(self, sizes: np.ndarray, tokens: list[bytes]):
        lists = [np.frombuffer(t, _U8) for t in tokens]
        self.sizes, self.start = sizes.astype(np.int64), np.r_[0, np.cumsum([len(x) for x in lists])]
        self.union, self.flat = np.unique(np.concatenate(lists), return_inverse=True)
        self.mark = np.zeros(len(self.union), np.int64)

    def linked(self, at: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Whether each set is at the similarity with a set of a size that holds the union's tokens ``at``."""
        self.mark[at] = 1
        overlap = np.add.reduceat(self.mark[self.flat], self.start[:-1])
        self.mark[at] = 0
        return 100 * overlap >= percent * (self.sizes + size - overlap)

    def forest(self, percent: int) -> list[tuple[int, int]]:
        """Links whose closure is that of all linked pairs, searched from each set reached among those that aren't yet."""
        out, left = [], np.ones(len(self.sizes), bool)
        for seed in range(len(self.sizes)):
            if not left[seed]:
                continue
            left[seed], reached = False, [seed]
            while reached and left.any():
                i = reached.pop()
                found = np.flatnonzero(self.linked(self.flat[self.start[i] : self.start[i + 1]], int(self.sizes[i]), percent) & left).tolist()
                out += [(i, j) for j in found]
                left[found] = False
                reached += found
        return out


def mixed_least(tokens: bytes, which: int) -> int:
    x = np.frombuffer(tokens, _U8) * _MIX[which]
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return int((x ^ (x >> np.uint64(29))).min().view(np.int64))


@F.pandas_udf(T.ArrayType(T.LongType()))
def group_keys(tokens):
    return tokens.map(lambda t: [mixed_least(t, k) for k in range(ROUNDS)])


@F.pandas_udf(T.ArrayType(T.LongType()))
def first_tokens(tokens, first):
    import pandas as pd

    return pd.Series([np.frombuffer(t, np.int64)[:k] for t, k in zip(tokens, first, strict=True)])


_LINK = "u binary, v binary"


def _links(u: list, v: list) -> pa.Table:
    return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})


def near_links(sets: DataFrame, percent: int, piece: int = PIECE) -> DataFrame:
    """Links among sets (digest, n, tokens, keys) that share a key: all of a piece are searched, and each piece of a larger group holds the group's centre too."""
    each = sets.select("digest", "n", "tokens", F.posexplode("keys").alias("round", "key"))
    sizes = cut(each.groupBy("round", "key").agg(F.count(F.lit(1)).alias("m"), F.min("digest").alias("centre")).filter("m > 1"))
    of = F.ceil(F.col("m") / piece)
    own = F.when(F.col("digest") == F.col("centre"), F.sequence(F.lit(0).cast("long"), of - 1)).otherwise(F.array(F.pmod(F.xxhash64("digest"), of)))
    dealt = each.join(sizes.hint("merge"), ["round", "key"]).select("round", "key", "digest", "n", "tokens", F.explode(own).alias("piece"))

    def search(group: pa.Table) -> pa.Table:
        names = group.column("digest").to_pylist()
        found = Sets(group.column("n").to_numpy(), group.column("tokens").to_pylist()).forest(percent)
        return _links([max(names[i], names[j]) for i, j in found], [min(names[i], names[j]) for i, j in found])

    return dealt.groupBy("round", "key", "piece").applyInArrow(search, _LINK).distinct()


def candidates(sets: DataFrame, percent: int) -> DataFrame:
    """digest, gid: the sets (digest, n, tokens, first, root, gid) that meet a group of another component, from the smaller root's side.

    A set and a member meet in the first token that both hold, so their overlap is at most what either has from there on (rest), and must be percent (n + m) / (100 + percent) of their sizes."""
    each = sets.select("digest", "n", "root", "gid", F.octet_length("tokens").alias("bytes"), F.posexplode(first_tokens("tokens", "first")).alias("at", "token"))
    each = cut(each.select("digest", "n", "root", "gid", "token", (F.col("bytes") / 8 - F.col("at")).cast("int").alias("rest")))
    bounds = [F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest")]

    def may(a: dict, b: dict):
        """Whether sets of sizes from lo to hi and of so much rest may be at the similarity."""
        return (
            (a["hi"] * 100 >= b["lo"] * percent) & (b["hi"] * 100 >= a["lo"] * percent)
            & (F.least(a["rest"], b["rest"]) * (100 + percent) >= (a["lo"] + b["lo"]) * percent)
        )

    held = cut(each.groupBy("token", "root").agg(*bounds))
    open_ = held.groupBy("token").agg(F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("token")
    held = held.join(open_, "token")
    a, b = ({c: F.col(f"{side}_{c}") for c in ("root", "lo", "hi", "rest")} for side in "ab")
    one, two = (held.select("token", *(F.col(c).alias(f"{side}_{c}") for c in ("root", "lo", "hi", "rest"))) for side in "ab")
    pairs = one.join(two, "token").filter((a["root"] < b["root"]) & may(a, b)).select("token", "a_root", "b_root")
    rows = each.groupBy("token", F.col("root").alias("b_root"), "gid").agg(*bounds)
    asking = each.select("token", F.col("root").alias("a_root"), "digest", "n", F.col("rest").alias("own_rest"))
    met = pairs.join(rows, ["token", "b_root"]).join(asking, ["token", "a_root"])
    own = {"lo": F.col("n"), "hi": F.col("n"), "rest": F.col("own_rest")}
    return met.filter(may(own, {c: F.col(c) for c in ("lo", "hi", "rest")})).select("digest", "gid").distinct()


def opened_links(sets: DataFrame, met: DataFrame, percent: int, meet: int = MEET) -> DataFrame:
    """Links of the sets with members of the groups that they meet, where the overlap with the group's union allows one."""
    parts = cut(met.groupBy("gid").agg(F.ceil(F.count(F.lit(1)) / meet).alias("of")))
    asked = sets.select(F.col("digest").alias("asks"), F.col("n").alias("size"), F.col("tokens").alias("holds"), F.col("root").alias("of_root"))
    asking = met.join(parts, "gid").select(F.col("gid").alias("at"), F.pmod(F.xxhash64("digest"), "of").alias("in"), F.col("digest").alias("asks")).join(asked, "asks")
    members = sets.join(parts, "gid").select("gid", "digest", "n", "tokens", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("part"))

    def open_group(mine: pa.Table, others: pa.Table) -> pa.Table:
        if not len(mine) or not len(others):
            return _links([], [])
        group, names, roots = Sets(mine.column("n").to_numpy(), mine.column("tokens").to_pylist()), mine.column("digest").to_pylist(), mine.column("root").to_pylist()
        u, v = [], []
        for row in others.select(["asks", "size", "holds", "of_root"]).to_pylist():
            asked = np.frombuffer(row["holds"], _U8)
            at = np.minimum(np.searchsorted(group.union, asked), len(group.union) - 1)
            at = at[group.union[at] == asked]
            if len(at) >= least_overlap(row["size"], percent):
                for j in np.flatnonzero(group.linked(at, row["size"], percent)).tolist():
                    if roots[j] != row["of_root"]:
                        u.append(max(row["asks"], names[j]))
                        v.append(min(row["asks"], names[j]))
        return _links(u, v)

    return members.groupBy("gid", "part").cogroup(asking.groupBy("at", "in")).applyInArrow(open_group, _LINK).distinct()


def rooted(sets: DataFrame, links: DataFrame) -> DataFrame:
    """sets with root: the least digest of their component."""
    roots = components(links)
    return sets.join(roots, sets["digest"] == roots["node"], "left").select(*sets.columns, F.coalesce("root", "digest").alias("root"))


def grouped(sets: DataFrame, group: int = GROUP) -> DataFrame:
    """sets (with root and keys) with gid: groups of up to some ``group`` sets of one component, or of one key where components are of one set."""
    sizes = cut(sets.groupBy("root").agg(F.count(F.lit(1)).alias("m")))
    many = sets.join(sizes.filter("m > 1").hint("merge"), "root", "left")
    many = many.withColumn("of", F.coalesce(F.ceil(F.col("m") / group), F.lit(0)))
    alone = F.col("keys")[0]
    lone = cut(many.filter("of = 0").groupBy(alone.alias("key")).agg(F.ceil(F.count(F.lit(1)) / group).alias("parts")))
    many = many.withColumn("key", F.when(F.col("of") == 0, alone)).join(lone.hint("merge"), "key", "left")
    piece = F.pmod(F.xxhash64("digest"), F.coalesce("parts", "of"))
    gid = F.when(F.col("of") == 0, F.xxhash64("key", piece)).otherwise(F.xxhash64("root", piece))
    return many.select(*sets.columns, gid.alias("gid"))


def set_roots(sets: DataFrame, percent: int = PERCENT, piece: int = PIECE, group: int = GROUP, meet: int = MEET) -> DataFrame:
    """node, root: the components over all linked pairs of sets (digest, n, tokens, first), for the nodes of any link."""
    sets = cut(sets.withColumn("keys", group_keys("tokens")))
    links = cut(near_links(sets, percent, piece))
    sets = cut(grouped(cut(rooted(sets, links)), group))
    met = cut(candidates(sets, percent))
    more = cut(opened_links(sets, met, percent, meet))
    return components(links if more.isEmpty() else links.union(more))


def cluster(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, percent: int = PERCENT, **sizes) -> DataFrame:
    """One row per row of df: id, n_shingles and component_id, the least id of its component of documents linked at percent / 100."""
    rows = cut(token_sets(df, id_col, text_col, n, percent))
    sets = rows.filter("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("tokens").alias("tokens"))
    sets = cut(sets)
    roots = set_roots(sets.filter("first > 0").select("digest", "n", "first", "tokens"), percent, **sizes)
    # Only sets of several rows or with a link have another component than a row's own id.
    named = sets.select("digest", "least", "rows").join(roots, F.col("digest") == F.col("node"), "left").filter("rows > 1 OR root IS NOT NULL")
    named = named.select("digest", "least", F.coalesce("root", "digest").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    named = cut(named.join(least, "root").select(F.xxhash64("digest").alias("_key"), F.col("digest").alias("_of"), "component"))
    drop_cut(sets)
    # A key of their own makes Spark deal out both sides, so that it can split what a hot group of copies fills.
    here = rows.select("id", "n", "digest", F.xxhash64("digest").alias("_key"))
    both = here.join(named, (here["_key"] == named["_key"]) & (here["digest"] == named["_of"]), "left")
    alone = F.col("_of").isNull() | (F.col("n") == 0)
    return both.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))

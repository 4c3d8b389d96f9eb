"""SimHash near-duplicates: pigeonhole blocks find candidates, the Hamming distance is verified, components are closed.

A fingerprint's 64 bits fall into four blocks of 16. Two fingerprints that differ in at most two bits agree on at least two of
the four blocks, so they share one of six 32-bit keys; they are joined on these and then compared. Work is done on
different fingerprints only, never on the documents that share one. A key that more than ``HOT`` fingerprints share isn't joined with itself: there each
fingerprint is linked to the 33 points at distance 0 or 1 in its other 32 bits. Two of them differ in at most two bits just
if they meet in such a point, so linking all that meet there to the least one keeps every link without listing pairs.

``deduplicate`` takes a similarity instead of a distance. Texts whose shingle sets have the Jaccard index s lie at an angle with the cosine 2 s / (1 + s)
and differ in acos(2 s / (1 + s)) / pi of a fingerprint's bits, 15 % at 0.8, which 64 bits can't block. It therefore widens the fingerprint to 2048 bits, and keys are again
pairs of blocks: 12 bits each up to a million fingerprints, half a bit more for each doubling beyond, so that few unrelated texts meet, and as many keys (167 at 24 bits) as
bring a pair at the similarity together with a chance of 0.96. Candidates are verified by the distance of the wide fingerprints. Work stays linear in the members of keys:
see ``similar_roots``.

Defined results: a null or empty text has no words and the fingerprint zero, which links like any other; rows that
repeat are nodes of their own with equal fingerprints; a null id counts as larger than any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, repeat
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import cut, drop_cut, table, text_or_empty
from tessera.llm.graph import components

SEED, BITS, HOT, WIDE, PIECE = 42, 2, 64, 32, 2048
#: The chance that a pair at the similarity shares no key, and the most differing bits of 64 that a candidate may have.
MISSED, LOOSE = 0.04, 22
#: How many keys' stars are closed before the others.
FIRST = 16
_MIX = np.random.default_rng(SEED).integers(0, 1 << 63, WIDE, dtype=np.uint64)
_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingles(words: list[bytes], n: int) -> list[bytes]:
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(n)))))


def fingerprints(texts: list[bytes], n: int = 3) -> np.ndarray:
    """The signed 64-bit fingerprints of texts in UTF-8; bit k is 1 if over half of the shingles' hashes have it."""
    out = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        parts = shingles(text.lower().split(), n)  # of bytes: A-Z only, and white space is 20, 09-0D
        if not parts:
            continue
        h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
        if len(parts) < 64:
            ones = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0).astype(np.int64)
        else:
            octets = h.view(np.uint8).reshape(-1, 8)
            ones = np.concatenate([np.bincount(octets[:, b], minlength=256) @ _BYTE_BITS for b in range(8)])
        out[i] = np.packbits(2 * ones > len(parts), bitorder="little").view("<i8")[0]
    return out


def fingerprinted(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    def run(batches):
        for b in batches:
            texts = [x or b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fingerprints(texts, n), pa.int64())], names=["id", "x", "f"])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("t"), _text_hash(F.col(text_col)).alias("x"))
    return slim.mapInArrow(run, "id long, x long, f long")


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text_or_empty(text))


def key_masks() -> list[int]:
    """The bits of each pair of blocks, as signed 64-bit numbers."""
    masks = [sum(0xFFFF << (16 * b) for b in pair) for pair in combinations(range(4), 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _signed(bit: int) -> int:
    return 1 << bit if bit < 63 else -(1 << 63)


def links(prints: DataFrame, bits: int = BITS, hot: int = HOT) -> DataFrame:
    """Links u, v whose closure is that of all pairs of different fingerprints (column f) at distance of at most ``bits``."""
    if bits != 2:
        raise ValueError("blocks and points are laid out for two bits")
    keyed = prints.select("f", F.posexplode(F.array(*[F.col("f").bitwiseAND(F.lit(m)) for m in key_masks()])).alias("k", "part"))
    sizes = cut(keyed.groupBy("k", "part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    few = keyed.join(sizes.filter(F.col("n") <= hot).drop("n"), ["k", "part"])
    a, b = few.select("k", "part", F.col("f").alias("v")), few.select("k", "part", F.col("f").alias("u"))
    near = a.join(b, ["k", "part"]).filter((F.col("v") < F.col("u")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits))
    many = keyed.join(sizes.filter(F.col("n") > hot).drop("n"), ["k", "part"])
    flips = {k: [0, *(_signed(i) for i in range(64) if not (m >> i) & 1)] for k, m in enumerate(key_masks())}
    arrays = F.create_map(*[x for k, v in flips.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    points = many.select("f", F.explode(arrays[F.col("k")]).alias("flip")).select("f", F.col("f").bitwiseXOR(F.col("flip")).alias("point"))
    stars = points.join(points.groupBy("point").agg(F.min("f").alias("m"), F.max("f").alias("x")).filter("m <> x").select("point", "m"), "point")
    return near.select("u", "v").union(stars.filter("f <> m").select(F.col("f").alias("u"), F.col("m").alias("v")))


def _clustered(df: DataFrame, id_col: str, text_col: str, n: int, hot: int) -> DataFrame:
    """id, x (the text's hash), f, root (the component's fingerprint) and component_id for each row of df."""
    rows = cut(fingerprinted(df, id_col, text_col, n))
    prints = cut(rows.groupBy("f").agg(F.min("id").alias("least")))
    return _rooted(rows, prints, components(links(prints.select("f"), hot=hot)))


def _rooted(rows: DataFrame, prints: DataFrame, roots: DataFrame) -> DataFrame:
    rooted = prints.join(roots, prints["f"] == roots["node"], "left").select("f", "least", F.coalesce("root", "f").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(rooted.join(least, "root").select("f", "root", "component_id"))
    return rows.join(named, "f", "left")


def vertical_counts(x: np.ndarray) -> np.ndarray:
    """How many of the rows (n, words) of 64-bit numbers have each bit: rows are added in halves, as numbers spread over planes of bits."""
    planes = [x]
    while len(planes[0]) > 1:
        half, rest = divmod(len(planes[0]), 2)
        out, carry = [], None
        for p in planes:
            a, b = p[:half], p[half : 2 * half]
            s = a ^ b
            out.append(s if carry is None else s ^ carry)
            carry = a & b if carry is None else (a & b) | (s & carry)
        out.append(carry)
        if rest:
            none = np.zeros_like(x[:1])
            out = [np.concatenate([o, planes[i][-1:] if i < len(planes) else none]) for i, o in enumerate(out)]
        planes = out
    bits = [np.unpackbits(p[0].astype("<u8").view(np.uint8), bitorder="little").astype(np.int64) << i for i, p in enumerate(planes)]
    return np.sum(bits, axis=0)


def wide_fingerprint(text: bytes, n: int) -> bytes:
    """2048 bits from the hashes of the shingles, each mixed with as many constants as there are words."""
    parts = shingles(text.lower().split(), n)
    if not parts:
        return bytes(WIDE * 8)
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(parts))
    total = np.zeros(WIDE * 64, np.int64)
    for at in range(0, len(h), 8192):
        x = h[at : at + 8192, None] ^ _MIX
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
        total += vertical_counts(x)
    return np.packbits(2 * total > len(parts), bitorder="little").tobytes()


def share_of_bits(similarity: float) -> float:
    """The share of bits in which the fingerprints of two texts of a similarity are expected to differ."""
    return acos(2 * similarity / (1 + similarity)) / pi


def most_bits(similarity: float) -> int:
    """The differing bits of wide fingerprints at a similarity, and one and a half standard deviations more."""
    share = share_of_bits(similarity)
    return round(WIDE * 64 * share + 1.5 * sqrt(WIDE * 64 * share * (1 - share)))


def layout(n: int, similarity: float) -> tuple[int, list[tuple[int, int]]]:
    """The bits of a block, and the pairs of blocks that make a key, for n fingerprints. A key has 16 values or more for each fingerprint, and there are
    as many keys as leave a pair at the similarity a chance of ``MISSED`` to share none."""
    bits = max(12, ceil((log2(max(n, 2)) + 4) / 2))
    blocks = WIDE * 64 // bits
    keys = ceil(log(MISSED) / log(1 - (1 - share_of_bits(similarity)) ** (2 * bits)))
    if keys > blocks * ((blocks - 1) // 2):
        raise ValueError(f"{WIDE * 64} bits are too few for {keys} keys of {2 * bits}")
    return bits, [(j % blocks, (j + (blocks - 1) // 2 - j // blocks) % blocks) for j in range(keys)]


def wide_keys(wide: np.ndarray, bits: int, pairs: list[tuple[int, int]]) -> np.ndarray:
    """(n, keys): the values of each pair of blocks with the pair's number, for fingerprints (n, bytes)."""
    blocks = WIDE * 64 // bits
    each = np.unpackbits(wide, axis=1, bitorder="little")[:, : blocks * bits].reshape(len(wide), blocks, bits)
    value = each @ (1 << np.arange(bits, dtype=np.int64))
    one, two = (np.array(x) for x in zip(*pairs, strict=True))
    return (value[:, one] << (bits + 16)) | (value[:, two] << 16) | np.arange(len(pairs))


def keyed(prints: DataFrame, bits: int, pairs: list[tuple[int, int]]) -> DataFrame:
    """key, f, s for each key of each fingerprint; s: its first 64 bits."""

    def run(batches):
        for b in batches:
            wide = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, WIDE * 8)
            keys = wide_keys(wide, bits, pairs)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, len(pairs), np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(wide[:, :8].copy().view(np.int64).ravel()), lists], names=["f", "s", "keys"])

    return prints.select("f", "wide").mapInArrow(run, "f long, s long, keys array<long>").select(F.explode("keys").alias("key"), "f", "s")


def close_links(prints: np.ndarray, roots: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs of components that close the rows (n, words) over all pairs that differ in at most ``most`` bits: a forest over the components, roots, that
    the rows have already. It is searched from each row reached among those of other components, so rows of one component aren't compared."""
    out, left = [], np.arange(len(prints))
    while len(left):
        mine = roots[left] == roots[left[0]]
        reached, left = left[mine].tolist(), left[~mine]
        while reached and len(left):
            i = reached.pop()
            near = np.bitwise_count(prints[left] ^ prints[i]).sum(1, dtype=np.int64) <= most
            if near.any():
                found = np.unique(roots[left[near]])
                out += [(int(roots[i]), r) for r in found.tolist()]
                mine = np.isin(roots[left], found)
                reached += left[mine].tolist()
                left = left[~mine]
    return out


@F.pandas_udf(T.IntegerType())
def distance(a: pd.Series, b: pd.Series) -> pd.Series:
    x, y = (np.frombuffer(b"".join(s), np.uint64).reshape(-1, WIDE) for s in (a, b))
    return pd.Series(np.bitwise_count(x ^ y).sum(1).astype(np.int32))


def verified(pairs: DataFrame, prints: DataFrame, most: int) -> DataFrame:
    """The pairs u, v (with what else they have) whose wide fingerprints differ in at most ``most`` bits."""
    both = pairs.join(prints.select(F.col("f").alias("u"), F.col("wide").alias("a")), "u").join(prints.select(F.col("f").alias("v"), F.col("wide").alias("b")), "v")
    return both.filter(distance("a", "b") <= most).drop("a", "b")


def rooted(members: DataFrame, roots: DataFrame, of: str = "f") -> DataFrame:
    """The members with root, that of their column ``of``; what isn't in roots is a component of its own."""
    both = members.join(roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col(of) == F.col("_node"), "left")
    return both.withColumn("root", F.coalesce("_root", of)).drop("_node", "_root")


def joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """node, root of roots after more (node, root) has closed links between its components."""
    return rooted(roots, more, "root").select("node", "root").union(more.join(roots, "node", "left_anti").select("node", "root"))


def opened(members: DataFrame) -> DataFrame:
    """The members (key, f, s, root) of the keys that have several components, with c, the key's centre: the least member of the component of the least root.

    A large component's root is the least of many, so the centre is mostly of the key's largest one, and few members are outside it."""
    key = Window.partitionBy("key")
    both = members.withColumn("c", F.min(F.struct("root", "f", "s")).over(key)).withColumn("_hi", F.max("root").over(key))
    return both.filter("c.root <> _hi").drop("_hi")


def offered(members: DataFrame) -> DataFrame:
    """Candidates u, v: each of the opened members with its key's centre, where they are of different components, ru and rv.

    The first 64 bits tell chance meetings: over 22 of them differ where 32 are expected of unrelated texts, and at a similarity of 0.8 so many do one time in 50,000."""
    near = F.bit_count(F.col("s").bitwiseXOR(F.col("c.s"))) <= LOOSE
    both = members.filter((F.col("root") != F.col("c.root")) & near)
    return both.select(F.col("f").alias("u"), F.col("c.f").alias("v"), F.col("root").alias("ru"), F.col("c.root").alias("rv")).distinct()


def between(links: DataFrame) -> DataFrame:
    """The links as those of their components."""
    return links.select(F.col("ru").alias("u"), F.col("rv").alias("v"))


def closed_keys(members: DataFrame, prints: DataFrame, most: int, piece: int) -> DataFrame:
    """Links between components whose closure is that of all close pairs that share a key. members: key, f, root.

    A key's members are searched in Arrow, many small keys in a group; a key of more than ``piece`` is dealt out in pieces, and each pair of pieces is
    a group of its own, so that no group outgrows a task and every pair is looked at in some group. A group gives a forest: what its earlier keys have linked is one component to the later ones."""
    members = cut(members)
    groups = max(1, ceil(members.count() / piece))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    split = members.join(sizes.filter(F.col("n") > piece), "key", "left").withColumn("of", F.coalesce(F.ceil(F.col("n") / piece), F.lit(1))).withColumn("own", F.pmod(F.xxhash64("f"), "of"))
    other = F.explode(F.filter(F.sequence(F.lit(0), F.col("of") - 1), lambda j: (F.col("of") == 1) | (j != F.col("own"))))
    split = split.select("key", "f", "root", "of", "own", other.alias("other"))
    lump = F.when(F.col("of") == 1, F.pmod(F.xxhash64("key"), F.lit(groups)))
    dealt = split.select("key", "f", "root", lump.alias("lump"), F.when(F.col("of") > 1, F.col("key")).alias("hot"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def close(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        key, root = group.column("key").to_numpy(), group.column("root").to_numpy()
        wide = np.frombuffer(b"".join(group.column("wide").to_pylist()), np.uint64).reshape(-1, WIDE)
        cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
        names, at = np.unique(root, return_inverse=True)
        of, links = np.arange(len(names)), []  # of: the component of each root, as far as the group has closed it
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            for i, j in close_links(wide[a:b], of[at[a:b]], most):
                links.append((names[i], names[j]))
                of[of == of[j]] = of[i]
        u, v = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({"u": pa.array(np.maximum(u, v), pa.int64()), "v": pa.array(np.minimum(u, v), pa.int64())})

    return dealt.join(prints.select("f", "wide"), "f").groupBy("lump", "hot", "i", "j").applyInArrow(close, "u long, v long").distinct()


def similar_roots(prints: DataFrame, similarity: float, piece: int = PIECE) -> DataFrame:
    """node, root: the components of wide fingerprints (f, wide) over all pairs that share a key and differ in at most ``most_bits`` bits.

    Each key is a star first: its members are offered to one of them, so there are no more candidates than members. The stars of the first few keys are verified and closed, which
    makes one component of most of a hot group; of the others only offers between components count, and from there on components are linked, not texts. What a star's centre misses is searched
    in the keys whose other members aren't of one component, again between components only."""
    most, (bits, pairs) = most_bits(similarity), layout(prints.count(), similarity)
    each = keyed(prints, bits, pairs)
    key = Window.partitionBy("key")  # its rows are spilled, so a hot key needn't fit in memory
    shared = cut(each.withColumn("n", F.count(F.lit(1)).over(key)).filter("n > 1"))
    first = shared.filter(F.col("key").bitwiseAND(F.lit(0xFFFF)) < FIRST).withColumn("root", F.col("f"))
    roots = cut(components(between(verified(offered(opened(first)), prints, most))))
    members = cut(opened(rooted(shared, roots)))
    drop_cut(shared)
    more = cut(components(between(verified(offered(members), prints, most))))
    roots = cut(joined(roots, more))
    others = rooted(members.filter("n > 2 AND f <> c.f").select("key", "f", "root"), more, "root")
    several = others.withColumn("lo", F.min("root").over(key)).withColumn("hi", F.max("root").over(key)).filter("lo <> hi").select("key", "f", "root")
    links = cut(closed_keys(several, prints, most, piece))
    drop_cut(members)
    return roots if links.isEmpty() else joined(roots, components(links))


def _similar(df: DataFrame, id_col: str, text_col: str, n: int, similarity: float, piece: int) -> DataFrame:
    """As _clustered, by similarity of wide fingerprints; f is the fingerprint's hash."""

    def run(batches):
        for b in batches:
            wide = [wide_fingerprint(x or b"", n) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(wide, pa.binary())], names=["id", "x", "wide"])

    slim = df.select(F.col(id_col).cast("long").alias("id"), F.encode(F.col(text_col), "UTF-8").alias("t"), _text_hash(F.col(text_col)).alias("x"))
    rows = cut(slim.mapInArrow(run, "id long, x long, wide binary").withColumn("f", F.xxhash64("wide")))
    prints = cut(rows.groupBy("f").agg(F.min("id").alias("least"), F.first("wide").alias("wide")))
    return _rooted(rows.drop("wide"), prints.select("f", "least"), similar_roots(prints.select("f", "wide"), similarity, piece))


def cluster(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, hot: int = HOT) -> DataFrame:
    """One row per row of df: id, fingerprint (16 hex digits), component_id (the least id of its component)."""
    return _clustered(df, id_col, text_col, n, hot).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8, piece: int = PIECE) -> DataFrame:
    """df with one row of each component of similar texts: that of the least id, and of its texts the one of the least hash."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "x")
    marks = cut(_similar(df, id_col, text_col, n, similarity, piece).select("root", "id", "x"))
    stay = marks.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    here = marks.withColumn("key", F.xxhash64("root"))
    both = here.join(stay.select(F.xxhash64("root").alias("key"), F.col("root").alias("of"), "first"), "key").filter("root = of")
    kept = both.withColumn("kept", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("x") == F.col("first.x")))
    gone = kept.filter("NOT kept").select(F.col("id").alias("__near_id"), F.col("x").alias("__near_x")).distinct()
    left = df.withColumn("__text_x", _text_hash(F.col(text_col)))
    left = left.join(gone, left[id_col].eqNullSafe(gone["__near_id"]) & (left["__text_x"] == gone["__near_x"]), "left_anti")
    if not kept.filter("kept").groupBy("root").count().filter("count > 1").isEmpty():
        left = left.dropDuplicates([id_col, "__text_x"])
    return left.drop("__text_x")


def query(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))

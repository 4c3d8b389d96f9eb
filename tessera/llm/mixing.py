"""Temperature mixing of sources, in DataFrame functions only.

Token shares p of the sources are raised to an exponent a in [0, 1] and normalised: w = p^a / sum p^a. The weights' entropy falls in a and
the largest number of repetitions, w B / T over the sources, falls in a too, so a limit on either is met by bisection. One
pass over the table of sources answers all questions that six halvings can ask (63 midpoints), so four passes make 24 halvings.

The budget B is given, or is the least at which each source is seen once in full. It is realised by block permutations: a source's documents fall into
blocks of about ``block_tokens`` by hash of the id; each epoch of a source visits its blocks in an order of its own; full epochs visit all and
the last one stops at the budget, at a block's end. A block's place in the stream is the share of its source's own
budget that precedes it, so any prefix of the stream holds the sources close to their weights.

Defined results: a null source is a source; a null or empty text has no tokens, and its row goes with its block; a source without tokens gets weight 0 and
each of its rows once; rows that repeat an id share a block; an empty table gives an empty result; other columns are ignored
or, in ``mix``, kept. Tokens are words between blanks, tabs and line ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import cut, table, text_or_empty

HALVINGS, PASSES, BLOCK_TOKENS, REPEATS, SEED = 6, 4, 16_384, 2.0, 17


def tokens(text: Column) -> Column:
    """Words of a text: places where a word starts, counted without a list of words."""
    plain = F.translate(text_or_empty(text), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_count(plain, F.lit(r"[^ ]+")).cast("long")


def _nodes(lo: float, hi: float) -> list[float]:
    steps = 2**HALVINGS
    return [lo + (hi - lo) * k / steps for k in range(1, steps)]


def exponent(sources: DataFrame, repeats: float | None = REPEATS, entropy: float | None = None, budget: float | None = None) -> float:
    """The exponent in [0, 1] for sources (tokens > 0). A limit on repetition gives the least exponent that keeps it, so the
    flattest mixture; a target entropy (nats) gives the largest exponent that reaches it; of both, the limit on repetition comes first.
    0 where even the flattest mixture keeps the limit or none reaches the entropy; 1 where nothing is asked."""
    total, count = sources.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not count or (repeats is None and entropy is None):
        return 1.0
    p = F.col("tokens") / float(total)

    def measured(at: list[float]) -> dict[float, tuple[float, float]]:
        """The entropy and the most repetitions at each exponent: sums over sources, pre-aggregated where they are."""
        each = sources.select(p.alias("p"), F.explode(F.array(*map(F.lit, at))).alias("a"))
        power, ratio = F.pow("p", "a"), F.pow("p", F.col("a") - 1)
        seen = each.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("l"), F.max(ratio).alias("most"), F.min(ratio).alias("fewest"))
        least = F.col("fewest") if budget is None else F.col("z") * total / float(budget)
        return {x[0]: (x[1], x[2]) for x in seen.select("a", F.log("z") - F.col("a") * F.col("l") / F.col("z"), F.col("most") / least).collect()}

    def bisected(good, at_zero: bool) -> float:
        """Where good(exponent) turns; at_zero: what it is at 0 if it turns at all."""
        lo, hi = 0.0, 1.0
        ends = measured([lo, hi])
        if good(ends[lo]) == good(ends[hi]):
            return float(good(ends[lo]) == at_zero)
        for _ in range(PASSES):
            at = measured(_nodes(lo, hi))
            for _ in range(HALVINGS):
                mid = min(at, key=lambda x: abs(x - (lo + hi) / 2))
                lo, hi = (mid, hi) if good(at[mid]) == at_zero else (lo, mid)
        return lo if at_zero else hi

    least = bisected(lambda x: x[1] <= repeats, at_zero=False) if repeats is not None else 0.0
    return max(least, bisected(lambda x: x[0] >= entropy, at_zero=True)) if entropy is not None else least


def schedule(rows: DataFrame, repeats: float | None = REPEATS, entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """rows: source, id, tokens. Returns the weights (source, tokens, share, weight, budget, blocks) and the visits
    (source, block, epoch, place): each block of each source once for each epoch that visits it."""
    sources = cut(rows.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    full = sources.filter("tokens > 0")
    a = exponent(full, repeats, entropy, budget)
    total = full.agg(F.sum("tokens")).first()[0] or 1
    z, fewest = full.agg(F.sum(F.pow(F.col("tokens") / float(total), F.lit(a))), F.min(F.pow(F.col("tokens") / float(total), F.lit(a - 1)))).first()
    share = F.col("tokens") / float(total)
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(a)) / (z or 1.0)).otherwise(0.0)
    # Each source once in full: B = max T / w, and T / w is largest where p^(a - 1) is least.
    whole = float(budget) if budget is not None else total * (z or 1.0) / (fewest or 1.0)
    blocks = F.greatest(F.ceil(F.col("tokens") / block_tokens), F.lit(1)).cast("long")
    weights = cut(sources.select("source", "tokens", share.alias("share"), weight.alias("weight"), (weight * whole).alias("budget"), blocks.alias("blocks"), F.lit(a).alias("exponent")))
    sizes = blocked(rows, weights, seed).groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    sizes = cut(sizes.join(weights.select(F.col("source").alias("of"), F.col("tokens").alias("all"), "budget"), F.col("source").eqNullSafe(F.col("of"))).drop("of"))
    # Full epochs, without an order: the last, partial one is the one after them.
    whole_epochs = F.when(F.col("all") > 0, F.floor(F.col("budget") / F.col("all") + 1e-9)).otherwise(1).cast("int")
    times = sizes.withColumn("full", whole_epochs)
    epochs = times.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full"))))
    run = preceded(epochs.withColumn("order", F.xxhash64(F.lit(seed), "epoch", "source", "block")))
    rest = F.col("budget") - F.col("full") * F.col("all")
    visited = run.filter((F.col("epoch") < F.col("full")) | ((F.col("all") > 0) & (F.col("before") + F.col("size") / 2 <= rest) & (rest > 1e-6 * F.col("all"))))
    place = F.when(F.col("budget") > 0, (F.col("epoch") * F.col("all") + F.col("before")) / F.col("budget")).otherwise(0.0)
    return weights, visited.select("source", "block", "epoch", place.alias("place"))


def preceded(epochs: DataFrame) -> DataFrame:
    """epochs (source, epoch, block, order, size) with before: the sizes of the blocks that precede in an epoch of a source.

    Blocks are summed up within ranges of the order (the upper 10 of its 64 bits), and each range starts where those before it end, so no task holds all blocks of a source."""
    cells = epochs.withColumn("cell", F.shiftright("order", 54).cast("int"))
    sums = cells.groupBy("source", "epoch", "cell").agg(F.sum("size").alias("total"))
    earlier = W.partitionBy("source", "epoch").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)  # 1024 ranges at most
    starts = sums.select(F.col("source").alias("s"), F.col("epoch").alias("e"), F.col("cell").alias("c"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start"))
    inside = W.partitionBy("source", "epoch", "cell").orderBy("order", "block").rowsBetween(W.unboundedPreceding, -1)
    own = cells.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = own.join(starts.hint("merge"), own["source"].eqNullSafe(starts["s"]) & (own["epoch"] == starts["e"]) & (own["cell"] == starts["c"]))
    return both.withColumn("before", F.col("start") + F.col("own")).drop("cell", "s", "e", "c", "start", "own", "order")


def blocked(rows: DataFrame, weights: DataFrame, seed: int = SEED) -> DataFrame:
    """rows with their block, among the blocks of their source."""
    # xxhash64 of the source makes a key of its own, so that Spark deals out both sides and can split a hot source.
    key = F.xxhash64(F.lit(seed), "source").alias("_key")
    of = weights.select(key, F.col("source").alias("_of"), "blocks")
    here = rows.withColumn("_key", key)
    both = here.join(of, (here["_key"] == of["_key"]) & here["source"].eqNullSafe(of["_of"]))
    return both.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("blocks"))).drop(here["_key"]).drop(of["_key"]).drop("_of", "blocks")


def _slim(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return df.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("tokens"))


def stream(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **limits) -> DataFrame:
    """One row per visit of a row of df: id, source, n_tokens, weight, epoch, block, place; ordered by place it is the mixed stream."""
    rows = cut(_slim(df, id_col, text_col, source_col))
    weights, visits = schedule(rows, **limits)
    visits = cut(visits.join(weights.select(F.col("source").alias("of"), "weight"), F.col("source").eqNullSafe(F.col("of"))).drop("of"))
    placed = blocked(rows, weights)
    there = visits.select(F.xxhash64("source", "block").alias("_key"), F.col("source").alias("_of"), F.col("block").alias("_b"), "weight", "epoch", "place")
    here = placed.withColumn("_key", F.xxhash64("source", "block"))
    both = here.join(there.hint("merge"), (here["_key"] == there["_key"]) & here["source"].eqNullSafe(there["_of"]) & (here["block"] == there["_b"]))
    return both.select(F.col("id").alias(id_col), "source", F.col("tokens").alias("n_tokens"), "weight", "epoch", "block", "place")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **limits) -> DataFrame:
    """df with each row as often as the mixture visits it; at the budget of its own choice it drops none."""
    visits = cut(stream(df, id_col, text_col, source_col, **limits).groupBy(F.col(id_col).alias("__mix_i"), F.col("source").alias("__mix_s")).agg(F.countDistinct("epoch").cast("int").alias("__mix_times")))
    # Blocks and visits grow with the table, so neither is broadcast at any size.
    x = df.join(visits.hint("merge"), df[id_col].eqNullSafe(visits["__mix_i"]) & df[source_col].eqNullSafe(visits["__mix_s"]))
    again = x.withColumn("__mix_again", F.explode(F.sequence(F.lit(1), F.col("__mix_times"))))
    return again.select(*[df[c] for c in df.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return stream(table(spark, sf_dir, "documents"))

"""URL filter by rules and, where none fits, by the ratio of two character language models, in DataFrame functions only.

Rules (host, path) decide the urls that they fit. These urls are also what the models learn from: one smoothed variable-order Markov model
for accepted and one for rejected urls, over 32 classes of characters (a-z, digit, /, ., - or _, others) with contexts of up to three
characters; shorter contexts are blended in by Witten-Bell weights. A url's score is the difference of the two log-likelihoods a character. The threshold is
calibrated on the labelled urls of other hosts than the models saw (a quarter of hosts, by hash): the one of 201 that gives the best balanced accuracy.

Counts cover all urls. There are 32^4 grams at most, so the table of log-ratios has a bound of its own and goes into the scoring expression
as a literal; judging is one projection without a shuffle.

Defined results: a null url or one without :// has an empty host and path, fits no rule and gets the score 0; an empty path fits no rule whose
path is longer; repeated rows get equal verdicts; without labelled urls of both kinds all other urls are allowed; an empty
table gives an empty result; other columns are ignored. Scores at the threshold are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import ascii_lower, cut, drop_cut, table, text_or_empty

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SYMBOLS, ORDER, FOLDS = 32, 3, 4
_MASK = SYMBOLS ** (ORDER + 1) - 1


def parts(df: DataFrame, url_col: str) -> DataFrame:
    """df with host and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = text_or_empty(F.col(url_col))
    return df.withColumn("host", ascii_lower(F.regexp_extract(url, pattern, 1))).withColumn("path", F.regexp_extract(url, pattern, 2))


def ruled(rules=RULES) -> tuple[Column, Column]:
    """The rule that fits host and path, as text, and its verdict; the longest wins, of equal lengths the first."""
    rule = said = F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, said = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(said)
    return rule, said


def classes() -> list[int]:
    """The class of each of the 128 ASCII characters; 0 is the start and what isn't ASCII counts as 31."""
    named = {**{chr(97 + i): 1 + i for i in range(26)}, **{str(i): 27 for i in range(10)}, "/": 28, ".": 29, "-": 30, "_": 30}
    return [named.get(chr(c).lower(), 31) for c in range(128)]


def grams(text: Column) -> Column:
    """For each character the number of its class and those of the three before it, 5 bits each."""
    of = F.from_json(F.lit(str(classes())), "array<int>")
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.coalesce(F.get(of, F.ascii(c)), F.lit(31)))
    step = lambda seen, c: F.concat(seen, F.array((F.element_at(seen, -1) * SYMBOLS).bitwiseAND(F.lit(_MASK)) + c))
    return F.slice(F.aggregate(codes, F.array(F.lit(0)), step), 2, 1 << 30)


def log_ratios(counts: DataFrame) -> DataFrame:
    """counts: gram, a, r (how often accepted and rejected urls have it). Returns gram, llr for each gram of counts."""
    p = {"a": F.lit(1.0 / SYMBOLS), "r": F.lit(1.0 / SYMBOLS)}
    for k in range(ORDER + 1):
        # The windows hold SYMBOLS^4 rows at most, those of one context.
        own = F.col("gram").bitwiseAND(F.lit(SYMBOLS ** (k + 1) - 1))
        context = F.floor(own / SYMBOLS).cast("int")
        counts = counts.withColumn(f"own{k}", own).withColumn(f"context{k}", context)
        for x in ("a", "r"):
            n = F.sum(x).over(W.partitionBy(f"own{k}"))
            counts = counts.withColumn(f"{x}{k}", n)
            seen = counts[f"{x}{k}"] > 0
            n_all = F.sum(x).over(W.partitionBy(f"context{k}"))
            kinds = F.size(F.collect_set(F.when(seen, F.col(f"own{k}"))).over(W.partitionBy(f"context{k}")))
            counts = counts.withColumn(f"{x}n{k}", n_all).withColumn(f"{x}t{k}", kinds)
            total = F.col(f"{x}n{k}") + F.col(f"{x}t{k}")
            counts = counts.withColumn(f"p{x}{k}", F.when(total == 0, p[x]).otherwise((F.col(f"{x}{k}") + F.col(f"{x}t{k}") * p[x]) / F.greatest(total, F.lit(1))))
            p[x] = F.col(f"p{x}{k}")
    return counts.select("gram", (F.log(p["a"]) - F.log(p["r"])).alias("llr"))


def scorer(ratios: DataFrame) -> tuple:
    """A function from grams to a score: the mean of their log-ratios. The literal holds SYMBOLS^4 numbers at most."""
    rows = ratios.select(F.shiftright("gram", 5).alias("context"), F.struct(F.col("gram").bitwiseAND(F.lit(31)).alias("s"), "llr").alias("x"))
    lists = rows.groupBy("context").agg(F.collect_list("x").alias("xs"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(SYMBOLS - 1)), lambda s: F.coalesce(F.try_element_at(F.transform(F.filter("xs", lambda x: x["s"] == s), lambda x: F.round(x["llr"], 4)), F.lit(1)), F.lit(0.0)))
    every = ratios.sparkSession.range(SYMBOLS**ORDER).select(F.col("id").cast("int").alias("context"))
    table_ = every.join(lists, "context", "left").select(F.struct("context", F.coalesce(F.when(F.col("xs").isNotNull(), dense), F.array().cast("array<double>")).alias("d")).alias("row"))
    packed = table_.agg(F.to_json(F.transform(F.sort_array(F.collect_list("row")), lambda x: x["d"]))).first()[0]
    model = F.from_json(F.lit(packed), "array<array<float>>")

    def score(gram: Column) -> Column:
        total = F.aggregate(gram, F.lit(0.0), lambda s, g: s + F.coalesce(F.get(F.get(model, F.shiftright(g, 5)), g.bitwiseAND(F.lit(31))), F.lit(0.0)).cast("double"))
        return total / F.greatest(F.size(gram), F.lit(1))

    return score


def threshold(scored: DataFrame) -> float:
    """scored: score, label (1 accepted). The middle of the thresholds k / 50, -100 <= k <= 100, of the best balanced accuracy."""
    step = F.floor(F.least(F.greatest(F.col("score"), F.lit(-2.0)), F.lit(2.0)) * 50).cast("int")
    bins = {x[0]: (x[1], x[2]) for x in scored.groupBy(step.alias("k")).agg(F.sum("label"), F.sum(1 - F.col("label"))).collect()}  # 201 rows at most
    good, bad = (sum(v[i] for v in bins.values()) for i in (0, 1))
    if not good or not bad:
        return 0.0
    at = {k: sum(v[0] for b, v in bins.items() if b >= k) / good + sum(v[1] for b, v in bins.items() if b < k) / bad for k in range(-100, 101)}
    best = [k for k, v in at.items() if v == max(at.values())]
    return best[len(best) // 2] / 50


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """One row per row of df: id, host, path, rule, verdict, and the models' score."""
    rule, said = ruled(rules)
    slim = parts(df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")), "_url").withColumn("rule", rule).withColumn("_said", said)
    each = cut(slim.select("_id", "host", "path", "rule", "_said", grams(ascii_lower(F.concat("host", "path"))).alias("_grams")))
    learns = F.pmod(F.crc32(F.encode("host", "UTF-8")), F.lit(FOLDS)) != 0
    long = each.select(F.explode("_grams").alias("gram"), ((F.col("_said") == "allow") & learns).alias("x"), ((F.col("_said") == "block") & learns).alias("y"))
    counts = long.groupBy("gram").agg(F.count_if("x").alias("a"), F.count_if("y").alias("r"))
    ratios = cut(log_ratios(counts))
    score = scorer(ratios)
    scored = each.withColumn("score", score(F.col("_grams")))
    labelled = scored.filter(F.col("_said").isNotNull() & ~learns).select("score", (F.col("_said") == "allow").cast("int").alias("label"))
    at = threshold(labelled)
    drop_cut(ratios)
    other = F.when(F.col("score") >= at, "allow").otherwise("block") if _both(each) else F.lit("allow")
    return scored.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_said", other).alias("verdict"), "score")


def _both(each: DataFrame) -> bool:
    return each.agg(F.countDistinct("_said")).first()[0] == 2


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))

"""Queries of the core operators over the test tables, and the SQL that says the same to another engine.

Doubles are rounded on both sides, as sums differ in their last digits between engines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import synthetic
from tessera.functions.membership import TERMS, concept_map
from tessera.functions.rules import Condition, Rule, activations, enumerate_rules, rule_table, rule_text
from tessera.operators import explain, metrics, prepare, ranking, statistics
from tessera.operators.association import FuzzyAssociationClassifier
from tessera.operators.boosting import ExplainableBoosting
from tessera.operators.estimators import CSRQClassifier, FuzzyRuleSVM, MembershipLogisticL1, MembershipSVM, OneVsRest, QuotientAtomicSVM
from tessera.operators.neighbours import knn_mutual_information
from tessera.operators.unordered import UnorderedFuzzyRules, best_test
from tessera.plans import quotient
from tessera.sources import datasets

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: Column, digits: int = 6) -> Column:
    return F.round(x, digits)


# ---- Feature views: lines with their return flag, orders with their customer, events by value and hour.

LINES, ORDERS, EVENTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["totalprice", "acctbal"], ["value", "hour"]


def lines(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*LINES, F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))


def orders(spark, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_totalprice").alias("totalprice"), F.col("c_acctbal").alias("acctbal"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"))


def events(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value", F.hour("ts").cast("double").alias("hour"), F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("y"))


LINES_SQL = "lines AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_quantity AS w FROM lineitem)"
ORDERS_SQL = "ords AS (SELECT o_orderkey, o_totalprice AS totalprice, c_acctbal AS acctbal, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders JOIN customer ON o_custkey = c_custkey)"
EVENTS_SQL = "evs AS (SELECT event_id, value, CAST(hour(ts) AS DOUBLE) AS hour, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y FROM events)"


def anchors_sql(view: str, features) -> str:
    return "anch AS (SELECT " + ", ".join(f"quantile_cont({f}, {q}) AS {f}_{i}" for f in features for i, q in enumerate(("0.05", "0.5", "0.95"))) + f" FROM {view})"


def term_sql(f: str, term: str) -> str:
    down = lambda a, b: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({f}_{b} - {f}) / ({f}_{b} - {f}_{a})))"
    up = lambda a, b: f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({f} - {f}_{a}) / ({f}_{b} - {f}_{a})))"
    return {"low": down(0, 1), "medium": f"least({up(0, 1)}, {down(1, 2)})", "high": up(1, 2)}[term]


def terms_sql(view: str, features, keep: str) -> str:
    cells = ", ".join(f"{term_sql(f, t)} AS m_{f}_{t}" for f in features for t in TERMS)
    return f"mem AS (SELECT {keep}, {cells} FROM {view}, anch)"


def conjunction_sql(cells: list[str], how: str) -> str:
    if len(cells) == 1:
        return cells[0]
    if how == "min":
        return f"least({', '.join(cells)})"
    if how == "product":
        return " * ".join(cells)
    mean = " + ".join(f"exp(-{c} / 0.1)" for c in cells)
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, -0.1 * ln(({mean}) / {len(cells)})))"


def rule_sql(rule: Rule, features, how: str = "min") -> str:
    return conjunction_sql([f"m_{features[c.feature]}_{c.term}" for c in rule.conditions], how)


# ---- Partitions and memberships


@query(f"WITH {LINES_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, quantile_cont({f}, 0.05) AS low, quantile_cont({f}, 0.5) AS medium, quantile_cont({f}, 0.95) AS high FROM lines" for f in LINES))
def partition_anchors(spark, sf_dir):
    return spark.createDataFrame([(p.feature, p.low, p.medium, p.high) for p in prepare.anchors(lines(spark, sf_dir), LINES)], "feature string, low double, medium double, high double")


@query(f"WITH {LINES_SQL}, {anchors_sql('lines', LINES)}, {terms_sql('lines', LINES, 'y')} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, " + ", ".join(f"round(avg(m_{f}_{t}), 6) AS mean_{t}" for t in TERMS) + " FROM mem" for f in LINES))
def membership_profile(spark, sf_dir):
    df = lines(spark, sf_dir)
    parts = prepare.anchors(df, LINES)
    each = [F.struct(F.lit(p.feature).alias("feature"), *[rounded(F.avg(p.term(t))).alias(f"mean_{t}") for t in TERMS]) for p in parts]
    return df.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query(f"WITH {LINES_SQL}, {anchors_sql('lines', LINES)}, {terms_sql('lines', LINES, 'y')} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(max(abs(m_{f}_low + m_{f}_medium + m_{f}_high - 1)), 9) AS max_gap FROM mem" for f in LINES))
def ruspini_check(spark, sf_dir):
    df = lines(spark, sf_dir)
    each = [F.struct(F.lit(p.feature).alias("feature"), rounded(F.max(F.abs(p.term("low") + p.term("medium") + p.term("high") - 1)), 9).alias("max_gap")) for p in prepare.anchors(df, LINES)]
    return df.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query(f"WITH {ORDERS_SQL}, {anchors_sql('ords', ORDERS)}, {terms_sql('ords', ORDERS, 'o_orderkey')} " + " UNION ALL ".join(f"SELECT o_orderkey, '{f}' AS feature, '{t}' AS term, round(m_{f}_{t}, 6) AS mu FROM mem" for f in ORDERS for t in TERMS))
def concept_memberships(spark, sf_dir):
    df = orders(spark, sf_dir)
    made = df.select("o_orderkey", concept_map(prepare.anchors(df, ORDERS)).alias("m"))
    long = made.select("o_orderkey", F.explode("m").alias("feature", "t"))
    return long.select("o_orderkey", "feature", F.explode("t").alias("term", "mu")).withColumn("mu", rounded(F.col("mu")))


# ---- Rules

PAIRS = enumerate_rules(len(LINES), 2)


def sums_sql(how: str, weight: str, rules=PAIRS) -> str:
    """One row a rule with its weighted sums: wp, wn, sp, sn."""
    each = " UNION ALL ".join(
        f"SELECT {i} AS enum_idx, '{rule_text(r, LINES)}' AS rule, {r.length} AS length, sum(CASE WHEN y = 1 THEN {weight} ELSE 0 END) AS wp, sum(CASE WHEN y = 0 THEN {weight} ELSE 0 END) AS wn, "
        f"sum(CASE WHEN y = 1 THEN {weight} * {rule_sql(r, LINES, how)} ELSE 0 END) AS sp, sum(CASE WHEN y = 0 THEN {weight} * {rule_sql(r, LINES, how)} ELSE 0 END) AS sn FROM mem"
        for i, r in enumerate(rules)
    )
    return f"WITH {LINES_SQL}, {anchors_sql('lines', LINES)}, {terms_sql('lines', LINES, 'y, w')}, sums AS ({each}), scored AS (SELECT enum_idx, rule, length, (sp + sn) / (wp + wn) AS coverage, abs(sp / wp - sn / wn) * (sp + sn) / (wp + wn) / length AS score FROM sums) "


def _coverage(how: str):
    def run(spark, sf_dir):
        df = lines(spark, sf_dir)
        acts = activations(PAIRS, prepare.anchors(df, LINES), how)
        each = [F.struct(F.lit(rule_text(r, LINES)).alias("rule"), rounded(F.avg(a), 9).alias("coverage")) for r, a in zip(PAIRS, acts, strict=True)]
        return df.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")

    run.__name__ = f"rule_coverage_{how}"
    return query(sums_sql(how, "1.0") + "SELECT rule, round(coverage, 9) AS coverage FROM scored")(run)


for _how in ("min", "product", "softmin"):
    _coverage(_how)


@query(sums_sql("min", "1.0") + "SELECT rule, CAST(length AS INTEGER) AS length, round(coverage, 6) AS coverage, round(score, 8) AS score FROM scored WHERE coverage >= 0.02 ORDER BY score DESC, coverage DESC, length, enum_idx LIMIT 24")
def rule_ranking(spark, sf_dir):
    df = lines(spark, sf_dir)
    top = ranking.ranking_table(df, prepare.anchors(df, LINES), ranking.signed(F.col("y"), 1), F.lit(1.0), 2, 24)
    return top.select("rule", "length", rounded(F.col("coverage")).alias("coverage"), rounded(F.col("score"), 8).alias("score"))


@query(sums_sql("min", "1.0") + "SELECT rule, round(coverage, 6) AS coverage, round(score, 8) AS score FROM scored WHERE length = 1 ORDER BY score DESC, coverage DESC, enum_idx")
def rule_fallback(spark, sf_dir):
    df = lines(spark, sf_dir)
    # No rule of two terms covers all rows, so all rules of one term are ranked.
    rules, score, _ = ranking.generate(df, parts := prepare.anchors(df, LINES), ranking.signed(F.col("y"), 1), F.lit(1.0), least=0.9999)
    totals, sums = ranking.rule_sums(df, rules, parts, ranking.signed(F.col("y"), 1), F.lit(1.0))
    coverage, _ = ranking.scores(totals, sums, rules)
    rows = [(rule_text(r, LINES), float(c), s) for r, c, s in zip(rules, coverage, score, strict=True)]
    return spark.createDataFrame(rows, "rule string, coverage double, score double").select("rule", rounded(F.col("coverage")).alias("coverage"), rounded(F.col("score"), 8).alias("score"))


@query(sums_sql("product", "w") + "SELECT rule, round(coverage, 6) AS coverage, round(score, 8) AS score FROM scored")
def weighted_rule_score(spark, sf_dir):
    df = lines(spark, sf_dir).withColumn("w", F.col("l_quantity"))
    top = ranking.ranking_table(df, prepare.anchors(df, LINES), ranking.signed(F.col("y"), 1), F.col("w"), 2, len(PAIRS), 0.0, "product")
    return top.select("rule", rounded(F.col("coverage")).alias("coverage"), rounded(F.col("score"), 8).alias("score"))


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {r.length}, '{rule_text(r, LINES)}')" for i, r in enumerate(PAIRS)) + ") AS t(enum_idx, length, rule)")
def rule_catalogue(spark, sf_dir):
    return rule_table(spark, PAIRS, LINES).select("enum_idx", "length", "rule")


# ---- Preparation


@query(
    f"WITH {LINES_SQL}, long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS v, y FROM lines" for f in LINES) + "), "
    "g AS (SELECT feature, y, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM long GROUP BY ALL), t AS (SELECT feature, avg(v) AS m, count(*) AS n FROM long GROUP BY ALL) "
    "SELECT g.feature, round(sum(g.n * (g.m - t.m) ** 2) / (sum(g.ss) / (max(t.n) - 2)), 6) AS f FROM g JOIN t USING (feature) GROUP BY g.feature"
)
def anova_screening(spark, sf_dir):
    rows = [(c, round(f, 6)) for c, f in prepare.anova_f(lines(spark, sf_dir), LINES, "y")]
    return spark.createDataFrame(rows, "feature string, f double")


def mutual_info_sql(view: str, features, bins: int = 16) -> str:
    """Each value's bin is how many different cuts lie below it; the sum runs over bins and labels."""
    cuts = "cuts AS (" + " UNION ".join(f"SELECT '{f}' AS feature, quantile_cont({f}, {k / bins}) AS cut FROM {view}" for f in features for k in range(1, bins)) + ")"
    long = "long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS v, y FROM {view}" for f in features) + ")"
    return (
        f"{cuts}, {long}, bins AS (SELECT feature, v, (SELECT count(*) FROM cuts c WHERE c.feature = d.feature AND c.cut < d.v) AS b FROM (SELECT DISTINCT feature, v FROM long) d), "
        "cells AS (SELECT feature, b, y, count(*)::DOUBLE AS c FROM long JOIN bins USING (feature, v) GROUP BY ALL), "
        "sums AS (SELECT *, sum(c) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature, b) AS nb, sum(c) OVER (PARTITION BY feature, y) AS ny FROM cells) "
        "SELECT feature, round(greatest(0.0::DOUBLE, sum(c / n * ln(c * n / (nb * ny)))), 6) AS mutual_information FROM sums GROUP BY feature"
    )


@query(f"WITH {LINES_SQL}, {mutual_info_sql('lines', LINES)}")
def mutual_info_screening(spark, sf_dir):
    rows = prepare.mutual_information(lines(spark, sf_dir), LINES, "y")
    return spark.createDataFrame([(c, round(v, 6)) for c, v in rows], "feature string, mutual_information double")


CUSTOMERS = ["c_acctbal", "c_nationkey"]


def knn_mutual_info_sql(k: int = 3) -> str:
    """All pairs of customers, by the definition."""
    rows = " UNION ALL ".join(f"SELECT '{c}' AS feature, c_mktsegment AS y, {c}::DOUBLE AS x, c_custkey AS id FROM customer WHERE {c} IS NOT NULL AND c_mktsegment IS NOT NULL" for c in CUSTOMERS)
    return (
        f"WITH v AS ({rows}), sizes AS (SELECT feature, y, count(*) AS size FROM v GROUP BY feature, y HAVING count(*) > 1), p AS (SELECT v.*, size, least({k}, size - 1) AS k FROM v JOIN sizes USING (feature, y)), "
        "psi AS (SELECT n, -0.5772156649015329::DOUBLE + sum(CASE WHEN n > 1 THEN 1 / (n - 1)::DOUBLE ELSE 0 END) OVER (ORDER BY n) AS psi FROM range(1, (SELECT count(*) + 1 FROM customer)) t(n)), "
        "others AS (SELECT a.feature, a.id, a.x, a.k, a.size, list_sort(list(abs(a.x - b.x))) AS d FROM p a JOIN p b ON a.feature = b.feature AND a.y = b.y AND a.id <> b.id GROUP BY a.feature, a.id, a.x, a.k, a.size), "
        "near AS (SELECT feature, id, x, k, size, d[k] AS r FROM others), "
        "within AS (SELECT a.feature, a.id, a.k, a.size, count(*) AS m FROM near a JOIN p b ON a.feature = b.feature AND (abs(a.x - b.x) < a.r OR a.x = b.x) GROUP BY a.feature, a.id, a.k, a.size), "
        "sums AS (SELECT feature, count(*) AS n, avg(pk.psi) - avg(ps.psi) - avg(pm.psi) AS rest FROM within JOIN psi pk ON pk.n = k JOIN psi ps ON ps.n = size JOIN psi pm ON pm.n = m GROUP BY feature) "
        "SELECT feature, round(greatest(0.0::DOUBLE, psi.psi + rest), 6) AS mutual_information FROM sums JOIN psi USING (n)"
    )


@query(knn_mutual_info_sql())
def mutual_info_neighbours(spark, sf_dir):
    rows = knn_mutual_information(table(spark, sf_dir, "customer"), CUSTOMERS, "c_mktsegment")
    return spark.createDataFrame([(c, round(v, 6)) for c, v in rows], "feature string, mutual_information double")


GAPS_SQL = "gaps AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice END AS v FROM orders)"


@query(f"WITH {GAPS_SQL}, m AS (SELECT median(v) AS mid FROM gaps WHERE NOT isnan(v)) SELECT o_orderkey, round(CASE WHEN v IS NULL OR isnan(v) THEN mid ELSE v END, 6) AS v FROM gaps, m")
def median_impute(spark, sf_dir):
    k = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select(k, F.when(k % 7 == 0, None).when(k % 11 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("v"))
    return prepare.impute_median(df, ["v"]).withColumn("v", rounded(F.col("v")))


@query("SELECT o_orderstatus AS label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 9) AS weight FROM orders GROUP BY o_orderstatus")
def class_weights(spark, sf_dir):
    found = prepare.class_weights(table(spark, sf_dir, "orders"), "o_orderstatus", "balanced")
    return spark.createDataFrame([(k, round(v, 9)) for k, v in found.items()], "label string, weight double")


TURN_SQL = "row_number() OVER (PARTITION BY y ORDER BY (event_id * 7919 + 104729) % 1000003, event_id)"


@query(f"WITH {EVENTS_SQL} SELECT event_id, y, CAST(({TURN_SQL} - 1) % 5 AS INTEGER) AS fold FROM evs")
def stratified_folds(spark, sf_dir):
    return prepare.stratified_folds(events(spark, sf_dir).select("event_id", "y"), "y", "event_id", 5)


@query(f"WITH {EVENTS_SQL}, r AS (SELECT event_id, y, {TURN_SQL} AS turn, count(*) OVER (PARTITION BY y) AS k, count(*) OVER () AS n FROM evs) SELECT event_id, y FROM r WHERE turn <= least(k, greatest(2, floor(500.0 * k / n)))")
def stratified_subset(spark, sf_dir):
    return prepare.stratified_subset(events(spark, sf_dir).select("event_id", "y"), "y", "event_id", 500)


@query("SELECT 'tax is ' || c AS text, CASE WHEN try_cast(trim(c) AS DOUBLE) IS NULL THEN -1 ELSE try_cast(trim(c) AS DOUBLE) END AS number FROM (VALUES ('1.5'), (' 2 '), ('?'), ('x')) AS t(c)")
def numeric_coercion(spark, sf_dir):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("?",), ("x",)], "c string")
    return df.select(F.concat(F.lit("tax is "), "c").alias("text"), F.coalesce(F.nullif(datasets.numeric("c"), F.lit(float("nan"))), F.lit(-1.0)).alias("number"))


# ---- Serving with fixed coefficients

RULES = [
    Rule((Condition(0, "low"),)), Rule((Condition(0, "high"),)), Rule((Condition(1, "medium"),)), Rule((Condition(0, "low"), Condition(1, "high"))),
    Rule((Condition(0, "high"), Condition(1, "low"))), Rule((Condition(0, "medium"), Condition(1, "medium"))),
]
COEF, INTERCEPT, CLASSES = [-0.8, 0.9, 0.35, -1.1, 0.6, 0.0], -0.1, [0, 1]
SERVED_SQL = (
    f"WITH {ORDERS_SQL}, {anchors_sql('ords', ORDERS)}, {terms_sql('ords', ORDERS, 'o_orderkey, y')}, "
    "z AS (SELECT o_orderkey, y, " + ", ".join(f"{rule_sql(r, ORDERS)} AS z{i}" for i, r in enumerate(RULES)) + " FROM mem), "
    "s AS (SELECT *, -0.1::DOUBLE + " + " + ".join(f"({c}::DOUBLE * z{i})" for i, c in enumerate(COEF) if c) + " AS margin FROM z) "
)
LONG_SQL = SERVED_SQL + ", c AS (" + " UNION ALL ".join(f"SELECT o_orderkey, y, margin, {i} AS idx, '{rule_text(r, ORDERS, str(CLASSES[c > 0]))}' AS rule, {c}::DOUBLE * z{i} AS contribution FROM s" for i, (r, c) in enumerate(zip(RULES, COEF, strict=True)) if c) + ") "


def served(spark, sf_dir) -> tuple[DataFrame, list[Column]]:
    df = orders(spark, sf_dir)
    acts = activations(RULES, prepare.anchors(df, ORDERS))
    return df.withColumn("margin", explain.margin(acts, COEF, INTERCEPT)), acts


@query(SERVED_SQL + "SELECT o_orderkey, round(margin, 6) AS margin, CASE WHEN margin >= 0 THEN 1 ELSE 0 END AS prediction FROM s")
def decision_predict(spark, sf_dir):
    df, _ = served(spark, sf_dir)
    return df.select("o_orderkey", rounded(F.col("margin")).alias("margin"), explain.decision(F.col("margin"), CLASSES).alias("prediction"))


@query(
    SERVED_SQL + ", v AS (SELECT o_orderkey, (2 * y - 1) * margin AS fm, greatest(0.0::DOUBLE, 1 - (2 * y - 1) * margin) AS slack FROM s) SELECT o_orderkey, round(fm, 6) AS functional_margin, round(slack, 6) AS slack, "
    "round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.5 - slack) / 0.5)), 6) AS cleanly_classified, round(least(greatest(0.0::DOUBLE, least(1.0::DOUBLE, slack)), greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2 - slack))), 6) AS borderline, "
    "round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, slack - 1)), 6) AS strong_violation FROM v"
)
def fuzzy_violations(spark, sf_dir):
    df, _ = served(spark, sf_dir)
    v = df.select("o_orderkey", explain.violations(F.col("margin"), explain.checked_sign(F.col("y"), CLASSES)).alias("v")).select("o_orderkey", "v.*")
    return v.select("o_orderkey", *[rounded(F.col(c)).alias(c) for c in v.columns[1:]])


@query(
    LONG_SQL + ", k AS (SELECT *, 'top' AS kind FROM c UNION ALL SELECT *, 'positive' FROM c WHERE contribution > 0 UNION ALL SELECT *, 'negative' FROM c WHERE contribution < 0) "
    "SELECT o_orderkey, kind, CAST(r AS INTEGER) AS place, rule, round(contribution, 6) + 0.0::DOUBLE AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey, kind ORDER BY abs(contribution) DESC, idx) AS r FROM k) WHERE r <= 2"
)
def explain_topn(spark, sf_dir):
    df, acts = served(spark, sf_dir)
    out = explain.explain(df, acts, COEF, RULES, ORDERS, INTERCEPT, CLASSES, 2)
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_rules").alias("rules")) for k in ("top", "positive", "negative")]))
    each = out.select("o_orderkey", kinds.alias("k")).select("o_orderkey", "k.kind", F.posexplode("k.rules").alias("place", "x"))
    return each.select("o_orderkey", "kind", (F.col("place") + 1).alias("place"), "x.rule", (rounded(F.col("x.contribution")) + 0.0).alias("contribution"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{rule_text(r, ORDERS, str(CLASSES[c > 0]))}', {c}::DOUBLE, {r.length})" for c, r in sorted(zip(COEF, RULES, strict=True), key=lambda x: -abs(x[0])) if c) + ") AS t(rule, coefficient, length)")
def support_rules(spark, sf_dir):
    return spark.createDataFrame([(x["rule"], x["coefficient"], x["length"]) for x in explain.support_rules(COEF, RULES, ORDERS, CLASSES)], "rule string, coefficient double, length int")


@query(SERVED_SQL + "SELECT n AS contributing, o_orderkey FROM (SELECT o_orderkey, n, row_number() OVER (ORDER BY abs(n - m), abs(margin - mm), o_orderkey) AS r FROM (SELECT *, median(n) OVER () AS m, median(margin) OVER () AS mm FROM (SELECT o_orderkey, margin, " + " + ".join(f"(CASE WHEN abs({c}::DOUBLE * z{i}) > 0.01 THEN 1 ELSE 0 END)" for i, c in enumerate(COEF) if c) + " AS n FROM s))) WHERE r = 1")
def median_complexity_instance(spark, sf_dir):
    df, acts = served(spark, sf_dir)
    n = sum((F.when(F.abs(F.lit(c) * a) > 0.01, 1).otherwise(0) for a, c in zip(acts, COEF, strict=True) if c), F.lit(0))
    rows = df.withColumn("contributing", n)
    found = prepare.exact_quantiles(rows, ["contributing", "margin"], [0.5])
    m, mm = found["contributing"][0], found["margin"][0]
    near = rows.orderBy(F.abs(F.col("contributing") - F.lit(m)), F.abs(F.col("margin") - F.lit(mm)), "o_orderkey").limit(1)
    return near.select("contributing", "o_orderkey")


# ---- Metrics

PREDICTED_SQL = SERVED_SQL + ", p AS (SELECT y, CASE WHEN margin >= 0 THEN 1 ELSE 0 END AS p, margin FROM s) "


@query(
    PREDICTED_SQL + ", k AS (SELECT c, sum((y = c)::INT)::DOUBLE AS t, sum((p = c)::INT)::DOUBLE AS q, sum((y = c AND p = c)::INT)::DOUBLE AS h FROM p, (VALUES (0), (1)) AS v(c) GROUP BY c) "
    "SELECT round(sum(h) / sum(t), 9) AS accuracy, round(avg(h / t), 9) AS balanced_accuracy, round(avg(2 * h / (t + q)), 9) AS f1_macro, round(sum(t * 2 * h / (t + q)) / sum(t), 9) AS f1_weighted, round(avg(CASE WHEN q > 0 THEN h / q ELSE 0 END), 9) AS precision_macro, round(avg(h / t), 9) AS recall_macro FROM k"
)
def confusion_metrics(spark, sf_dir):
    df, _ = served(spark, sf_dir)
    out = metrics.confusion_metrics(df.withColumn("p", explain.decision(F.col("margin"), CLASSES)), "y", "p")
    return out.select(*[rounded(F.col(c), 9).alias(c) for c in out.columns])


@query(SERVED_SQL + ", r AS (SELECT y, rank() OVER (ORDER BY margin) + (count(*) OVER (PARTITION BY margin) - 1) / 2.0::DOUBLE AS r FROM s) SELECT round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y)::DOUBLE * sum(1 - y)), 9) AS roc_auc FROM r")
def roc_auc(spark, sf_dir):
    df, _ = served(spark, sf_dir)
    return metrics.roc_auc(df, F.col("y") == 1, "margin").select(rounded(F.col("roc_auc"), 9).alias("roc_auc"))


@query(SERVED_SQL + "SELECT round(avg(abs(margin)), 6) AS mean_abs_margin, round(median(abs(margin)), 6) AS median_abs_margin FROM s")
def margin_stats(spark, sf_dir):
    out = metrics.margin_stats(served(spark, sf_dir)[0], "margin")
    return spark.createDataFrame([tuple(round(v, 6) for v in out.values())], ", ".join(f"{k} double" for k in out))


@query(LONG_SQL + ", o AS (SELECT o_orderkey, abs(contribution) AS a, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(contribution) DESC, idx) AS r, sum(abs(contribution)) OVER (PARTITION BY o_orderkey) AS mass FROM c) SELECT o_orderkey, round(CASE WHEN max(mass) > 0 THEN sum(CASE WHEN r <= 1 THEN a ELSE 0 END) / max(mass) ELSE 0 END, 6) AS top1_share FROM o GROUP BY o_orderkey")
def top_share(spark, sf_dir):
    df, acts = served(spark, sf_dir)
    return df.select("o_orderkey", rounded(metrics.top_share(F.array(*[F.lit(c) * a for a, c in zip(acts, COEF, strict=True) if c]), 1)).alias("top1_share"))


@query(
    LONG_SQL + ", o AS (SELECT o_orderkey, round(sum(abs(contribution)) OVER (PARTITION BY o_orderkey ORDER BY abs(contribution) DESC, idx ROWS UNBOUNDED PRECEDING) / nullif(sum(abs(contribution)) OVER (PARTITION BY o_orderkey), 0), 9) AS part FROM c) "
    "SELECT n AS rules, count(*) AS rows FROM (SELECT o_orderkey, CAST(CASE WHEN count(part) = 0 THEN 0 ELSE count(CASE WHEN part < 0.9 THEN 1 END) + 1 END AS INTEGER) AS n FROM o GROUP BY o_orderkey) GROUP BY n"
)
def mass_cover_90(spark, sf_dir):
    df, acts = served(spark, sf_dir)
    n = metrics.rules_to_cover(F.array(*[F.lit(c) * a for a, c in zip(acts, COEF, strict=True) if c]))
    return df.select(n.alias("rules")).groupBy("rules").agg(F.count(F.lit(1)).alias("rows"))


#: Of the six rules three are of one term; five have a coefficient: 0.8, 0.9 and 0.35 of one term, 1.1 and 0.6 of two.
RULE_METRICS_SQL = LONG_SQL + (
    ", acts AS (SELECT o_orderkey, " + " + ".join(f"z{i}" for i in range(len(RULES))) + " AS act, " + " + ".join(f"(z{i} > 1e-6)::INT" for i in range(len(RULES))) + " AS fired FROM s), "
    "d AS (SELECT *, CASE WHEN margin >= 0 THEN contribution ELSE -contribution END AS along, abs(contribution) AS a, row_number() OVER w AS r, sum(abs(contribution)) OVER (PARTITION BY o_orderkey) AS mass, "
    "round(sum(abs(contribution)) OVER (w ROWS UNBOUNDED PRECEDING) / nullif(sum(abs(contribution)) OVER (PARTITION BY o_orderkey), 0), 9) AS part FROM c WINDOW w AS (PARTITION BY o_orderkey ORDER BY abs(contribution) DESC, idx)), "
    "e AS (SELECT o_orderkey, any_value(margin) AS margin, greatest(0.0::DOUBLE, 1 - (2 * any_value(y) - 1) * any_value(margin)) AS slack, count(CASE WHEN a > 1e-8 THEN 1 END) AS contributing, "
    "CASE WHEN any_value(mass) > 0 THEN count(CASE WHEN part < 0.9 THEN 1 END) + 1 ELSE 0 END AS to90, CASE WHEN any_value(mass) > 0 THEN sum(CASE WHEN r <= 1 THEN a ELSE 0 END) / any_value(mass) ELSE 0 END AS top1, "
    "CASE WHEN any_value(mass) > 0 THEN sum(CASE WHEN r <= 5 THEN a ELSE 0 END) / any_value(mass) ELSE 0 END AS top5, sum(greatest(along, 0.0::DOUBLE)) AS supporting, sum(greatest(-along, 0.0::DOUBLE)) AS opposing FROM d GROUP BY o_orderkey) "
    "SELECT 15.0::DOUBLE AS candidate_rules, 6.0::DOUBLE AS n_rules, 0.4::DOUBLE AS retained_rule_ratio, 2.0::DOUBLE AS screened_features, 1.0::DOUBLE AS screened_feature_ratio, 5.0::DOUBLE AS support_rule_count, "
    "round(5 / 6.0::DOUBLE, 6) AS support_rule_ratio, 1.5::DOUBLE AS avg_rule_length, 1.4::DOUBLE AS avg_support_rule_length, round((0.8 + 0.9 + 0.35 + 2 * 1.1 + 2 * 0.6)::DOUBLE / 3.75, 6) AS weighted_rule_length, "
    "3.75::DOUBLE AS coef_l1, round(sqrt(0.8 * 0.8 + 0.9 * 0.9 + 0.35 * 0.35 + 1.1 * 1.1 + 0.6 * 0.6::DOUBLE), 6) AS coef_l2, 5.45::DOUBLE AS length_weighted_complexity, "
    "(SELECT round(avg(act / 6), 6) FROM acts) AS mean_rule_activation, (SELECT round(avg(fired), 6) FROM acts) AS mean_fired_rules_per_sample, round(avg(contributing), 6) AS mean_contributing_rules_per_sample, "
    "round(avg(to90), 6) AS mean_rules_for_90pct_contribution, round(avg(top1), 6) AS top1_abs_contribution_share, round(avg(top5), 6) AS top5_abs_contribution_share, "
    "0.0::DOUBLE AS explanation_fidelity_max_abs_error, 0.0::DOUBLE AS explanation_fidelity_mean_abs_error, round(avg(abs(margin)), 6) AS mean_abs_margin, "
    "round(avg(supporting), 6) AS mean_supporting_contribution, round(avg(opposing), 6) AS mean_opposing_contribution, round(avg(supporting - opposing), 6) AS mean_contrastive_gap, "
    "round(avg(CASE WHEN supporting + opposing > 0 THEN supporting / (supporting + opposing) ELSE 0 END), 6) AS mean_contrastive_ratio, round(avg(slack), 6) AS mean_slack, "
    "round(avg(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (0.5 - slack) / 0.5))), 6) AS cleanly_classified_membership, "
    "round(avg(least(greatest(0.0::DOUBLE, least(1.0::DOUBLE, slack)), greatest(0.0::DOUBLE, least(1.0::DOUBLE, 2 - slack)))), 6) AS borderline_membership, "
    "round(avg(greatest(0.0::DOUBLE, least(1.0::DOUBLE, slack - 1))), 6) AS strong_violation_membership FROM e"
)


@query(RULE_METRICS_SQL)
def rule_metrics(spark, sf_dir):
    df, acts = served(spark, sf_dir)
    out = metrics.rule_metrics(df, F.array(*acts), COEF, [r.length for r in RULES], INTERCEPT, explain.checked_sign(F.col("y"), CLASSES), 15, 2, 2, F.col("margin"))
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


def auc_sql(score: str, status: str) -> str:
    """The rank-sum AUC of one status against the rest."""
    return (
        f"(SELECT (sum(CASE WHEN p THEN r ELSE 0 END) - sum(p::INT) * (sum(p::INT) + 1) / 2.0::DOUBLE) / (sum(p::INT)::DOUBLE * sum((NOT p)::INT)) FROM "
        f"(SELECT o_orderstatus = '{status}' AS p, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0::DOUBLE AS r FROM t))"
    )


@query(SERVED_SQL + ", t AS (SELECT z0, z1, z2, o_orderstatus FROM s JOIN orders USING (o_orderkey)) SELECT round((" + " + ".join(auc_sql(f"z{i}", c) for i, c in enumerate("FOP")) + ") / 3, 9) AS roc_auc")
def roc_auc_ovr(spark, sf_dir):
    df, acts = served(spark, sf_dir)
    status = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    each = df.select("o_orderkey", *[acts[i].alias(f"z{i}") for i in range(3)]).join(status, F.col("o_orderkey") == F.col("k"))
    return metrics.roc_auc_ovr(each, "o_orderstatus", {c: f"z{i}" for i, c in enumerate("FOP")}).select(rounded(F.col("roc_auc"), 9).alias("roc_auc"))


@query(SERVED_SQL + ", g AS (SELECT list_sort([z0, z1, z2], 'DESC') AS x FROM s) SELECT round(avg(x[1] - x[2]), 6) AS mean_margin_gap, round(median(x[1] - x[2]), 6) AS median_margin_gap FROM g")
def margin_gap(spark, sf_dir):
    df, acts = served(spark, sf_dir)
    out = metrics.margin_gap_stats(df.select(F.array(*acts[:3]).alias("s")), F.col("s"))
    return spark.createDataFrame([tuple(round(v, 6) for v in out.values())], ", ".join(f"{k} double" for k in out))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def keep_first(spark, sf_dir):
    return metrics.keep_first(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


# ---- Comparison of models: segments as data sets, priorities as models

SCORES_SQL = "scores AS (SELECT c_mktsegment AS dataset, o_orderpriority AS model, round(avg(o_totalprice), 4) AS score, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def scores(spark, sf_dir) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("model")).agg(F.round(F.avg("o_totalprice"), 4).alias("score"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCORES_SQL} SELECT model, round(avg(score), 4) AS mean, round(coalesce(stddev_samp(score), 0), 4) AS std, round(median(score), 4) AS median, round(quantile_cont(score, 0.25), 4) AS q25, round(quantile_cont(score, 0.75), 4) AS q75, count(score) AS n FROM scores GROUP BY model")
def fold_rollup(spark, sf_dir):
    out = metrics.roll_up(scores(spark, sf_dir).withColumn("metric", F.lit("score")), ["model"], value="score")
    return out.select("model", *[F.round(c, 4).alias(c) for c in ("mean", "std", "median", "q25", "q75")], "n")


@query(f"WITH {SCORES_SQL} SELECT dataset, model, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0::DOUBLE AS rank FROM scores")
def friedman_ranks(spark, sf_dir):
    return statistics.average_ranks(scores(spark, sf_dir), "dataset", "score").select("dataset", "model", "rank")


@query(
    f"WITH {SCORES_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0::DOUBLE AS r FROM scores), "
    "k AS (SELECT count(DISTINCT model) AS k, count(DISTINCT dataset) AS n FROM scores), s AS (SELECT sum(t * t) AS q FROM (SELECT sum(r) AS t FROM r GROUP BY model)), g AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*) AS c FROM scores GROUP BY dataset, score)), "
    "x AS (SELECT (12.0::DOUBLE / (n * k * (k + 1)) * q - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))) AS chi2 FROM k, s, g) "
    # Five models leave four degrees of freedom, for which the tail has a closed form.
    "SELECT round(chi2, 6) AS chi2, round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) AS p FROM x"
)
def friedman_statistic(spark, sf_dir):
    chi, p = statistics.friedman(scores(spark, sf_dir), "dataset", "model", "score")
    return spark.createDataFrame([(round(chi, 6), round(p, 6))], "chi2 double, p double")


P_SQL = "ps AS (SELECT dataset, model, round(1.0::DOUBLE / (1 + n), 9) AS p FROM scores)"


@query(f"WITH {SCORES_SQL}, {P_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY p, model) AS r, count(*) OVER (PARTITION BY dataset) AS m FROM ps) SELECT dataset, model, round(max(least(1.0::DOUBLE, p * (m - r + 1))) OVER (PARTITION BY dataset ORDER BY p, model ROWS UNBOUNDED PRECEDING), 8) AS p_holm FROM o")
def holm_correction(spark, sf_dir):
    p = scores(spark, sf_dir).select("dataset", "model", F.round(1.0 / (1 + F.col("n")), 9).alias("p"))
    return statistics.holm_table(p, "dataset", "p", "model").select("dataset", "model", F.round("p_holm", 8).alias("p_holm"))


@query(f"WITH {SCORES_SQL}, d AS (SELECT b.score - a.score AS delta FROM scores a JOIN scores b USING (dataset) WHERE a.model = '1-URGENT' AND b.model = '5-LOW') SELECT count(CASE WHEN delta > 0 THEN 1 END) AS wins, count(CASE WHEN abs(delta) <= 1e-8 THEN 1 END) AS ties, count(CASE WHEN delta < 0 THEN 1 END) AS losses, round(avg(delta), 4) AS mean_delta, round(median(delta), 4) AS median_delta FROM d")
def wtl_deltas(spark, sf_dir):
    out = statistics.wins_ties_losses(statistics.paired_deltas(scores(spark, sf_dir), "1-URGENT", "5-LOW", "dataset", "model", "score"))
    return out.select("wins", "ties", "losses", F.round("mean_delta", 4).alias("mean_delta"), F.round("median_delta", 4).alias("median_delta"))


FOLDS_SQL = "folds AS (SELECT c_mktsegment AS dataset, c_nationkey % 3 AS fold, o_orderpriority AS model, avg(o_totalprice) AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


def fold_scores(spark, sf_dir) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("dataset"), (F.col("c_nationkey") % 3).alias("fold"), F.col("o_orderpriority").alias("model")).agg(F.avg("o_totalprice").alias("score"))


@query(f"WITH {FOLDS_SQL} SELECT dataset, fold, round(b.score - a.score, 4) AS delta FROM folds a JOIN folds b USING (dataset, fold) WHERE a.model = '1-URGENT' AND b.model = '5-LOW'")
def fold_deltas(spark, sf_dir):
    out = statistics.paired_deltas(fold_scores(spark, sf_dir), "1-URGENT", "5-LOW", ["dataset", "fold"], "model", "score")
    return out.withColumn("delta", F.round("delta", 4))


@query(f"WITH {SCORES_SQL}, {FOLDS_SQL}, m AS (SELECT dataset, model, median(score) AS median, count(score) AS folds FROM folds WHERE dataset <> 'BUILDING' GROUP BY ALL) SELECT dataset, model, score, round(median, 4) AS median, folds FROM scores LEFT JOIN m USING (dataset, model)")
def summary_with_medians(spark, sf_dir):
    folds = fold_scores(spark, sf_dir).filter("dataset <> 'BUILDING'")
    return statistics.with_medians(scores(spark, sf_dir).drop("n"), folds, ["dataset", "model"], "score").withColumn("median", F.round("median", 4))


@query(f"WITH {FOLDS_SQL}, s AS (SELECT model, coalesce(stddev_samp(score), 0) AS std, count(*) AS n FROM folds WHERE dataset IN ('AUTOMOBILE', 'MACHINERY') GROUP BY model) SELECT model, round(std / sqrt(n), 4) AS standard_error FROM s")
def standard_errors(spark, sf_dir):
    some = fold_scores(spark, sf_dir).filter(F.col("dataset").isin("AUTOMOBILE", "MACHINERY")).withColumn("metric", F.lit("score"))
    return metrics.roll_up(some, ["model"], value="score").select("model", F.round(F.col("std") / F.sqrt("n"), 4).alias("standard_error"))


TERM_COEF = {"low": -0.6, "medium": 0.25, "high": 0.9}


@query(
    f"WITH {ORDERS_SQL}, {anchors_sql('ords', ORDERS)}, {terms_sql('ords', ORDERS, 'o_orderkey')}, c AS (" + " UNION ALL ".join(f"SELECT o_orderkey, {3 * i + j} AS idx, '{f} {t}' AS membership, {c}::DOUBLE * m_{f}_{t} AS contribution FROM mem" for i, f in enumerate(ORDERS) for j, (t, c) in enumerate(TERM_COEF.items()))
    + ") SELECT o_orderkey, membership, round(contribution, 6) + 0.0::DOUBLE AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(contribution) DESC, idx) AS r FROM c WHERE abs(contribution) > 1e-8) WHERE r <= 3"
)
def membership_explain(spark, sf_dir):
    df = orders(spark, sf_dir)
    singles = [Rule((Condition(f, t),)) for f in range(len(ORDERS)) for t in TERMS]
    names = [f"{ORDERS[r.conditions[0].feature]} {r.conditions[0].term}" for r in singles]
    items = explain.contributions(activations(singles, prepare.anchors(df, ORDERS)), [TERM_COEF[r.conditions[0].term] for r in singles], names)
    each = df.select("o_orderkey", F.explode(explain.strongest(items, 3, 1e-8)).alias("x"))
    return each.select("o_orderkey", F.col("x.rule").alias("membership"), (rounded(F.col("x.contribution")) + 0.0).alias("contribution"))


@query(f"WITH {SCORES_SQL}, b AS (SELECT n, max(score) AS score FROM scores GROUP BY n) SELECT n, score FROM (SELECT *, max(score) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b) WHERE before IS NULL OR score > before")
def pareto_frontier(spark, sf_dir):
    return metrics.pareto(scores(spark, sf_dir), "n", "score")


@query(f"WITH {SCORES_SQL} SELECT dataset, model, score FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY score DESC, model) AS r FROM scores) WHERE r = 1")
def best_per_dataset(spark, sf_dir):
    return metrics.best_per_group(scores(spark, sf_dir), "dataset", "score", "model").select("dataset", "model", "score")


@query("WITH s AS (SELECT c_nationkey % 5 AS fold, list(DISTINCT right(c_name, 3)) AS items FROM customer GROUP BY 1) SELECT round(coalesce(avg(len(list_intersect(a.items, b.items))::DOUBLE / len(list_distinct(list_concat(a.items, b.items)))), 1), 9) AS jaccard FROM s a JOIN s b ON a.fold < b.fold")
def jaccard_stability(spark, sf_dir):
    sets = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 5).alias("fold")).agg(F.collect_set(F.right("c_name", F.lit(3))).alias("items"))
    return metrics.jaccard_stability(sets, "fold", "items").select(rounded(F.col("jaccard"), 9).alias("jaccard"))


@query("WITH c AS (SELECT o_orderpriority AS grp, o_orderstatus AS v, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL) SELECT grp, CAST(count(*) AS BIGINT) AS n_distinct, arg_max(v, (n, -first)) AS mode FROM c GROUP BY grp")
def param_mode(spark, sf_dir):
    return metrics.most_common(table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "grp"), ["grp"], "o_orderstatus", "o_orderkey").select("grp", "n_distinct", "mode")


@query("WITH s AS (SELECT c_mktsegment, c_nationkey % 2 AS half, c_acctbal FROM customer), p AS (SELECT c_mktsegment AS dataset, round(avg(CASE WHEN half = 0 THEN c_acctbal END), 4) AS a, round(avg(CASE WHEN half = 1 THEN c_acctbal END), 4) AS b FROM s GROUP BY 1) SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL")
def pivot_models(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("dataset"), (F.col("c_nationkey") % 2).alias("half"), "c_acctbal")
    return df.groupBy("dataset").pivot("half", [0, 1]).agg(F.round(F.avg("c_acctbal"), 4)).toDF("dataset", "a", "b").dropna()


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT k) AS BIGINT) AS different FROM (SELECT l_orderkey AS k FROM lineitem UNION ALL SELECT o_orderkey FROM orders)")
def union_all_scan(spark, sf_dir):
    both = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).unionByName(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")))
    return both.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("different"))


@query(
    # A resample draws a row as often as u lies above the thresholds of a Poisson count of mean 1; u is a remainder modulo a prime.
    "WITH ids AS (SELECT value AS v, (event_id % 1000003 + 1)::HUGEINT AS i FROM events), b AS (SELECT unnest(range(2000))::HUGEINT AS b), "
    "u AS (SELECT b, v, i, (((i * 40503 % 1000003) * (2 * b + 1)) % 1000003 + b * b * 9973) % 1000003 AS x FROM ids, b), "
    "t AS (SELECT b, v, (x * x % 1000003) * (i * i % 1000003 + b) % 1000003 AS u FROM u), "
    "w AS (SELECT b, v, (u >= 367880)::INT + (u >= 735761)::INT + (u >= 919701)::INT + (u >= 981014)::INT + (u >= 996343)::INT + (u >= 999408)::INT + (u >= 999919)::INT AS n FROM t), "
    "m AS (SELECT sum(v * n) / sum(n) AS m FROM w GROUP BY b) SELECT (SELECT round(avg(value), 6) FROM events) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m"
)
def bootstrap_ci(spark, sf_dir):
    out = statistics.bootstrap_mean(table(spark, sf_dir, "events"), "value", row_id="event_id")
    return out.select(*[rounded(F.col(c)).alias(c) for c in ("mean", "low", "high")])


# ---- Canonical basis


def _monomial_sql(m) -> str:
    return " * ".join(f"m_{LINES[c.feature]}_{c.term}" for c in m) or "1.0::DOUBLE"


BASIS = quotient.canonical_basis(len(LINES), 2)


@query(f"WITH {LINES_SQL}, {anchors_sql('lines', LINES)}, {terms_sql('lines', LINES, 'y')} " + " UNION ALL ".join(f"SELECT '{quotient.monomial_text(m)}' AS monomial, round(avg({_monomial_sql(m)}), 6) AS mean FROM mem" for m in BASIS.monomials))
def canonical_features(spark, sf_dir):
    df = lines(spark, sf_dir)
    psi = quotient.feature_arrays(BASIS, prepare.anchors(df, LINES))
    each = [F.struct(F.lit(quotient.monomial_text(m)).alias("monomial"), rounded(F.avg(x)).alias("mean")) for m, x in zip(BASIS.monomials, psi, strict=True)]
    return df.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query(
    "WITH o(term, part, sign) AS (VALUES ('low', 'low', 1), ('high', 'high', 1), ('medium', '', 1), ('medium', 'low', -1), ('medium', 'high', -1)) "
    "SELECT a.term AS term0, b.term AS term1, a.part AS part0, b.part AS part1, CAST(a.sign * b.sign AS INTEGER) AS coefficient FROM o a, o b"
)
def canonical_expand(spark, sf_dir):
    basis = quotient.canonical_basis(2, 2)
    rows = []
    for a in TERMS:
        for b in TERMS:
            for i, k in quotient.expand_rule(Rule((Condition(0, a), Condition(1, b))), basis).items():
                part = {c.feature: c.term for c in basis.monomials[i]}
                rows.append((a, b, part.get(0, ""), part.get(1, ""), k))
    return spark.createDataFrame(rows, "term0 string, term1 string, part0 string, part1 string, coefficient int")


@query("SELECT d, CAST(1 + 2 * d + 4 * d * (d - 1) // 2 AS BIGINT) AS canonical, CAST(1 + 3 * d + 9 * d * (d - 1) // 2 AS BIGINT) AS grammar FROM (SELECT unnest(generate_series(1, 46)) AS d)")
def basis_dimensions(spark, sf_dir):
    return spark.createDataFrame([(d, quotient.canonical_dimension(d, 2), quotient.original_grammar_size(d, 2)) for d in range(1, 47)], "d long, canonical long, grammar long")


@query("""SELECT slug, task, n_rows::BIGINT AS n_rows, n_features::BIGINT AS n_features FROM (VALUES
    ('breast_cancer_diagnostic', 'binary', 569, 30),
    ('breast_cancer_original', 'binary', 699, 9),
    ('mammographic_mass', 'binary', 961, 5),
    ('breast_tissue', 'multiclass', 106, 9),
    ('heart_cleveland', 'binary', 303, 13),
    ('statlog_heart', 'binary', 270, 13),
    ('spect_heart', 'binary', 267, 22),
    ('spectf_heart', 'binary', 267, 44),
    ('pima_diabetes', 'binary', 768, 8),
    ('diabetic_retinopathy_debrecen', 'binary', 1151, 19),
    ('parkinsons', 'binary', 195, 22),
    ('parkinsons_disease_classification', 'binary', 756, 754),
    ('ilpd', 'binary', 583, 10),
    ('dermatology', 'multiclass', 366, 34),
    ('haberman_survival', 'binary', 306, 3),
    ('vertebral_column_2c', 'binary', 310, 6),
    ('arrhythmia_binary', 'binary', 452, 279),
    ('iris', 'multiclass', 150, 4),
    ('wine', 'multiclass', 178, 13),
    ('digits', 'multiclass', 1797, 64)
) AS t(slug, task, n_rows, n_features)""")
def dataset_registry(spark, sf_dir):
    return datasets.registry(spark).select("slug", "task", "n_rows", "n_features")


# ---- Fits: coefficients aren't SQL; tests hold them against optimality and invariance


def _coefficients(spark, names, values, intercept) -> DataFrame:
    return spark.createDataFrame([*((n, float(v)) for n, v in zip(names, values, strict=True)), ("intercept", float(intercept))], "term string, coefficient double")


def _fitted(model, df, features) -> DataFrame:
    model.fit(df, "y", features)
    names = [quotient.monomial_text(m) for m in model.basis_.monomials[1:]] if hasattr(model, "basis_") else model.feature_names_out()
    return _coefficients(df.sparkSession, names, model.coef_, model.intercept_)


@query()
def frs_fit(spark, sf_dir):
    return _fitted(FuzzyRuleSVM(max_rules=24, class_weight="balanced"), orders(spark, sf_dir), ORDERS)


@query()
def frs_column_generation(spark, sf_dir):
    return _fitted(FuzzyRuleSVM(max_rules=8, rule_generation="column_generation"), orders(spark, sf_dir), ORDERS)


@query()
def membership_svm_fit(spark, sf_dir):
    return _fitted(MembershipSVM(), events(spark, sf_dir), EVENTS)


@query()
def membership_logit(spark, sf_dir):
    return _fitted(MembershipLogisticL1(), orders(spark, sf_dir), ORDERS)


@query()
def csrq_fit(spark, sf_dir):
    return _fitted(CSRQClassifier(), orders(spark, sf_dir), ORDERS)


def _atoms() -> list[quotient.Atom]:
    return [quotient.Atom(Rule((Condition(f, t),))) for f in (0, 1) for t in TERMS]


@query()
def csrq_dictionary_fit(spark, sf_dir):
    return _fitted(CSRQClassifier(max_rule_length=1, semantic_space="dictionary", rule_dictionary=_atoms()), orders(spark, sf_dir), ORDERS)


@query()
def atomic_fit(spark, sf_dir):
    return _fitted(QuotientAtomicSVM(_atoms(), max_rule_length=1), orders(spark, sf_dir), ORDERS)


@query()
def one_vs_rest_fit(spark, sf_dir):
    df = embedded(spark, sf_dir)
    model = OneVsRest(lambda: FuzzyRuleSVM(max_rule_length=1)).fit(df, "label")
    return metrics.confusion_metrics(model.predict(df), "label", "prediction")


# ---- Fuzzy association rules


def _association_sql(depth_one: list[tuple[str, int]]) -> str:
    """All single labels and pairs with their class, support and confidence; a pair's labels must be frequent for the class and not sure themselves."""
    cell = lambda f, t: f"d_{f}_{t}"
    degree = ", ".join(f"greatest(0.0::DOUBLE, 1 - abs(({f} - {f}_lo)::DOUBLE / (({f}_hi - {f}_lo)::DOUBLE / 4) - {t})) AS {cell(f, t)}" for f, t in depth_one)
    pairs = [(a, b) for i, a in enumerate(depth_one) for b in depth_one[i + 1 :] if a[0] != b[0]]
    sums = lambda x: f"sum(CASE WHEN y = 0 THEN {x} ELSE 0 END) AS s0, sum(CASE WHEN y = 1 THEN {x} ELSE 0 END) AS s1 FROM deg"
    name = lambda f, t: f"'{f} {t + 1}'"
    ones = " UNION ALL ".join(f"SELECT {name(*a)} AS a, {sums(cell(*a))}" for a in depth_one)
    twos = " UNION ALL ".join(f"SELECT {name(*a)} AS a, {name(*b)} AS b, {sums(cell(*a) + ' * ' + cell(*b))}" for a, b in pairs)
    long = lambda t, keep: f"SELECT {keep}, k AS label, CASE WHEN k = 0 THEN s0 ELSE s1 END AS s, s0 + s1 AS total FROM {t}, (VALUES (0), (1)) AS v(k)"
    bounds = ", ".join(f"min({f}) AS {f}_lo, max({f}) AS {f}_hi" for f in LINES)
    out = "round(s / n, 9) AS support, round(s / total, 9) AS confidence"
    return (
        f"WITH {LINES_SQL}, b AS (SELECT {bounds} FROM lines), deg AS MATERIALIZED (SELECT y, {degree} FROM lines, b), n AS (SELECT y AS label, count(*) AS n_c, sum(count(*)) OVER () AS n FROM lines GROUP BY y), "
        f"ones AS ({ones}), twos AS ({twos}), one AS (SELECT * FROM ({long('ones', 'a')}) JOIN n USING (label) WHERE s >= 0.05::DOUBLE * n_c), "
        f"two AS (SELECT * FROM ({long('twos', 'a, b')}) JOIN n USING (label) WHERE s >= 0.05::DOUBLE * n_c), sure AS (SELECT a, label FROM one WHERE s / total <= 0.8) "
        f"SELECT a AS antecedent, label::INTEGER AS label, {out} FROM one UNION ALL SELECT a || ' & ' || b, label::INTEGER, {out} FROM two JOIN sure x USING (a, label) JOIN sure z ON z.a = two.b AND z.label = two.label"
    )


def _association_table(spark, model, rules) -> DataFrame:
    rows = [(" & ".join(f"{model.features_[f]} {t + 1}" for f, t in r.items), int(r.label), round(r.support, 9), round(r.confidence, 9)) for r in rules]
    return spark.createDataFrame(rows, "antecedent string, label int, support double, confidence double")


@query(_association_sql([(f, t) for f in LINES for t in range(5)]))
def association_rules(spark, sf_dir):
    model, df = FuzzyAssociationClassifier(), lines(spark, sf_dir)
    return _association_table(spark, model, model.search(model._rows(df, "y", LINES)))


@query()
def association_fit(spark, sf_dir):
    model = FuzzyAssociationClassifier(population=20, evaluations=60).fit(orders(spark, sf_dir), "y", ORDERS)
    return _association_table(spark, model, model.rules_)


# ---- Unordered fuzzy rules

STEPS = ["l_quantity", "l_discount", "l_tax"]


@query(
    "WITH v AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS v, l_returnflag AS y FROM lineitem" for f in STEPS) + "), "
    "h AS (SELECT feature, v, k, count(CASE WHEN y = k THEN 1 END) AS p, count(*) AS t FROM v, (SELECT DISTINCT l_returnflag AS k FROM lineitem) GROUP BY feature, v, k), "
    "c AS (SELECT *, sum(p) OVER w AS pb, sum(t) OVER w AS tb, sum(p) OVER (PARTITION BY feature, k) AS pa, sum(t) OVER (PARTITION BY feature, k) AS ta FROM h WINDOW w AS (PARTITION BY feature, k ORDER BY v)), "
    "x AS (SELECT feature, k, v, true AS at_most, pb AS p, tb AS t, pa, ta FROM c UNION ALL SELECT feature, k, v, false, pa - pb + p, ta - tb + t, pa, ta FROM c), "
    "g AS (SELECT *, CASE WHEN t < ta THEN round(p * (log2((p + 1) / (t + 1)::DOUBLE) - log2((pa + 1) / (ta + 1)::DOUBLE)), 9) ELSE 0 END AS gain FROM x) "
    "SELECT k AS label, feature, at_most, v AS cut, round(gain, 6) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY feature, k ORDER BY gain DESC, at_most DESC, v) AS r FROM g) WHERE r = 1 AND gain > 0"
)
def condition_gains(spark, sf_dir):
    """The best condition of each feature for each class, from one histogram."""
    model, df = UnorderedFuzzyRules(), table(spark, sf_dir, "lineitem")
    rows = model._rows(df, "l_returnflag", STEPS)
    model.cuts_ = model._cuts(df)
    hist = model.histogram(rows)
    out = []
    for k, c in enumerate(model.classes_):
        for f, name in enumerate(STEPS):
            gain, test, _ = best_test(hist[k][f : f + 1], model.cuts_[f : f + 1])
            if test:
                out.append((c, name, test[1], float(model.cuts_[f][test[2]]), round(gain, 6)))
    return spark.createDataFrame(out, "label string, feature string, at_most boolean, cut double, gain double")


def embedded(spark, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings")
    width = df.agg(F.max(F.size("embedding"))).first()[0]
    return df.select("label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(width)])


@query()
def unordered_fit(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", *STEPS)
    model = UnorderedFuzzyRules().fit(df, "l_returnflag")
    return metrics.confusion_metrics(model.predict(df), "l_returnflag", "prediction")


# ---- Explainable boosting


def _gradients_sql(view: str, features, bins: int) -> str:
    """Sums of gradient and curvature in each bin where every row still has the log-odds of the table."""
    cuts = " UNION ".join(f"SELECT '{f}' AS feature, quantile_cont({f}, {k / bins}) AS cut FROM {view}" for f in features for k in range(1, bins))
    long = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f}::DOUBLE AS v, y FROM {view}" for f in features)
    return (
        f"cuts AS ({cuts}), long AS ({long}), bins AS (SELECT feature, v, (SELECT count(*) FROM cuts c WHERE c.feature = d.feature AND c.cut < d.v) AS b FROM (SELECT DISTINCT feature, v FROM long) d), "
        f"p AS (SELECT avg(y::DOUBLE) AS p FROM {view}), cells AS (SELECT feature, b, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS ones FROM long JOIN bins USING (feature, v) GROUP BY ALL) "
        "SELECT feature, b::INTEGER AS bin, round(ones - n * p + 1e-8::DOUBLE, 5) + 0.0::DOUBLE AS gradient, round(n * p * (1 - p) + 1e-8::DOUBLE, 5) AS curvature, n AS weight FROM cells, p"
    )


@query(f"WITH {LINES_SQL}, {_gradients_sql('lines', LINES, 16)}")
def boosting_gradients(spark, sf_dir):
    """What the first pass of boosting sums. Curvatures are fractions that may end in a 5 where they are rounded, so both sides add a little first."""
    model = ExplainableBoosting()
    rows = model.prepare_rows(lines(spark, sf_dir), "y", LINES)
    s0, s1 = rows.agg(F.sum("s0"), F.sum("s1")).first()
    model.start_ = math.log(s1 / s0)
    _, sums = model.sums(rows, [], [], [], range(len(LINES)))
    out = [(f, k, round(float(g) + 1e-8, 5) + 0.0, round(float(h) + 1e-8, 5), float(w)) for f, x in zip(LINES, sums, strict=True) for k, (g, h, w) in enumerate(x.T) if w]
    return spark.createDataFrame(out, "feature string, bin int, gradient double, curvature double, weight double")


@query()
def boosting_fit(spark, sf_dir):
    model = ExplainableBoosting(interactions=1, rounds=20, pair_rounds=10).fit(orders(spark, sf_dir), "y", ORDERS)
    return spark.createDataFrame([(t, k, round(v, 6) + 0.0) for t, k, v in model.shape_table()], "term string, bin int, value double")


@query()
def synthetic_regimes(spark, sf_dir):
    made = [f(spark, 400, 2, 1) for f in (synthetic.additive_main_effects, synthetic.pairwise_fuzzy_interaction, synthetic.xor_interaction, synthetic.sparse_rule_ground_truth)]
    out = None
    for m in made:
        one = m.data.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("positives")).select(F.lit(m.regime).alias("regime"), F.lit(len(m.feature_names)).alias("features"), "n", "positives")
        out = one if out is None else out.union(one)
    return out


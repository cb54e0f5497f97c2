"""Land-change queries over orders: a customer is a cell, the leading digit of the priority its class, the price its area."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accuracy, change, markov, sampling
from ..session import kept
from .common import query, rounded, table

FIRST, LAST, YEARS = (1995, 1996), (1999, 2000), 4.0


def _within(years: tuple[int, int]):
    """Orders of some years, by bounds that reach the scan."""
    return (F.col("o_orderdate") >= F.make_date(F.lit(years[0]), F.lit(1), F.lit(1))) & (F.col("o_orderdate") < F.make_date(F.lit(years[1] + 1), F.lit(1), F.lit(1)))


def _by_period(spark: SparkSession, d: str, **periods: tuple[int, int]) -> DataFrame:
    o = table(spark, d, "orders")
    some = functools.reduce(operator.or_, (_within(y) for y in periods.values()))
    o = o.filter(some).select("o_custkey", "o_orderdate", F.substring("o_orderpriority", 1, 1).cast("int").alias("class_id"), "o_totalprice")
    return change.dominant_by_period(o, "o_custkey", "class_id", "o_totalprice", {k: _within(y) for k, y in periods.items()})


def units(spark: SparkSession, d: str, years: tuple[int, int]) -> DataFrame:
    return _by_period(spark, d, only=years).select("o_custkey", F.col("class_only").alias("class_id"), F.col("area_only").alias("area"))


def _units_sql(name: str, years: tuple[int, int]) -> str:
    return f"""{name}_n AS (SELECT o_custkey, substr(o_orderpriority, 1, 1)::INTEGER AS class_id, count(*) AS n, sum(o_totalprice) AS s FROM orders
    WHERE year(o_orderdate) BETWEEN {years[0]} AND {years[1]} GROUP BY ALL),
  {name} AS (SELECT o_custkey, arg_max(class_id, n * 1000 - class_id) AS class_id, sum(s) AS area FROM {name}_n GROUP BY o_custkey)"""


UNITS = "WITH " + _units_sql("u1", FIRST) + ",\n" + _units_sql("u2", LAST)
MATRIX = UNITS + ",\n  m AS (SELECT u1.class_id AS c_from, u2.class_id AS c_to, sum(u1.area) AS area, count(*) AS n FROM u1 JOIN u2 USING (o_custkey) GROUP BY ALL)"
PROB = MATRIX + ",\n  t AS (SELECT c_from, c_to, n / sum(n) OVER (PARTITION BY c_from) AS prob FROM m),\n  a1 AS (SELECT class_id, sum(area) AS area FROM u1 GROUP BY 1),\n  a2 AS (SELECT class_id, sum(area) AS area FROM u2 GROUP BY 1)"


def _matrix(spark, d):
    both = _by_period(spark, d, a=FIRST, b=LAST).filter("class_a IS NOT NULL AND class_b IS NOT NULL")
    return both.groupBy(F.col("class_a").alias("c_from"), F.col("class_b").alias("c_to")).agg(F.sum("area_a").alias("area"), F.count("*").alias("n"))


def _prob(spark, d):
    """Written once, since projections join it at every step; a row for each two classes."""
    return kept(change.probabilities(_matrix(spark, d)).select("c_from", "c_to", "prob"), "probabilities")


def _areas(spark, d, years):
    return kept(change.class_areas(units(spark, d, years), "class_id", "area"), "areas")


@query(MATRIX + " SELECT c_from, c_to, round(area, 2) AS area, n, round(n / sum(n) OVER (PARTITION BY c_from), 6) AS prob FROM m")
def transition_matrix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(change.probabilities(_matrix(spark, d)).withColumn("area", F.round("area", 2)))


@query(MATRIX + " SELECT c_from, c_to, round(area, 2) AS area, c_from || '->' || c_to AS label FROM m WHERE c_from <> c_to ORDER BY abs(area) DESC, c_from, c_to LIMIT 6")
def top_transitions(spark: SparkSession, d: str) -> DataFrame:
    return change.top_transitions(_matrix(spark, d)).select("c_from", "c_to", F.round("area", 2).alias("area"), "label")


@query(MATRIX + " SELECT 'lost' AS side, c_from AS class_id, round(sum(area), 2) AS area FROM m WHERE c_from <> c_to GROUP BY 2 UNION ALL SELECT 'gained', c_to, round(sum(area), 2) FROM m WHERE c_from <> c_to GROUP BY 2")
def transition_marginals(spark: SparkSession, d: str) -> DataFrame:
    m = _matrix(spark, d).filter("c_from <> c_to").selectExpr("inline(array(struct('lost' AS side, c_from AS class_id, area), struct('gained' AS side, c_to AS class_id, area)))")
    return m.groupBy("side", "class_id").agg(F.round(F.sum("area"), 2).alias("area"))


@query(MATRIX + " SELECT c_from * 10 + c_to AS code, (c_from * 10 + c_to) // 10 AS c_from, (c_from * 10 + c_to) % 10 AS c_to, n FROM m")
def transition_codes(spark: SparkSession, d: str) -> DataFrame:
    m = _matrix(spark, d).select((F.col("c_from") * 10 + F.col("c_to")).alias("code"), "n")
    return m.select("code", F.expr("cast(code div 10 AS int)").alias("c_from"), (F.col("code") % 10).alias("c_to"), "n")


@query(PROB + ", k AS (SELECT * FROM range(1, 9) x(a), range(1, 9) y(b)) SELECT a::INTEGER AS c_from, b::INTEGER AS c_to, round(coalesce(prob, 0), 6) AS prob FROM k LEFT JOIN t ON a = c_from AND b = c_to")
def transition_probability(spark: SparkSession, d: str) -> DataFrame:
    return rounded(change.dense(_prob(spark, d), list(range(1, 9))))


@query(UNITS + " SELECT k::INTEGER AS class_id, round(coalesce(sum(area), 0), 2) AS area FROM range(1, 9) x(k) LEFT JOIN u1 ON class_id = k GROUP BY k")
def class_areas(spark: SparkSession, d: str) -> DataFrame:
    every = spark.range(1, 9).selectExpr("cast(id AS int) AS class_id")
    return rounded(change.class_areas(units(spark, d, FIRST), "class_id", "area", every), 2)


@query("SELECT year(o_orderdate) AS year, substr(o_orderpriority, 1, 1)::INTEGER AS class_id, round(sum(o_totalprice), 2) AS area, round(sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY year(o_orderdate)) * 100, 6) AS share_pct FROM orders GROUP BY 1, 2")
def area_composition(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.year("o_orderdate").cast("long").alias("year"), F.substring("o_orderpriority", 1, 1).cast("int").alias("class_id"), "o_totalprice")
    return rounded(change.composition(change.class_areas(o, "class_id", "o_totalprice", by=["year"]), ["year"]).withColumn("area", F.round("area", 2)))


@query(PROB + " SELECT class_id, round(coalesce(a1.area, 0), 2) AS area_t1, round(coalesce(a2.area, 0), 2) AS area_t2, round(a2.area - a1.area, 2) AS net_change, round((a2.area - a1.area) / a1.area * 100, 6) AS pct_change, round(ln(a2.area / a1.area) / 4 * 100, 6) AS annual_rate_pct FROM a1 JOIN a2 USING (class_id)")
def change_rates(spark: SparkSession, d: str) -> DataFrame:
    t = change.change_table(_areas(spark, d, FIRST), _areas(spark, d, LAST), "class_id", YEARS)
    return rounded(t.withColumns({c: F.round(c, 2) for c in ("area_t1", "area_t2", "net_change")}))


@query("WITH y AS (SELECT year(o_orderdate) AS year, o_orderpriority AS class, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT class, round(arg_min(v, year), 2) AS first_value, round(arg_max(v, year), 2) AS last_value, round((arg_max(v, year) - arg_min(v, year)) / arg_min(v, year) * 100, 6) AS change_pct FROM y GROUP BY class")
def first_last_change(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("class")).agg(F.sum("o_totalprice").alias("v"))
    return rounded(change.first_last(y, ["class"], "year", "v").withColumns({c: F.round(c, 2) for c in ("first_value", "last_value")}))


STEP = "(SELECT c_to AS class_id, sum(area * prob) AS area FROM {0} JOIN t ON class_id = c_from GROUP BY 1)"


@query(PROB + ", p1 AS " + STEP.format("a2") + ", p2 AS " + STEP.format("p1") + ", p3 AS " + STEP.format("p2") + ", p4 AS " + STEP.format("p3") + " SELECT 1 AS steps, class_id, round(area, 2) AS area FROM p1 UNION ALL SELECT 4, class_id, round(area, 2) FROM p4")
def markov_project(spark: SparkSession, d: str) -> DataFrame:
    a, t = _areas(spark, d, LAST), _prob(spark, d)
    one = lambda n: markov.project(a, t, n).select(F.lit(n).alias("steps"), "class_id", F.round("area", 2).alias("area"))
    return one(1).unionByName(one(4))


CONSERVE, DEVELOP = [([1, 2], [3, 4, 5], 0.5), ([3], [2], 1.3)], [([1, 2], [3, 4, 5], 0.7)]


@query(PROB + """, s AS (SELECT 'base' AS scenario, c_from, c_to, prob AS x FROM t
  UNION ALL SELECT 'conservation', c_from, c_to, prob * CASE WHEN c_from IN (1, 2) AND c_to IN (3, 4, 5) THEN 0.5 WHEN c_from = 3 AND c_to = 2 THEN 1.3 ELSE 1 END FROM t
  UNION ALL SELECT 'agreement', c_from, c_to, prob * CASE WHEN c_from IN (1, 2) AND c_to IN (3, 4, 5) THEN 0.7 ELSE 1 END FROM t)
  SELECT scenario, c_from, c_to, round(x / sum(x) OVER (PARTITION BY scenario, c_from), 6) AS prob FROM s""")
def scenario_matrices(spark: SparkSession, d: str) -> DataFrame:
    t, out = _prob(spark, d), None
    for name, m in (("base", []), ("conservation", CONSERVE), ("agreement", DEVELOP)):
        s = markov.scenario(t, m).select(F.lit(name).alias("scenario"), "c_from", "c_to", "prob")
        out = s if out is None else out.unionByName(s)
    return rounded(out)


@query(PROB + """, k AS (SELECT *, CASE WHEN c_from = 2 AND c_to = 1 THEN least(prob, 0.05) WHEN c_from = 5 AND c_to = 1 THEN 0 ELSE prob END AS kept FROM t),
  r AS (SELECT c_from, c_to, kept + CASE WHEN c_from = c_to THEN sum(prob - kept) OVER (PARTITION BY c_from) ELSE 0 END AS x FROM k)
  SELECT c_from, c_to, round(x / sum(x) OVER (PARTITION BY c_from), 6) AS prob FROM r""")
def matrix_correction(spark: SparkSession, d: str) -> DataFrame:
    return rounded(markov.corrected(_prob(spark, d), [(2, 1, 0.05), (5, 1, 0.0)]))


@query(PROB + """, d AS (SELECT class_id, a1.area AS x, a2.area AS y FROM a1 JOIN a2 USING (class_id)),
  g AS (SELECT class_id, (y - x) / sum(y - x) OVER () AS part FROM d WHERE y > x)
  SELECT class_id AS c_from, class_id AS c_to, round(least(1, y / x), 6) AS prob FROM d
  UNION ALL SELECT d.class_id, g.class_id, round((x - y) / x * part, 6) FROM d, g WHERE y < x""")
def area_transitions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(markov.area_transitions(_areas(spark, d, FIRST), _areas(spark, d, LAST)))


@query(PROB + ", p AS " + STEP.format("a1") + """ SELECT round(sum(abs(p.area - a2.area)) / sum(a2.area) * 100, 6) AS rmae_pct,
  round(1 - sum(abs(p.area - a2.area)) / (2 * sum(a2.area)), 6) AS overall_accuracy,
  round(sum(least(p.area, a2.area)) / (sum(least(p.area, a2.area)) + sum(abs(p.area - a2.area))), 6) AS figure_of_merit FROM p JOIN a2 USING (class_id)""")
def hindcast_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(markov.hindcast(markov.project(_areas(spark, d, FIRST), _prob(spark, d)), _areas(spark, d, LAST)))


def _labelled(spark, d):
    """Quality labels against a rule of thumb: long documents are good."""
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars", "lang"), "doc_id").select("doc_id", "lang", F.col("quality").alias("ref"), (F.col("n_chars") >= 1500).cast("int").alias("pred"))


LABELLED = "WITH l AS (SELECT doc_id, lang, quality AS ref, (n_chars >= 1500)::INTEGER AS pred FROM labels JOIN documents USING (doc_id)), c AS (SELECT ref, pred, count(*) AS n FROM l GROUP BY 1, 2), r AS (SELECT ref AS k, sum(n)::DOUBLE AS r FROM c GROUP BY 1), q AS (SELECT pred AS k, sum(n)::DOUBLE AS q FROM c GROUP BY 1), h AS (SELECT ref AS k, n AS h FROM c WHERE ref = pred), z AS (SELECT sum(n)::DOUBLE AS n FROM c)"


@query(LABELLED + " SELECT ref, pred, n FROM c")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return accuracy.confusion(_labelled(spark, d), "ref", "pred")


@query(LABELLED + ", e AS (SELECT sum(r * q) / any_value(n * n) AS e FROM r JOIN q USING (k), z) SELECT n::BIGINT AS n, round(s / n, 6) AS overall_accuracy, round((s / n - e) / (1 - e), 6) AS kappa FROM z, e, (SELECT sum(h) AS s FROM h)")
def accuracy_overall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(accuracy.overall(confusion_matrix(spark, d)))


@query(LABELLED + " SELECT k AS class_id, round(coalesce(h / r, 0), 6) AS producers, round(coalesce(h / q, 0), 6) AS users, round(2 * h / (r + q), 6) AS f1 FROM r FULL JOIN q USING (k) LEFT JOIN h USING (k)")
def accuracy_by_class(spark: SparkSession, d: str) -> DataFrame:
    return rounded(accuracy.by_class(confusion_matrix(spark, d)))


@query(LABELLED + ", j AS (SELECT r / n AS r, q / n AS q, h / n AS h FROM r JOIN q USING (k) JOIN h USING (k), z) SELECT round(sum(abs(r - q)) / 2, 6) AS qd, round(sum(least(r - h, q - h)), 6) AS ad, round(1 - sum(abs(r - q)) / 2 - sum(least(r - h, q - h)), 6) AS agreement FROM j")
def qd_ad(spark: SparkSession, d: str) -> DataFrame:
    return rounded(accuracy.disagreement(confusion_matrix(spark, d)))


def _mapped(spark, d):
    return table(spark, d, "documents").groupBy((F.col("n_chars") >= 1500).cast("int").alias("class_id")).agg(F.sum("n_chars").cast("double").alias("area"))


@query(LABELLED + """, a AS (SELECT (n_chars >= 1500)::INTEGER AS pred, sum(n_chars)::DOUBLE AS area FROM documents GROUP BY 1), w AS (SELECT pred, area / sum(area) OVER () AS w, sum(area) OVER () AS t FROM a),
  p AS (SELECT *, n / sum(n) OVER (PARTITION BY pred) AS p, sum(n) OVER (PARTITION BY pred) AS ni FROM c JOIN w USING (pred)),
  g AS (SELECT ref, sum(w * p) AS q, sqrt(sum(w * w * p * (1 - p) / (ni - 1))) AS s, any_value(t) AS t FROM p GROUP BY ref),
  o AS (SELECT ref, p AS u, w, ni FROM p WHERE ref = pred)
  SELECT ref AS class_id, round(q * t, 3) AS adjusted_area, round(s * t, 3) AS area_se, round(q * t - 1.96 * s * t, 3) AS ci_low, round(q * t + 1.96 * s * t, 3) AS ci_high,
    round(u, 3) AS users, round(sqrt(u * (1 - u) / (ni - 1)), 3) AS users_se, round(w * u / q, 3) AS producers, round(s / q, 3) AS producers_se FROM g JOIN o USING (ref)""")
def olofsson_area(spark: SparkSession, d: str) -> DataFrame:
    return rounded(accuracy.olofsson(confusion_matrix(spark, d), _mapped(spark, d)), 3)


@query(LABELLED + """, a AS (SELECT (n_chars >= 1500)::INTEGER AS pred, sum(n_chars)::DOUBLE AS area FROM documents GROUP BY 1), w AS (SELECT pred, area / sum(area) OVER () AS w FROM a),
  p AS (SELECT *, n / sum(n) OVER (PARTITION BY pred) AS p, sum(n) OVER (PARTITION BY pred) AS ni FROM c JOIN w USING (pred)),
  m AS (SELECT ref, pred, w * p AS p, CASE WHEN ref = pred THEN w * w * p * (1 - p) / (ni - 1) END AS v FROM p),
  r2 AS (SELECT ref AS k, sum(p) AS r FROM m GROUP BY 1), q2 AS (SELECT pred AS k, sum(p) AS q FROM m GROUP BY 1), h2 AS (SELECT ref AS k, p AS h FROM m WHERE ref = pred),
  j AS (SELECT * FROM r2 JOIN q2 USING (k) JOIN h2 USING (k))
  SELECT round(sum(h), 6) AS oa, round((SELECT sqrt(sum(v)) FROM m), 6) AS oa_se, round(sum(abs(r - q)) / 2, 6) AS qd, round(sum(least(r - h, q - h)), 6) AS ad FROM j""")
def olofsson_overall(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy and disagreement weighed by the map: their sum is one."""
    m, mapped = confusion_matrix(spark, d), _mapped(spark, d)
    one = accuracy.olofsson_overall(m, mapped).join(accuracy.disagreement(m, mapped))  # one row each
    return rounded(one.select("oa", "oa_se", "qd", "ad"))


STRATA = "WITH l AS (SELECT lang, c_ref AS ref, c_pred AS pred, count(*) AS n FROM (SELECT lang, n_chars % 7 AS c_ref, CASE WHEN doc_id % 10 < 7 THEN n_chars % 7 ELSE doc_id % 7 END AS c_pred FROM documents WHERE lang IS NOT NULL) GROUP BY ALL)"


@query(STRATA + """, m AS (SELECT lang, CASE WHEN ref = 6 THEN 3 ELSE ref END AS ref, pred, n FROM l), s AS (SELECT lang, ref, pred, sum(n)::DOUBLE AS n FROM m WHERE ref IN (1, 2, 3, 5) AND pred IN (1, 2, 3, 5) GROUP BY ALL),
  p AS (SELECT *, n / sum(n) OVER (PARTITION BY lang, pred) AS p, sum(n) OVER (PARTITION BY lang, pred) AS ni, 1 / 4.0::DOUBLE AS w FROM s)
  SELECT lang, ref AS class_id, round(sum(w * p) * 400, 4) AS adjusted_area, round(sqrt(sum(CASE WHEN ni > 1 THEN w * w * p * (1 - p) / (ni - 1) ELSE 0 END)) * 400, 4) AS area_se FROM p GROUP BY lang, ref""")
def olofsson_periods(spark: SparkSession, d: str) -> DataFrame:
    """A language is a period: seven classes, of which four are strata and one is merged; every stratum maps 100 hectares."""
    c = table(spark, d, "documents").filter("lang IS NOT NULL").select("lang", (F.col("n_chars") % 7).cast("long").alias("ref"), F.when(F.col("doc_id") % 10 < 7, F.col("n_chars") % 7).otherwise(F.col("doc_id") % 7).cast("long").alias("pred"))
    matrix = accuracy.strata(accuracy.confusion(c, "ref", "pred", ["lang"]), [1, 2, 3, 5], {6: 3}, ["lang"])
    mapped = c.select("lang").distinct().withColumn("class_id", F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 2, 3, 5))))).withColumn("area", F.lit(100.0))
    return rounded(accuracy.olofsson(matrix, mapped, ["lang"]).filter("adjusted_area > 0").select("lang", "class_id", "adjusted_area", "area_se"), 4)


DRAW = "(('0x' || substr(md5('42' || {0}), 1, 7))::BIGINT / 268435456.0)"


@query(f"SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {DRAW.format('c_custkey')}, c_custkey) AS k FROM customer) WHERE k <= 20")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.stratified(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 20)


@query(f"SELECT c_custkey, {DRAW.format('c_custkey')} < 0.7 AS is_training FROM customer")
def train_val_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query("WITH e AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 5 AS w FROM customer) SELECT least(floor((c_acctbal - lo) / w), 4)::INTEGER AS fold, count(*) AS n FROM customer, e GROUP BY 1")
def spatial_folds(spark: SparkSession, d: str) -> DataFrame:
    return sampling.folds(table(spark, d, "customer").select("c_acctbal"), "c_acctbal").groupBy("fold").agg(F.count("*").alias("n"))

"""Masks, composites, ecosystem models and series over lineitem, part, customer, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions.dims import CARBON, COVER, EXTERNAL, HABITAT, KC, RECHARGE, SENSITIVITY, sql_case
from ..operators import composite, ecosystem, trend
from .common import query, rounded, table


def _obs(spark, d):
    """A line is an observation: its six numbers are bands, its line number the quality bits, its part the cell."""
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_partkey").alias("cell_id"), F.col("l_linenumber").alias("qa"), (F.col("l_quantity") / 100).alias("blue"), (F.col("l_extendedprice") / 1e5).alias("green"), F.col("l_discount").alias("red"), (F.col("l_tax") + 0.1).alias("nir"), (F.col("l_quantity") / 60).alias("swir1"), (F.col("l_discount") + F.col("l_tax")).alias("swir2"))


OBS = "WITH o AS (SELECT l_partkey AS cell_id, l_linenumber AS qa, l_quantity / 100 AS blue, l_extendedprice / 1e5 AS green, l_discount AS red, l_tax + 0.1 AS nir, l_quantity / 60 AS swir1, l_discount + l_tax AS swir2 FROM lineitem)"


@query(OBS + " SELECT qa, count(*) AS n FROM o WHERE qa & 28 = 0 GROUP BY qa")
def qa_bit_filter(spark: SparkSession, d: str) -> DataFrame:
    return _obs(spark, d).filter(B.clear_bits(F.col("qa"))).groupBy("qa").agg(F.count("*").alias("n"))


@query(OBS + " SELECT cell_id, round(median(CASE WHEN qa & 28 = 0 THEN blue END), 6) AS blue, round(median(nir), 6) AS nir, count(*) AS n_scenes FROM o GROUP BY cell_id")
def median_composite(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d).withColumn("blue", F.when(B.clear_bits(F.col("qa")), F.col("blue")))
    return rounded(composite.median_composite(o, ["cell_id"], ["blue", "nir"]))


@query(OBS + " SELECT cell_id, round(avg((qa & 28 = 0)::INTEGER), 6) AS coverage FROM o GROUP BY cell_id")
def coverage_fraction(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d).withColumn("blue", F.when(B.clear_bits(F.col("qa")), F.col("blue")))
    return rounded(composite.coverage(o, ["cell_id"], "blue"))


#: Means are kept to 8 digits, so that the order of summation does not show where an index has its pole.
_AVG = "round(avg({0}), 8) AS {0}"
COMP = OBS + ", c AS (SELECT cell_id, " + ", ".join(_AVG.format(b) for b in ("blue", "green", "red", "nir", "swir1", "swir2")) + " FROM o GROUP BY 1)"


def _mean_bands(spark, d):
    names = ("blue", "green", "red", "nir", "swir1", "swir2")
    return _obs(spark, d).groupBy("cell_id").agg(*(F.round(F.avg(b), 8).alias(b) for b in names))


@query(COMP + """ SELECT cell_id, round((nir - red) / (nir + red), 5) AS ndvi, round((green - nir) / (green + nir), 5) AS ndwi, round((swir1 - nir) / (swir1 + nir), 5) AS ndbi, round((nir - swir2) / (nir + swir2), 5) AS nbr, round((green - swir1) / (green + swir1), 5) AS mndwi,
  round((swir1 + red - nir - blue) / (swir1 + red + nir + blue), 5) AS bsi, round(1.5 * (nir - red) / (nir + red + 0.5), 5) AS savi,
  round(2.5 * (nir - red) / nullif(nir + 6 * red - 7.5 * blue + 1, 0), 4) AS evi FROM c""")
def spectral_indices(spark: SparkSession, d: str) -> DataFrame:
    c = _mean_bands(spark, d)
    every = B.indices(*(F.col(b) for b in ("blue", "green", "red", "nir", "swir1", "swir2")))
    return rounded(c.select("cell_id", *(x.alias(k) for k, x in every.items() if k != "evi"), F.round(every["evi"], 4).alias("evi")), 5)


@query(COMP + " SELECT cell_id, round((nir - red) / (nir + red + 0.0001), 7) AS ndvi, round((green - nir) / (green + nir + 0.0001), 7) AS ndwi, round((swir1 - nir) / (swir1 + nir + 0.0001), 7) AS ndbi, round((nir - swir2) / (nir + swir2 + 0.0001), 7) AS nbr FROM c")
def guarded_indices(spark: SparkSession, d: str) -> DataFrame:
    c = _mean_bands(spark, d)
    return rounded(c.select("cell_id", *(x.alias(k) for k, x in B.guarded_indices(*(F.col(b) for b in ("green", "red", "nir", "swir1", "swir2"))).items())), 7)


@query(OBS + " SELECT qa, count(*) AS n, count(CASE WHEN blue > 0.25 AND isfinite(nir) THEN 1 END) AS bright FROM o WHERE qa NOT IN (3, 8, 9, 10, 11) GROUP BY qa")
def scene_class_filter(spark: SparkSession, d: str) -> DataFrame:
    o = _obs(spark, d).filter(B.clear_scene(F.col("qa")))
    return o.groupBy("qa").agg(F.count("*").alias("n"), F.count_if((F.col("blue") > 0.25) & B.finite(F.col("nir"))).alias("bright"))


@query(COMP + " SELECT cell_id, round(2.5 * (nir - red) / nullif(nir + 6 * red - 7.5 * blue + 1, 0), 4) AS evi FROM c")
def evi(spark: SparkSession, d: str) -> DataFrame:
    """Every cell; null only where the denominator is zero."""
    c = _mean_bands(spark, d)
    return rounded(c.select("cell_id", B.indices(*(F.col(b) for b in ("blue", "green", "red", "nir", "swir1", "swir2")))["evi"].alias("evi")), 4)


@query("SELECT l_orderkey, l_linenumber, round(least(greatest(l_quantity * 0.0275 - 0.2, 0), 1), 6) AS reflectance, round(l_extendedprice * 0.02 - 273.15, 4) AS lst_c FROM lineitem")
def scale_clamp(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return rounded(li.select("l_orderkey", "l_linenumber", B.clamped(B.scaled(F.col("l_quantity") * 1000, "landsat"), 0.0, 1.0).alias("reflectance"), F.round(B.scaled(F.col("l_extendedprice"), "lst_c"), 4).alias("lst_c")))


@query("WITH p AS (SELECT quantile_cont(p_retailprice, 0.02) AS lo, quantile_cont(p_retailprice, 0.98) AS hi FROM part) SELECT p_partkey, floor(least(greatest((p_retailprice - lo) / (hi - lo) * 255, 0), 255))::INTEGER AS stretched FROM part, p")
def percentile_stretch(spark: SparkSession, d: str) -> DataFrame:
    return composite.stretch(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "stretched")


SHARES = (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)


@query("WITH p AS (SELECT quantile_cont(c_acctbal, [0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9]) AS e FROM customer) SELECT c_custkey, len(list_filter(e, lambda x: c_acctbal > x))::INTEGER AS bin FROM customer, p")
def percentile_bins(spark: SparkSession, d: str) -> DataFrame:
    return composite.percentile_bins(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", SHARES).select("c_custkey", "bin")


@query("WITH q AS (SELECT greatest(abs(quantile_cont(c_acctbal, 0.05)), abs(quantile_cont(c_acctbal, 0.95))) AS v FROM customer) SELECT c_custkey, len(list_filter(range(1, 9), lambda k: c_acctbal > -v + v * (2.0::DOUBLE * k / 9)))::INTEGER AS bin FROM customer, q")
def divergent_bins(spark: SparkSession, d: str) -> DataFrame:
    return composite.divergent_bins(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "bin")


Z = "WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)"


@query(Z + " SELECT c_custkey, round((c_acctbal - m) / s, 5) AS z, round((c_acctbal - lo) / (hi - lo), 6) AS unit FROM customer, s")
def zscore_minmax(spark: SparkSession, d: str) -> DataFrame:
    got = composite.standardised(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")
    return got.select("c_custkey", F.round("z", 5).alias("z"), F.round("unit", 6).alias("unit"))


@query(Z + ", z AS (SELECT (c_acctbal - m) / s AS z FROM customer, s) SELECT (sign(z) * ((abs(z) >= 1.645)::INTEGER + (abs(z) >= 1.96)::INTEGER + (abs(z) >= 2.576)::INTEGER))::INTEGER AS category, count(*) AS n FROM z GROUP BY 1")
def hotspot_categories(spark: SparkSession, d: str) -> DataFrame:
    got = composite.standardised(table(spark, d, "customer").select("c_acctbal"), "c_acctbal")
    return got.groupBy(composite.significance(F.col("z")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size > 45 THEN 5 WHEN p_size > 40 THEN 6 WHEN p_retailprice >= 1500 THEN 1 WHEN p_retailprice >= 1200 THEN 2 ELSE 3 END AS class_id FROM part")
def priority_reclass(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("p_retailprice"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", B.priority([((p >= 1200) & (p < 1500), 2), (p >= 1500, 1), (s > 40, 6), (s > 45, 5)], 3).alias("class_id"))


@query("SELECT CASE p_size " + " ".join(f"WHEN {k} THEN {v}" for k, v in EXTERNAL.items()) + " END AS class_id, count(*) AS n FROM part GROUP BY 1 HAVING class_id IS NOT NULL")
def remap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(B.remapped(F.col("p_size"), EXTERNAL).alias("class_id")).agg(F.count("*").alias("n")).filter("class_id IS NOT NULL")


_DENSITY = sql_case("{0}", CARBON)


def _cells(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_size") % 8 + 1).alias("c1"), (F.expr("p_size div 2") % 8 + 1).alias("c2"), F.col("p_retailprice").alias("area"))


CELLS = "WITH c AS (SELECT p_partkey, p_size % 8 + 1 AS c1, (p_size // 2) % 8 + 1 AS c2, p_retailprice AS area FROM part)"


@query(CELLS + f" SELECT c1 AS class_id, round(sum(area), 2) AS area, round(sum(area * {_DENSITY.format('c1')}), 2) AS carbon FROM c GROUP BY 1")
def lut_carbon(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d)
    return c.groupBy(F.col("c1").alias("class_id")).agg(F.round(F.sum("area"), 2).alias("area"), F.round(F.sum(F.col("area") * B.class_value(F.col("c1"), CARBON)), 2).alias("carbon"))


@query(CELLS + f", x AS (SELECT area * ({_DENSITY.format('c2')} - {_DENSITY.format('c1')}) AS v FROM c) SELECT round(sum(v), 2) AS net, round(sum(least(v, 0)), 2) AS loss, round(sum(greatest(v, 0)), 2) AS gain FROM x")
def carbon_change_gain_loss(spark: SparkSession, d: str) -> DataFrame:
    c = _cells(spark, d).select((F.col("area") * B.class_value(F.col("c1"), CARBON)).alias("b"), (F.col("area") * B.class_value(F.col("c2"), CARBON)).alias("a"))
    return rounded(ecosystem.gain_loss(c, "b", "a"), 2)


UNCERT = CELLS + f""", p AS (SELECT 1 AS period, c1 AS class_id, sum(area) AS a FROM c GROUP BY 2 UNION ALL SELECT 2, c2, sum(area) FROM c GROUP BY 2),
  q AS (SELECT *, a * 0.1 AS sa, {_DENSITY.format('class_id')}::DOUBLE AS d, {_DENSITY.format('class_id')} * 0.167 AS sd FROM p),
  u AS (SELECT period, sum(a * d) AS carbon, sqrt(sum(d * d * sa * sa + a * a * sd * sd + sa * sa * sd * sd)) AS carbon_se FROM q GROUP BY period)"""


def _uncertain(spark, d):
    c = _cells(spark, d).selectExpr("inline(array(struct(1 AS period, c1 AS class_id, area), struct(2 AS period, c2 AS class_id, area)))")
    p = c.groupBy("period", "class_id").agg(F.sum("area").alias("a")).withColumn("d", B.class_value(F.col("class_id"), CARBON))
    return ecosystem.carbon_uncertainty(p.withColumn("sa", F.col("a") * 0.1).withColumn("sd", F.col("d") * 0.167), ["period"], "a", "sa", "d", "sd")


@query(UNCERT + " SELECT period, round(carbon, 1) AS carbon, round(carbon_se, 1) AS carbon_se, round(carbon - 1.96 * carbon_se, 1) AS ci_low, round(carbon + 1.96 * carbon_se, 1) AS ci_high FROM u")
def carbon_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_uncertain(spark, d), 1)


@query(UNCERT + " SELECT b.period, round(b.carbon - a.carbon, 1) AS change, round(sqrt(a.carbon_se ** 2 + b.carbon_se ** 2), 1) AS change_se, abs(b.carbon - a.carbon) > 1.96 * sqrt(a.carbon_se ** 2 + b.carbon_se ** 2) AS significant FROM u a JOIN u b ON b.period = a.period + 1")
def carbon_change_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ecosystem.change_uncertainty(_uncertain(spark, d), "period"), 1)


_KC, _RE = sql_case("c", KC), sql_case("c", RECHARGE)


@query(f"WITH l AS (SELECT l_linenumber % 8 + 1 AS c, l_extendedprice AS p, CASE WHEN l_quantity > 5 THEN l_quantity * 10 END AS et FROM lineitem) SELECT c AS class_id, round(avg(p - coalesce(et, 0.4 * p) * {_KC}), 4) AS water_yield, round(avg(p * {_RE}), 4) AS baseflow FROM l GROUP BY c")
def water_yield(spark: SparkSession, d: str) -> DataFrame:
    c, p = F.col("l_linenumber") % 8 + 1, F.col("l_extendedprice")
    y = ecosystem.water_yield(p, F.when(F.col("l_quantity") > 5, F.col("l_quantity") * 10), B.class_value(c, KC))
    return table(spark, d, "lineitem").groupBy(c.alias("class_id")).agg(F.round(F.avg(y), 4).alias("water_yield"), F.round(F.avg(p * B.class_value(c, RECHARGE)), 4).alias("baseflow"))


@query("SELECT p_brand, round(avg((0.065 * p_size + 0.045) * (0.065 * p_size) * " + sql_case("p_size % 8 + 1", COVER) + "), 6) AS sediment FROM part GROUP BY 1")
def sediment(spark: SparkSession, d: str) -> DataFrame:
    c = B.class_value(F.col("p_size") % 8 + 1, COVER)
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg(ecosystem.sediment(F.col("p_size"), c)), 6).alias("sediment"))


@query("SELECT p_partkey, round(h * (1 - t / (t + power(0.5, 2.5))), 6) AS quality FROM (SELECT p_partkey, " + sql_case("p_size % 8 + 1", HABITAT) + " AS h, power((0.6 * exp(-p_retailprice / 5000) + 0.3 * exp(-p_size * 100 / 10000.0) + 0.1 * exp(-p_size * 10 / 3000.0)) * " + sql_case("p_size % 8 + 1", SENSITIVITY) + ", 2.5) AS t FROM part)")
def habitat_quality(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("p_size") % 8 + 1
    q = ecosystem.habitat(B.class_value(c, HABITAT), B.class_value(c, SENSITIVITY), F.col("p_retailprice"), F.col("p_size") * 100, F.col("p_size") * 10)
    return rounded(table(spark, d, "part").select("p_partkey", q.alias("quality")))


@query("SELECT date_trunc('year', o_orderdate)::DATE AS bucket, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY 1")
def annual_series(spark: SparkSession, d: str) -> DataFrame:
    s = trend.series(table(spark, d, "orders"), "o_orderdate", "o_totalprice")
    return s.select("bucket", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "n")


@query("SELECT date_trunc('month', o_orderdate)::DATE AS bucket, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, count(*) AS n FROM orders GROUP BY 1")
def monthly_series(spark: SparkSession, d: str) -> DataFrame:
    s = trend.series(table(spark, d, "orders"), "o_orderdate", "o_totalprice", "month")
    return s.select("bucket", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "n")


Y = "WITH y AS (SELECT o_orderpriority AS cell, year(o_orderdate)::BIGINT AS t, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)"


def _yearly(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("cell"), F.year("o_orderdate").cast("long").alias("t")).agg(F.avg("o_totalprice").alias("v"))


@query(Y + " SELECT cell, t, round((v - avg(v) OVER (PARTITION BY cell)) / stddev_pop(v) OVER (PARTITION BY cell), 5) AS z FROM y")
def anomaly(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trend.anomalies(_yearly(spark, d), ["cell"], "v").select("cell", "t", "z"), 5)


SPI = Y + ", r AS (SELECT cell, avg(v) AS m, stddev_pop(v) AS s FROM y WHERE t <= 1999 GROUP BY 1), s AS (SELECT cell, t, (v - m) / s AS z FROM y JOIN r USING (cell))"


@query(SPI + " SELECT cell, t, round(z, 5) AS z FROM s")
def spi(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trend.anomalies(_yearly(spark, d), ["cell"], "v", F.col("t") <= 1999).select("cell", "t", "z"), 5)


@query(SPI + " SELECT cell, round(avg((z < -1)::INTEGER), 6) AS frequency FROM s GROUP BY 1")
def drought_frequency(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trend.drought_frequency(trend.anomalies(_yearly(spark, d), ["cell"], "v", F.col("t") <= 1999), ["cell"], "z"))


@query(Y + " SELECT cell, round(median((b.v - a.v) / (b.t - a.t)), 4) AS sen_slope FROM y a JOIN y b USING (cell) WHERE a.t < b.t GROUP BY 1")
def sen_slope(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trend.sen_slope(_yearly(spark, d), ["cell"], "t", "v"), 4)


@query("WITH RECURSIVE " + Y.removeprefix("WITH ") + """, p AS (SELECT cell, sum(sign(b.v - a.v))::DOUBLE AS s, count(*) AS n0 FROM y a JOIN y b USING (cell) WHERE a.t < b.t GROUP BY 1), n AS (SELECT cell, count(*) AS n FROM y GROUP BY 1),
 o(i, c) AS (SELECT 1::BIGINT, [1::DOUBLE] UNION ALL SELECT i + 1, list_transform(range(0, len(c) + i), lambda k: list_sum(c[greatest(1, k + 1 - i):k + 1])) FROM o WHERE i < 12),
 q AS (SELECT i AS n, c, list_sum(c) AS total FROM o)
 SELECT cell, s, round(s / n0, 6) AS tau, round((s - sign(s)) / sqrt(n * (n - 1) * (2 * n + 5) / 18.0), 6) AS z, round(least(1, 2 * list_sum(c[1:((n0 - abs(s)) / 2)::BIGINT + 1]) / total), 6) AS p FROM p JOIN n USING (cell) JOIN q USING (n)""")
def kendall_tau(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trend.kendall(_yearly(spark, d), ["cell"], "t", "v"))


@query(Y + " SELECT cell, round(regr_slope(v, t), 4) AS slope, round(regr_intercept(v, t), 1) AS intercept, round(regr_r2(v, t), 5) AS r2, round(corr(t, v), 5) AS pearson FROM y GROUP BY 1")
def linear_trend(spark: SparkSession, d: str) -> DataFrame:
    t = trend.linear(_yearly(spark, d), ["cell"], "t", "v")
    return t.select("cell", F.round("slope", 4).alias("slope"), F.round("intercept", 1).alias("intercept"), F.round("r2", 5).alias("r2"), F.round("pearson", 5).alias("pearson"))


@query(Y + " SELECT cell, t, round(v - lag(v) OVER (PARTITION BY cell ORDER BY t), 4) AS change FROM y")
def consecutive_change(spark: SparkSession, d: str) -> DataFrame:
    return rounded(trend.consecutive(_yearly(spark, d), ["cell"], "t", "v").select("cell", "t", "change"), 4)


@query("SELECT event_type, round(avg(value), 5) AS mean, round(stddev_pop(value), 5) AS std, min(value) AS low, max(value) AS high, round(quantile_cont(value, 0.5), 5) AS median, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stats_by_class(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 5).alias("mean"), F.round(F.stddev_pop("value"), 5).alias("std"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.median("value"), 5).alias("median"), F.count_distinct("user_id").alias("users"))


PERIODS = [("a", 1995, 1996), ("b", 1998, 1999), ("c", 2001, 2001)]


@query("WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, a, b in PERIODS) + ") t(period, lo, hi)) SELECT period, round(coalesce(sum(o_totalprice), 0), 2) AS loss FROM p LEFT JOIN orders ON year(o_orderdate) BETWEEN lo AND hi GROUP BY 1")
def loss_by_period(spark: SparkSession, d: str) -> DataFrame:
    p = spark.createDataFrame(PERIODS, "period string, first_year int, last_year int")
    o = table(spark, d, "orders").select(F.year("o_orderdate").alias("y"), "o_totalprice")
    return rounded(trend.loss_by_period(o, p, "y", "o_totalprice"), 2)

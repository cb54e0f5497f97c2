"""Rule maps, samples, indicators and report tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions.dims import AREA_CI, CARBON, CLASSES, COVER, HABITAT, KC, RECHARGE, sql_case
from ..operators import accuracy, change, composite, focal, learning, markov, quality, regression, reports, sampling, spatial
from ..session import kept
from . import land_change, space_and_text
from .common import query, rounded, table

LAYERS = "WITH p AS (SELECT p_partkey, p_size * 2 AS cover, p_partkey % 27 AS loss, (p_retailprice * 100)::BIGINT % 101 AS water, p_partkey % 25 AS settled, (p_partkey % 11 = 0)::INTEGER AS mangrove, (p_partkey % 5 = 0)::INTEGER AS gain, p_size / 50.0::DOUBLE AS ndvi FROM part)"


def _layers(spark, d):
    p = table(spark, d, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    return p.select("p_partkey", (s * 2).alias("cover"), (k % 27).alias("loss"), (F.round(F.col("p_retailprice") * 100).cast("long") % 101).alias("water"), (k % 25).alias("settled"), (k % 11 == 0).cast("int").alias("mangrove"), (k % 5 == 0).cast("int").alias("gain"), (s / 50.0).alias("ndvi"))


@query(LAYERS + """ SELECT p_partkey, CASE WHEN mangrove >= 1 THEN 8 WHEN water >= 50 THEN 5 WHEN settled >= 22 THEN 6 WHEN cover >= 60 AND (loss = 0 OR loss >= 13) THEN 1 WHEN cover >= 30 AND cover < 60 AND (loss = 0 OR loss >= 13) THEN 2 ELSE 3 END AS reference,
 CASE WHEN cover >= 60 AND (loss = 0 OR loss > 13) THEN 1 WHEN cover >= 30 AND cover < 60 AND (loss = 0 OR loss > 13) THEN 2 WHEN settled >= 20 THEN 6 WHEN water > 80 THEN 5 WHEN cover < 30 THEN 3 ELSE 0 END AS training FROM p""")
def rule_labels(spark: SparkSession, d: str) -> DataFrame:
    """The reference map of 2013 and the labels by rule."""
    c = [F.col(x) for x in ("cover", "loss", "water", "settled")]
    return _layers(spark, d).select("p_partkey", B.reference_class(*c, 2013, F.col("mangrove")).alias("reference"), B.training_class(*c, 2013).alias("training"))


@query(LAYERS + """, y AS (SELECT p.*, y FROM p, (VALUES (2013), (2016), (2020)) t(y)), a AS (SELECT *, loss > 0 AND loss <= y - 2000 AS lost FROM y),
 b AS (SELECT *, (cover >= 60 AND NOT lost) OR (y > 2016 AND (ndvi > 0.6 OR (gain = 1 AND cover >= 30))) OR (y = 2016 AND gain = 1 AND NOT lost AND cover >= 40) AS dense FROM a),
 c AS (SELECT *, NOT dense AND ((cover >= 25 AND cover < 60 AND NOT lost) OR (ndvi >= 0.35 AND ndvi < 0.6)) AS secondary FROM b)
 SELECT y AS year, CASE WHEN dense THEN 1 WHEN secondary THEN 2 WHEN settled >= 22 THEN 6 WHEN water > 80 THEN 5 ELSE 3 END AS class_id, count(*) AS n FROM c GROUP BY 1, 2""")
def export_maps(spark: SparkSession, d: str) -> DataFrame:
    """Cells by class of the published maps of three years."""
    p, out = _layers(spark, d), None
    for y in (2013, 2016, 2020):
        c = B.export_class(*(F.col(x) for x in ("cover", "loss", "gain", "water", "settled", "ndvi")), y)
        row = p.select(F.lit(y).alias("year"), c.alias("class_id"))
        out = row if out is None else out.unionByName(row)
    return out.groupBy("year", "class_id").agg(F.count("*").alias("n"))


GRID = "WITH g AS (SELECT (p_partkey // 50)::INTEGER AS r, (p_partkey % 50)::INTEGER AS c, substr(p_brand, 7, 1)::INTEGER AS k, p_size::DOUBLE AS h FROM part)"


def _grid(spark, d):
    return space_and_text._grid(spark, d)


@query(GRID + ", q AS (SELECT c_custkey, (c_custkey * 7 % 600) / 10.0 AS x, (c_custkey * 3 % 90) / 10.0 AS y FROM customer) SELECT c_custkey, k AS class_id, h AS height FROM q JOIN g ON r = floor((9 - y) / 1.0) AND c = floor(x / 1.0) WHERE h > 5")
def point_sampling(spark: SparkSession, d: str) -> DataFrame:
    """Layers at points: the cell that holds each; masked cells and points outside give no row."""
    q = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") * 7 % 600 / 10.0).alias("x"), (F.col("c_custkey") * 3 % 90 / 10.0).alias("y"))
    raster = _grid(spark, d).withColumn("height", B.mask_invalid(F.col("height"), F.col("height") > 5))
    return spatial.sampled(q, raster, (0.0, 9.0), (1.0, 1.0), ["class_id", "height"]).select("c_custkey", "class_id", "height")


@query("WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, label::DOUBLE AS value, embedding[3]::DOUBLE AS u FROM embeddings) SELECT a.id, round(coalesce(avg(b.value), 0), 5) AS value, round(coalesce(avg(b.u), 0), 5) AS u FROM p a LEFT JOIN p b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.05 GROUP BY a.id")
def buffer_mean(spark: SparkSession, d: str) -> DataFrame:
    p = space_and_text._regressed(spark, d)
    return rounded(spatial.buffer_mean(p, p, 0.05, ["value", "u"]), 5)


BOX = (-0.1, -0.1, 0.08, 0.1)


@query(f"WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT id FROM p WHERE NOT (x BETWEEN {BOX[0]} AND {BOX[2]} AND y BETWEEN {BOX[1]} AND {BOX[3]})")
def region_difference(spark: SparkSession, d: str) -> DataFrame:
    return spatial.outside(space_and_text._points(spark, d), BOX).select("id")


@query("WITH p AS (SELECT floor(embedding[1]::DOUBLE / 0.1)::BIGINT AS i, floor(embedding[2]::DOUBLE / 0.1)::BIGINT AS j FROM embeddings GROUP BY 1, 2), t AS (SELECT i * 1000 + j AS zone_id, i * 0.1::DOUBLE AS x, j * 0.1::DOUBLE AS y FROM p) SELECT zone_id, round(x + 0.2 / 3, 6) AS cx, round(y + 0.1 / 3, 6) AS cy, 0.005::DOUBLE AS area FROM t WHERE x <= 0.08 AND x + 0.1 >= -0.1 AND y <= 0.1 AND y + 0.1 >= -0.1")
def polygon_measures(spark: SparkSession, d: str) -> DataFrame:
    """Triangles by their boxes: those that meet a box, with centroid and area."""
    p = space_and_text._points(spark, d).select(F.floor(F.col("x") / 0.1).alias("i"), F.floor(F.col("y") / 0.1).alias("j")).distinct()
    at = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    t = p.select((F.col("i") * 1000 + F.col("j")).alias("zone_id"), (F.col("i") * 0.1).alias("x"), (F.col("j") * 0.1).alias("y")).withColumn("ring", spatial.closed(F.array(at(0.0, 0.0), at(0.1, 0.0), at(0.1, 0.0), at(0.1, 0.1))))
    t = spatial.overlapping(t.select("zone_id", "ring", F.inline(F.array(spatial.ring_bounds(F.col("ring"))))), BOX)
    c = spatial.ring_centroid(F.col("ring"))
    return t.select("zone_id", F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"), F.round(F.abs(spatial.ring_area(F.col("ring"))), 6).alias("area"))


@query(GRID + """, n AS (SELECT a.r, a.c, a.k, min(b.k) AS lo, max(b.k) AS hi FROM g a JOIN g b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 GROUP BY ALL) SELECT k AS class_id, sum((lo <> hi)::INTEGER)::BIGINT AS n_edge, sum((lo <> hi)::INTEGER) * 30.0::DOUBLE AS edge_length FROM n GROUP BY k""")
def edge_cells(spark: SparkSession, d: str) -> DataFrame:
    return focal.edge_cells(_grid(spark, d), "class_id", 30.0)


@query(space_and_text.GRID + """, s AS (SELECT r * 2147483648::BIGINT + c AS id, r, c, k FROM g),
 l AS (SELECT id, id AS p, r, c, k FROM s UNION SELECT b.id, l.p, b.r, b.c, b.k FROM l JOIN s b ON l.k = b.k AND abs(l.r - b.r) + abs(l.c - b.c) = 1 AND b.id > l.p),
 m AS (SELECT id, r, c, k, min(p) AS p FROM l GROUP BY ALL), e AS (SELECT a.k AS ak, b.k AS bk, a.p AS p FROM m a JOIN m b ON (b.r = a.r AND b.c = a.c + 1) OR (b.r = a.r + 1 AND b.c = a.c)),
 t AS (SELECT k, count(*) AS e FROM (SELECT ak AS k FROM e WHERE ak <> bk UNION ALL SELECT bk FROM e WHERE ak <> bk) GROUP BY k),
 q AS (SELECT k, m.p, count(*) AS a, any_value(coalesce(g.g, 0)) AS g FROM m LEFT JOIN (SELECT p, count(*) AS g FROM e WHERE ak = bk GROUP BY p) g ON g.p = m.p GROUP BY k, m.p),
 x AS (SELECT k, sum(a)::BIGINT AS a, sum(g)::BIGINT AS g, sum(4 * a - 2 * g) AS p, sum((4 * a - 2 * g) * sqrt(a)) AS pa FROM q GROUP BY k), z AS (SELECT count(*) AS z FROM m),
 y AS (SELECT *, floor(sqrt(a))::BIGINT AS n, a - floor(sqrt(a))::BIGINT ** 2 AS w FROM x)
 SELECT y.k AS class_id, coalesce(e, 0) * 30.0::DOUBLE AS total_edge, round(coalesce(e, 0) * 30.0 / (z * 0.09), 5) AS edge_density, round((1 - p / pa) / (1 - 1 / sqrt(z)) * 100, 5) AS cohesion,
  round(g / (2 * n * (n - 1) + CASE WHEN w = 0 THEN 0 WHEN w <= n THEN 2 * w - 1 ELSE 2 * w - 2 END) * 100, 5) AS aggregation FROM y LEFT JOIN t USING (k), z""")
def fragmentation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(focal.fragmentation(focal.patches(_grid(spark, d), "class_id"), "class_id", 30.0), 5)


@query("SELECT p_partkey, round(greatest(cos(radians(45)) * cos(radians(s)) + sin(radians(45)) * sin(radians(s)) * cos(radians(270) - radians(a)), 0) * 255, 5) AS shade, round(abs(w) * 111.320 * cos(radians(7)) * abs(w) * 110.574 * 100, 9) AS pixel_ha FROM (SELECT p_partkey, p_size::DOUBLE AS s, p_partkey % 360 AS a, p_size / 10000.0::DOUBLE AS w FROM part)")
def hillshade(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    w = F.col("p_size") / 10000.0
    return p.select("p_partkey", F.round(B.hillshade(F.col("p_size").cast("double"), F.col("p_partkey") % 360), 5).alias("shade"), F.round(B.pixel_area_ha(w, w), 9).alias("pixel_ha"))


@query("SELECT round(year(o_orderdate) + (month(o_orderdate) - 1) / 12.0, 6) AS year, count(*) AS n FROM orders GROUP BY 1")
def fractional_years(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table(spark, d, "orders").groupBy(B.fractional_year(F.col("o_orderdate")).alias("year")).agg(F.count("*").alias("n")))


@query("WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer), z AS (SELECT (c_acctbal - m) / s AS z FROM customer, s) SELECT len(list_filter([-2.576, -1.96, -1.645, -0.5, 0.5, 1.645, 1.96, 2.576], lambda e: z > e))::INTEGER AS bin, count(*) AS n FROM z GROUP BY 1")
def z_classes(spark: SparkSession, d: str) -> DataFrame:
    z = composite.standardised(table(spark, d, "customer").select("c_acctbal"), "c_acctbal")
    return z.groupBy(composite.z_classes(F.col("z")).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, arg_max(CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END, o_orderkey) AS price, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def mosaic(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")).alias("price"), F.col("o_orderstatus").alias("status"))
    return composite.mosaic(o, ["o_custkey"], "o_orderkey", ["price", "status"])


CELLS = "WITH c AS (SELECT n_name AS zone, c_custkey % 8 + 1 AS c1, (c_custkey // 3) % 8 + 1 AS c2, abs(c_acctbal) AS area, c_custkey % 101 AS cover, c_custkey % 7 % 4 AS loss FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def _zone_cells(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    return c.select(F.col("n_name").alias("zone"), (k % 8 + 1).alias("c1"), (F.expr("c_custkey div 3") % 8 + 1).alias("c2"), F.abs("c_acctbal").alias("area"), (k % 101).alias("cover"), (k % 7 % 4).alias("loss"))


@query(CELLS + " SELECT zone, round(sum((c1 * 10 + c2) * area), 2) AS code_area, round(sum(area), 2) AS area, round(sum(CASE WHEN c1 <> c2 THEN area ELSE 0 END), 2) AS changed_area FROM c GROUP BY zone")
def transitions_by_zone(spark: SparkSession, d: str) -> DataFrame:
    c = _zone_cells(spark, d).withColumn("code", F.col("c1") * 10 + F.col("c2"))
    return rounded(reports.transitions_by_zone(c, "zone", "code", "area"), 2)


@query(CELLS + f""", f AS (SELECT zone, avg((c1 IN (1, 2))::INTEGER) * 100 AS a, avg((c2 IN (1, 2))::INTEGER) * 100 AS b, sum((c2 IN (1, 2))::INTEGER) - sum((c1 IN (1, 2))::INTEGER) AS net, avg({sql_case("c2", CARBON)}) - avg({sql_case("c1", CARBON)}) AS carbon, avg(nullif(cover, 0)) AS tree, avg(nullif(loss, 0)) AS lm, avg((loss > 0)::INTEGER) AS ls FROM c GROUP BY zone)
 SELECT zone, round(a, 5) AS forest_pct_before, round(b, 5) AS forest_pct_after, CASE WHEN a > 0 THEN round((a - b) / a * 100, 5) END AS loss_rate_pct, round((net * 0.09)::DOUBLE, 5) AS net_forest_ha, round(carbon, 5) AS carbon_change, round(tree, 5) AS tree_cover, round(lm, 5) AS loss_mean, round(ls, 5) AS loss_share FROM f""")
def zone_indicators(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.zone_indicators(_zone_cells(spark, d), "zone", "c1", "c2", "cover", "loss", 0.09), 5)


_NAME = "CASE class_id " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in CLASSES.items()) + " ELSE 'C' || class_id END"
YEARLY = "WITH a AS (SELECT 'y' || year(o_orderdate) AS period, substr(o_orderpriority, 1, 1)::INTEGER AS class_id, sum(o_totalprice) AS area FROM orders WHERE year(o_orderdate) IN (1995, 1997, 1999) GROUP BY 1, 2)"
YEARS = ["y1995", "y1997", "y1999"]


def _yearly_areas(spark, d):
    y = F.year("o_orderdate")
    return table(spark, d, "orders").filter(y.isin(1995, 1997, 1999)).groupBy(F.concat(F.lit("y"), y.cast("string")).alias("period"), F.substring("o_orderpriority", 1, 1).cast("int").alias("class_id")).agg(F.sum("o_totalprice").alias("area"))


@query(YEARLY + ", k AS (SELECT unnest(range(1, 9)) AS class_id), w AS (SELECT k.class_id, " + ", ".join(f"coalesce(sum(CASE WHEN period = '{y}' THEN area END), 0) AS {y}" for y in YEARS) + f" FROM k LEFT JOIN a USING (class_id) GROUP BY 1) SELECT class_id::INTEGER AS class_id, {_NAME} AS class, " + ", ".join(f"round({y}, 2) AS {y}" for y in YEARS) + ", round(y1999 - y1995, 2) AS net_change, CASE WHEN y1995 > 0 THEN round((y1999 - y1995) / y1995 * 100, 2) ELSE 0 END AS change_pct FROM w")
def class_area_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reports.class_area_table(_yearly_areas(spark, d), YEARS), 2)


@query(YEARLY + ", w AS (SELECT CASE class_id WHEN 1 THEN 0.15 WHEN 2 THEN 0.17 WHEN 8 THEN 0.18 END AS s, * FROM a WHERE class_id IN (1, 2, 8)), r AS (SELECT (max(area) - min(area)) / min(area) * 100 AS range_pct FROM (SELECT sum(area) AS area FROM a GROUP BY period)) SELECT period, round(sum(area), 2) AS area, round(sqrt(sum((area * s) ** 2)), 2) AS half_width, round(any_value(range_pct), 4) AS range_pct FROM w, r GROUP BY period")
def approximate_ci(spark: SparkSession, d: str) -> DataFrame:
    a = _yearly_areas(spark, d)
    r = reports.range_pct(a.groupBy("period").agg(F.sum("area").alias("area")), "area")
    c = reports.approximate_ci(a, ["period"], AREA_CI).join(F.broadcast(r))  # one row
    return c.select("period", F.round("area", 2).alias("area"), F.round("half_width", 2).alias("half_width"), F.round("range_pct", 4).alias("range_pct"))


@query("WITH l AS (SELECT lang AS period, quality AS ref, (n_chars >= 1500)::INTEGER AS pred FROM labels JOIN documents USING (doc_id)), k AS (SELECT period, sum(ref)::BIGINT AS n_training, sum(pred)::BIGINT AS n_validation, count(*)::DOUBLE AS n, sum((ref = pred)::INTEGER) AS hit, avg(ref) AS r, avg(pred) AS q, avg((ref = 1 AND pred = 1)::INTEGER) AS h1, avg((ref = 0 AND pred = 0)::INTEGER) AS h0 FROM l GROUP BY 1) SELECT period, n_training, n_validation, round(hit / n * 100, 4) AS oa_pct, round((hit / n - (r * q + (1 - r) * (1 - q))) / (1 - (r * q + (1 - r) * (1 - q))), 4) AS kappa, round(abs(r - q), 4) AS qd, round(least(r - h1, q - h1) + least(1 - r - h0, 1 - q - h0), 4) AS ad FROM k")
def accuracy_table(spark: SparkSession, d: str) -> DataFrame:
    d_ = land_change._labelled(spark, d).withColumnRenamed("lang", "period")
    counts = d_.groupBy("period").agg(F.sum("ref").alias("n_training"), F.sum("pred").cast("long").alias("n_validation"))
    return rounded(reports.accuracy_table(accuracy.confusion(d_, "ref", "pred", ["period"]), "period", counts), 4)


@query(f"SELECT p_brand AS period, round(sum({sql_case('c', CARBON)} * a) / 1e6, 6) AS carbon_tg, round(avg(a - 0.4 * a * {sql_case('c', KC)}), 4) AS water_yield, round(avg(a * {sql_case('c', RECHARGE)}), 4) AS baseflow, round(avg({sql_case('c', HABITAT)}), 6) AS quality, round(stddev_pop({sql_case('c', HABITAT)}), 6) AS quality_std FROM (SELECT p_brand, p_size % 8 + 1 AS c, p_retailprice AS a FROM part) GROUP BY 1")
def services_table(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_brand").alias("period"), (F.col("p_size") % 8 + 1).alias("c"), F.col("p_retailprice").alias("a"))
    c, a = F.col("c"), F.col("a")
    t = reports.services_table(p, "period", B.class_value(c, CARBON), "a", a - 0.4 * a * B.class_value(c, KC), a * B.class_value(c, RECHARGE), B.class_value(c, HABITAT))
    return t.select("period", F.round("carbon_tg", 6).alias("carbon_tg"), F.round("water_yield", 4).alias("water_yield"), F.round("baseflow", 4).alias("baseflow"), F.round("quality", 6).alias("quality"), F.round("quality_std", 6).alias("quality_std"))


@query(f"WITH p AS (SELECT p_size % 8 + 1 AS c, CASE WHEN p_partkey % 3 > 0 THEN p_retailprice / 10 END AS b FROM part) SELECT c AS class_id, round(avg(coalesce(b * 0.47, {sql_case('c', {1: 155, 2: 65, 3: 5, 4: 12, 5: 0, 6: 2, 7: 0, 8: 90})}) + {sql_case('c', {1: 39, 2: 16, 3: 3, 4: 3, 5: 0, 6: 0, 7: 0, 8: 25})} + {sql_case('c', {1: 65, 2: 55, 3: 35, 4: 38, 5: 0, 6: 18, 7: 15, 8: 120})} + {sql_case('c', {1: 22, 2: 10, 3: 0.5, 4: 0.5, 5: 0, 6: 0, 7: 0, 8: 12})}), 5) AS carbon FROM p GROUP BY 1")
def enhanced_carbon(spark: SparkSession, d: str) -> DataFrame:
    """Carbon density with biomass above ground where it was measured."""
    from ..functions.dims import classes

    p = table(spark, d, "part").select((F.col("p_size") % 8 + 1).alias("class_id"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_retailprice") / 10).alias("b"))
    p = p.join(F.broadcast(classes(spark)), "class_id")  # eight rows
    return rounded(p.groupBy("class_id").agg(F.avg(reports.enhanced_carbon(F.col("b"), F.col("c_above"), F.col("c_below"), F.col("c_soil"), F.col("c_dead"))).alias("carbon")), 5)


@query(land_change.PROB + ", p1 AS " + land_change.STEP.format("a2") + ", p2 AS " + land_change.STEP.format("p1") + ", p3 AS " + land_change.STEP.format("p2") + ", p4 AS " + land_change.STEP.format("p3") + """, r AS (SELECT 'BAU' AS scenario, 2030 AS year, class_id, area FROM p1 UNION ALL SELECT 'BAU', 2040, class_id, area FROM p3)
 SELECT scenario, year, """ + ", ".join(f"round(coalesce(sum(CASE WHEN class_id = {k} THEN area END) / sum(area) * 100, 0), 5) AS \"{n}\"" for k, n in CLASSES.items()) + " FROM r GROUP BY scenario, year")
def projection_table(spark: SparkSession, d: str) -> DataFrame:
    """Chained targets from 2024 in steps of four years: one step to 2030, two more to 2040."""
    p = markov.chained(land_change._areas(spark, d, land_change.LAST), land_change._prob(spark, d), 2024, [2040, 2030], 4)
    return rounded(reports.projection_table(p.withColumn("scenario", F.lit("BAU")), ["scenario", "year"]), 5)


@query(land_change.PROB + """, k AS (SELECT *, CASE WHEN c_from = 2 AND c_to = 1 THEN least(prob, 0.05) WHEN c_from = 5 AND c_to = 1 THEN 0 ELSE prob END AS kept FROM t WHERE c_from <> 4 AND c_to <> 4),
  b AS (SELECT c_from, c_to, prob / sum(prob) OVER (PARTITION BY c_from) AS was FROM t WHERE c_from <> 4 AND c_to <> 4),
  k2 AS (SELECT *, CASE WHEN c_from = 2 AND c_to = 1 THEN least(was, 0.05) WHEN c_from = 5 AND c_to = 1 THEN 0 ELSE was END AS kept FROM b),
  r AS (SELECT c_from, c_to, was, kept + CASE WHEN c_from = c_to THEN sum(was - kept) OVER (PARTITION BY c_from) ELSE 0 END AS x FROM k2),
  s AS (SELECT c_from, c_to, was, x / sum(x) OVER (PARTITION BY c_from) AS now FROM r)
  SELECT c_from, c_to, round(was, 6) AS was, round(now, 6) AS now FROM s WHERE abs(was - now) > 1e-9""")
def correction_log(spark: SparkSession, d: str) -> DataFrame:
    """What the correction of the matrix of all classes but one changed."""
    m = kept(markov.restricted(land_change._prob(spark, d), [1, 2, 3, 5]), "restricted")
    return rounded(markov.corrections(m, markov.corrected(m, [(2, 1, 0.05), (5, 1, 0.0)]), 1e-9))


DRIVERS = ("elevation", "slope", "dist_rivers", "dist_roads", "pop_density")
DRIVEN = "WITH d AS (SELECT p_partkey, p_size::DOUBLE AS elevation, (p_partkey % 37)::DOUBLE AS slope, p_retailprice AS dist_rivers, (p_partkey * 7 % 101)::DOUBLE AS dist_roads, (p_partkey % 13)::DOUBLE AS pop_density FROM part)"


def _drivers(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("elevation"), (k % 37).cast("double").alias("slope"), F.col("p_retailprice").alias("dist_rivers"), (k * 7 % 101).cast("double").alias("dist_roads"), (k % 13).cast("double").alias("pop_density"))


def _suits_sql() -> str:
    term = lambda x: f"(1 - n_{x[1:]})" if x.startswith("-") else f"n_{x}"
    return ", ".join("round(" + " + ".join(f"{term(x)} * {w}::DOUBLE" for x, w in ws.items()) + f", 6) AS s{k}" for k, ws in learning.SUITABILITY.items())


@query(DRIVEN + ", n AS (SELECT p_partkey, " + ", ".join(f"({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) AS n_{x}" for x in DRIVERS) + " FROM d) SELECT p_partkey, " + _suits_sql() + " FROM n")
def suitability_maps(spark: SparkSession, d: str) -> DataFrame:
    return rounded(learning.suitability(_drivers(spark, d)).drop(*DRIVERS))


@query(DRIVEN + " SELECT p_partkey, elevation, slope, lst FROM d JOIN (SELECT l_partkey AS p_partkey, avg(l_quantity) AS lst FROM lineitem WHERE l_partkey % 9 > 0 GROUP BY 1) l USING (p_partkey) ORDER BY md5('42' || p_partkey), p_partkey LIMIT 150")
def driver_sample(spark: SparkSession, d: str) -> DataFrame:
    """Layers joined by cell; the 150 cells of least draw that have every driver."""
    lst = table(spark, d, "lineitem").filter("l_partkey % 9 > 0").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.avg("l_quantity").alias("lst"))
    layers = {"terrain": _drivers(spark, d).select("p_partkey", "elevation", "slope"), "lst": lst}
    return reports.driver_sample(layers, ["p_partkey"], 150, F.md5(F.concat(F.lit("42"), F.col("p_partkey").cast("string")).cast("binary")))


@query("""WITH c AS (SELECT p_size % 4 + 1 AS base, CASE WHEN p_partkey % 5 = 0 THEN p_partkey % 4 + 1 ELSE p_size % 4 + 1 END AS obs, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 + 1 ELSE p_size % 4 + 1 END AS sim FROM part),
 n AS (SELECT count(*)::DOUBLE AS n, sum((sim = obs)::INTEGER) AS hit, sum((sim = obs AND (sim <> base OR obs <> base))::INTEGER) AS hits, sum((sim <> obs AND obs <> base)::INTEGER) AS misses, sum((sim <> obs AND sim <> base)::INTEGER) AS false_alarms FROM c),
 e AS (SELECT sum(r * q) AS e FROM (SELECT obs AS k, count(*)::DOUBLE AS r FROM c GROUP BY 1) JOIN (SELECT sim AS k, count(*)::DOUBLE AS q FROM c GROUP BY 1) USING (k))
 SELECT n::BIGINT AS n, round(hit / n, 6) AS overall_accuracy, round((hit / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa, hits::BIGINT AS hits, misses::BIGINT AS misses, false_alarms::BIGINT AS false_alarms, round(hits / (hits + misses + false_alarms), 6) AS figure_of_merit FROM n, e""")
def simulation_validation(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    c = table(spark, d, "part").select((s % 4 + 1).alias("base"), F.when(k % 5 == 0, k % 4 + 1).otherwise(s % 4 + 1).alias("obs"), F.when(k % 3 == 0, k % 4 + 1).otherwise(s % 4 + 1).alias("sim"))
    return rounded(accuracy.figure_of_merit(c, "sim", "obs", "base"))


@query(f"""WITH d AS (SELECT doc_id, lang, n_chars % 8 + 1 AS own, CASE WHEN doc_id % 4 = 0 THEN 5 ELSE 3 END AS code, {land_change.DRAW.format("doc_id")} AS draw FROM documents),
 s AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY draw, doc_id) AS r FROM d) SELECT count(*) AS n, round(avg((own = CASE code WHEN 5 THEN 2 ELSE 1 END)::INTEGER), 6) AS agreement FROM s WHERE r <= 60""")
def external_agreement(spark: SparkSession, d: str) -> DataFrame:
    """A stratified sample of our classes against another map's, recoded."""
    from ..functions.dims import EXTERNAL_CHECK

    x = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 8 + 1).cast("int").alias("own"), F.when(F.col("doc_id") % 4 == 0, 5).otherwise(3).alias("code"))
    s = sampling.stratified(x, "own", "doc_id", 60).withColumn("other", B.remapped(F.col("code"), EXTERNAL_CHECK))
    m = accuracy.overall(accuracy.confusion(s, "own", "other"))
    return m.select("n", F.round("overall_accuracy", 6).alias("agreement"))


@query("""WITH a AS (SELECT year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT year, CASE WHEN year % 2 = 0 THEN total * 1.2 ELSE total + 5 END AS total, n + (year % 3)::BIGINT AS n FROM a WHERE year < 2000),
 j AS (SELECT coalesce(a.year, b.year) AS year, a.total AS t1, b.total AS t2, a.n AS n1, b.n AS n2 FROM a FULL JOIN b ON a.year = b.year)
 SELECT year, 'total' AS value, round(t1, 2) AS one, round(t2, 2) AS other, round(abs(t1 - t2) / t1 * 100, 2) AS difference, coalesce(abs(t1 - t2) / t1 * 100 <= 5, false) AS passed FROM j UNION ALL SELECT year, 'n', n1, n2, abs(n1 - n2), coalesce(abs(n1 - n2) <= 1, false) FROM j""")
def reconciled_tables(spark: SparkSession, d: str) -> DataFrame:
    y = F.year("o_orderdate").cast("long")
    a = table(spark, d, "orders").groupBy(y.alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))
    b = a.filter("year < 2000").select("year", F.when(F.col("year") % 2 == 0, F.col("total") * 1.2).otherwise(F.col("total") + 5).alias("total"), (F.col("n") + F.col("year") % 3).alias("n"))
    return rounded(quality.reconciled(a, b, ["year"], {"total": (5.0, "percent"), "n": (1.0, "absolute")}), 2)


@query(land_change.PROB + ", r AS (SELECT max(abs(s - 1)) < 0.01 AS p FROM (SELECT sum(prob) AS s FROM t GROUP BY c_from)), " + YEARLY.removeprefix("WITH ") + """, s AS (SELECT period, count(*) AS classes, min(area) AS least_area, sum(CASE WHEN class_id = 1 THEN area ELSE 0 END) AS dense, sum(area) AS total FROM a GROUP BY 1),
 q AS (SELECT max(abs(x - 100)) < 1 AS p FROM (SELECT sum(share) AS x FROM (SELECT period, area / sum(area) OVER (PARTITION BY period) * 100 AS share FROM a) GROUP BY period)),
 z AS (SELECT 'rows sum to one' AS rule, 'ERROR' AS severity, p AS passed FROM r UNION ALL SELECT 'percents sum to 100', 'ERROR', p FROM q UNION ALL SELECT 'no negative area', 'ERROR', min(least_area) >= 0 FROM s UNION ALL SELECT 'every class', 'WARNING', min(classes) = 8 AND max(classes) = 8 FROM s
  UNION ALL SELECT 'dense forest', 'ERROR', min(dense) > 0 FROM s UNION ALL SELECT 'total area is reasonable', 'WARNING', min(total) > 800000 AND max(total) < 1500000 FROM s UNION ALL SELECT 'periods have like areas', 'WARNING', (max(total) - min(total)) / min(total) * 100 < 20 FROM s)
 SELECT rule, severity, passed, CASE WHEN passed THEN 'PASS' ELSE severity END AS status FROM z""")
def rule_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """The published rules over the change tables."""
    a = _yearly_areas(spark, d)
    per = a.groupBy("period").agg(F.count("*").alias("classes"), F.min("area").alias("least_area"), F.sum(F.when(F.col("class_id") == 1, F.col("area")).otherwise(0.0)).alias("dense"), F.sum("area").alias("total"))
    rows = land_change._prob(spark, d).groupBy("c_from").agg(F.sum("prob").alias("total"))
    shares = change.composition(a, ["period"]).groupBy("period").agg(F.sum("share_pct").alias("total"))
    parts = [(rows, quality.matrix_rules()), (shares, quality.share_rules()), (per, quality.area_rules())]
    out = None
    for df, rules in parts:
        got = quality.check(df, rules)
        out = got if out is None else out.unionByName(got)
    return out


@query("SELECT t AS term, round(CASE t WHEN 'l_quantity' THEN regr_slope(l_extendedprice, l_quantity) END, 2) AS ols, CASE WHEN abs(any_value(z)) > 1.96 THEN 'Yes' ELSE 'No' END AS significant, 1.5::DOUBLE AS mean FROM lineitem, (VALUES ('l_quantity')) v(t), (SELECT corr(l_extendedprice, l_quantity) * sqrt((count(*) - 2) / (1 - corr(l_extendedprice, l_quantity) ** 2)) AS z FROM lineitem) GROUP BY t")
def regression_table(spark: SparkSession, d: str) -> DataFrame:
    """Global coefficients beside a summary of local ones (here given)."""
    local = spark.createDataFrame([("intercept", 1.0), ("l_quantity", 1.5)], "term string, mean double")
    t = reports.regression_table(regression.ols(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"]), local)
    return t.select("term", F.round("ols", 2).alias("ols"), "significant", "mean")


@query("SELECT p_partkey, " + sql_case("p_size % 10", COVER) + " AS cover, CASE WHEN p_size % 10 BETWEEN 1 AND 8 THEN " + "CASE p_size % 10 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in CLASSES.items()) + " END ELSE 'C' || (p_size % 10) END AS name FROM part")
def class_lookup(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("p_size") % 10
    return table(spark, d, "part").select("p_partkey", B.class_value(c, COVER).alias("cover"), B.class_name(c, CLASSES).alias("name"))


@query(land_change.PROB + f", r AS (SELECT class_id, coalesce(a1.area, 0) AS x, coalesce(a2.area, 0) AS y FROM a1 FULL JOIN a2 USING (class_id)) SELECT class_id, {_NAME} AS class, round(x, 2) AS area_t1, round(y, 2) AS area_t2, round(y - x, 2) AS net_change, round(CASE WHEN x > 0 THEN (y - x) / x * 100 ELSE 0 END, 2) AS pct_change FROM r WHERE x > 0 OR y > 0")
def change_rate_table(spark: SparkSession, d: str) -> DataFrame:
    t = change.change_table(land_change._areas(spark, d, land_change.FIRST), land_change._areas(spark, d, land_change.LAST), "class_id", land_change.YEARS)
    return rounded(reports.change_rate_table(t).drop("annual_rate_pct"), 2)


@query("SELECT p_brand AS zone, floor(p_size / 10.0)::INTEGER AS row, 0 AS col, count(*) AS n FROM part GROUP BY ALL HAVING count(*) > 3")
def gated_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups with more than three rows: statistics need a least number of them."""
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("zone"), F.floor(F.col("p_size") / 10.0).cast("int").alias("row"), F.lit(0).alias("col")).agg(F.count("*").alias("n"))
    return g.filter("n > 3")

"""Matrices as rows: projection, scenarios, correction, hindcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalised(matrix: DataFrame, value: str = "prob") -> DataFrame:
    total = F.sum(value).over(Window.partitionBy("c_from"))
    return matrix.withColumn(value, F.when(total > 0, F.col(value) / total).otherwise(0.0))


def project(areas: DataFrame, matrix: DataFrame, steps: int = 1) -> DataFrame:
    """areas(class_id, area) after `steps` applications of matrix(c_from, c_to, prob)."""
    for _ in range(steps):
        areas = areas.join(matrix, areas["class_id"] == matrix["c_from"]).groupBy("c_to").agg(F.sum(F.col("area") * F.col("prob")).alias("area")).withColumnRenamed("c_to", "class_id")
    return areas


def scenario(matrix: DataFrame, multipliers: list[tuple[list[int], list[int], float]]) -> DataFrame:
    """Multiplies the cells (from any of, to any of) and normalises the rows; the first multiplier that names a cell holds."""
    factor = F.lit(1.0)
    for rows, cols, x in reversed(multipliers):
        factor = F.when(F.col("c_from").isin(rows) & F.col("c_to").isin(cols), F.lit(x)).otherwise(factor)
    return normalised(matrix.withColumn("prob", F.col("prob") * factor))


def corrected(matrix: DataFrame, caps: list[tuple[int, int, float]]) -> DataFrame:
    """Caps single cells; what is cut goes to the row's diagonal, then rows are normalised."""
    cap = F.lit(None).cast("double")
    for a, b, most in reversed(caps):
        cap = F.when((F.col("c_from") == a) & (F.col("c_to") == b), F.lit(most)).otherwise(cap)
    m = matrix.withColumn("kept", F.least("prob", F.coalesce(cap, F.col("prob")))).withColumn("cut", F.col("prob") - F.col("kept"))
    m = m.withColumn("prob", F.col("kept") + F.when(F.col("c_from") == F.col("c_to"), F.sum("cut").over(Window.partitionBy("c_from"))).otherwise(0.0))
    return normalised(m.select("c_from", "c_to", "prob"))


def area_transitions(first: DataFrame, last: DataFrame) -> DataFrame:
    """From two area tables: what losers lose goes to the gainers in proportion to their gains; the rest stays."""
    d = first.select("class_id", F.col("area").alias("a1")).join(last.select("class_id", F.col("area").alias("a2")), "class_id")
    gains = d.filter("a2 > a1").select(F.col("class_id").alias("c_to"), (F.col("a2") - F.col("a1")).alias("gain"))
    gains = gains.withColumn("part", F.col("gain") / F.sum("gain").over(Window.partitionBy()))  # a row for each class
    stay = d.select(F.col("class_id").alias("c_from"), F.col("class_id").alias("c_to"), F.when(F.col("a1") > 0, F.least(F.lit(1.0), F.try_divide("a2", "a1"))).otherwise(1.0).alias("prob"))
    lost = d.filter("a2 < a1").select(F.col("class_id").alias("c_from"), ((F.col("a1") - F.col("a2")) / F.col("a1")).alias("loss"), F.lit(1).alias("k"))
    moved = lost.join(gains.withColumn("k", F.lit(1)), "k").select("c_from", "c_to", (F.col("loss") * F.col("part")).alias("prob"))
    return stay.unionByName(moved)


def hindcast(simulated: DataFrame, observed: DataFrame) -> DataFrame:
    """Area agreement of a projection: relative mean absolute error, overall accuracy, figure of merit."""
    d = simulated.select("class_id", F.col("area").alias("sim")).join(observed.select("class_id", F.col("area").alias("obs")), "class_id", "full").fillna(0.0)
    e = F.abs(F.col("sim") - F.col("obs"))
    g = d.agg(F.sum(e).alias("e"), F.sum("obs").alias("t"), F.sum(F.least("sim", "obs")).alias("h"), F.sum(F.greatest(F.col("obs") - F.col("sim"), F.lit(0.0))).alias("m"), F.sum(F.greatest(F.col("sim") - F.col("obs"), F.lit(0.0))).alias("f"))
    return g.select((F.try_divide("e", "t") * 100).alias("rmae_pct"), (1 - F.try_divide(F.col("e"), 2 * F.col("t"))).alias("overall_accuracy"), F.try_divide(F.col("h"), F.col("h") + F.col("m") + F.col("f")).alias("figure_of_merit"))


def chained(areas: DataFrame, matrix: DataFrame, start: int, targets: list[int], step: int) -> DataFrame:
    """Areas at each target year, projected from the target before by as many whole steps as fit; targets closer than a step have no rows."""
    out, year = None, start
    for target in sorted(targets):
        n = (target - year) // step
        if n > 0:
            areas, year = project(areas, matrix, n), target
            row = areas.select(F.lit(target).alias("year"), F.lit(n).alias("steps"), "class_id", "area")
            out = row if out is None else out.unionByName(row)
    return areas.select(F.lit(start).alias("year"), F.lit(0).alias("steps"), "class_id", "area").limit(0) if out is None else out


def corrections(before: DataFrame, after: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """The log of a correction: cells whose probability changed, with both values."""
    b = before.select("c_from", "c_to", F.col("prob").alias("was"))
    a = after.select("c_from", "c_to", F.col("prob").alias("now"))
    return b.join(a, ["c_from", "c_to"], "full").fillna(0.0, ["was", "now"]).filter(F.abs(F.col("was") - F.col("now")) > tolerance)


def restricted(matrix: DataFrame, classes: list[int]) -> DataFrame:
    """The matrix of some classes, rows normalised."""
    return normalised(matrix.filter(F.col("c_from").isin(classes) & F.col("c_to").isin(classes)))

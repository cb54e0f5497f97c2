"""Class areas, transitions between two dates, and rates of change."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dominant_class(df: DataFrame, unit: list[str], cls: str) -> DataFrame:
    """The most frequent class of each unit; of equally frequent ones the smallest."""
    n = df.filter(F.col(cls).isNotNull()).groupBy(*unit, cls).agg(F.count("*").alias("n"))
    return n.groupBy(*unit).agg(F.max_by(F.col(cls), F.struct(F.col("n"), -F.col(cls))).alias(cls))


def dominant_by_period(df: DataFrame, unit: str, cls: str, area: str, periods: Mapping[str, Column]) -> DataFrame:
    """By unit, for each period (a name and its condition): the most frequent class, of ties the smallest, and the area.

    One pass: classes are counted by unit and period, then each unit's few rows become columns class_<name> and area_<name>,
    null where a unit lacks the period.
    """
    which = F.coalesce(*(F.when(c, F.lit(k)) for k, c in periods.items()))
    n = df.withColumn("__p", which).filter("__p IS NOT NULL").groupBy(unit, "__p", cls).agg(F.count("*").alias("__n"), F.sum(area).alias("__a"))
    mine = lambda k, x: F.when(F.col("__p") == k, x)
    aggs = [x for k in periods for x in (F.max_by(F.col(cls), mine(k, F.struct(F.col("__n"), -F.col(cls)))).alias(f"class_{k}"), F.sum(mine(k, F.col("__a"))).alias(f"area_{k}"))]
    return n.groupBy(unit).agg(*aggs)


def class_areas(df: DataFrame, cls: str, area: str, every: DataFrame | None = None, by: list[str] = ()) -> DataFrame:
    """Area by class, zero where `every` lists a class that has none."""
    got = df.groupBy(*by, cls).agg(F.sum(area).alias("area"))
    if every is None:
        return got
    return every.join(got, [*by, cls], "left").select(*by, cls, F.coalesce("area", F.lit(0.0)).alias("area"))


def composition(areas: DataFrame, by: list[str]) -> DataFrame:
    """Each row's share of its group's area, in percent."""
    total = F.sum("area").over(Window.partitionBy(*by))
    return areas.withColumn("share_pct", F.when(total > 0, F.col("area") / total * 100))


def transitions(before: DataFrame, after: DataFrame, unit: str, cls: str, area: str) -> DataFrame:
    """Area by (c_from, c_to) of the units that both dates have; area of the earlier date."""
    a = before.select(unit, F.col(cls).alias("c_from"), F.col(area).alias("__area"))
    b = after.select(unit, F.col(cls).alias("c_to"))
    return a.join(b, unit).groupBy("c_from", "c_to").agg(F.sum("__area").alias("area"), F.count("*").alias("n"))


def probabilities(matrix: DataFrame, weight: str = "n") -> DataFrame:
    """Row shares. A row without weight stays all zero."""
    total = F.sum(weight).over(Window.partitionBy("c_from"))
    return matrix.withColumn("prob", F.when(total > 0, F.col(weight) / total).otherwise(0.0))


def dense(matrix: DataFrame, classes: list[int], value: str = "prob") -> DataFrame:
    """Every pair of classes (a parameter, a few dozen), zero where the matrix has none."""
    pairs = matrix.sparkSession.createDataFrame([(a, b) for a in classes for b in classes], "c_from int, c_to int")
    return pairs.join(matrix.select("c_from", "c_to", value), ["c_from", "c_to"], "left").fillna(0.0, [value])


def change_rate(a1: Column, a2: Column, years: float) -> Column:
    """Puyravaud's annual rate in percent; zero where an area is zero."""
    return F.when((a1 > 0) & (a2 > 0), F.log(F.when(a1 > 0, a2 / F.nullif(a1, F.lit(0.0)))) / years * 100).otherwise(0.0)


def change_table(first: DataFrame, last: DataFrame, cls: str, years: float) -> DataFrame:
    """Per class: both areas, net change, percent and annual rate; a class that one date lacks has area zero there."""
    a, b = first.select(cls, F.col("area").alias("area_t1")), last.select(cls, F.col("area").alias("area_t2"))
    j = a.join(b, cls, "full").fillna(0.0, ["area_t1", "area_t2"])
    x, y = F.col("area_t1"), F.col("area_t2")
    return j.select(cls, x, y, (y - x).alias("net_change"), F.when(x > 0, F.try_divide(y - x, x) * 100).otherwise(0.0).alias("pct_change"), change_rate(x, y, years).alias("annual_rate_pct"))


def top_transitions(matrix: DataFrame, n: int = 6, weight: str = "area") -> DataFrame:
    """The n largest changes of class."""
    return matrix.filter("c_from <> c_to").withColumn("label", F.concat(F.col("c_from").cast("string"), F.lit("->"), F.col("c_to").cast("string"))).orderBy(F.abs(weight).desc(), "c_from", "c_to").limit(n)


def first_last(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Value at the first and the last of an order, and the change in percent."""
    got = df.groupBy(*by).agg(F.min_by(value, order).alias("first_value"), F.max_by(value, order).alias("last_value"))
    return got.withColumn("change_pct", F.try_divide(F.col("last_value") - F.col("first_value"), F.nullif("first_value", F.lit(0.0))) * 100)

"""Carbon, water, sediment and habitat models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carbon_uncertainty(df: DataFrame, by: list[str], area: str, area_se: str, density: str, density_se: str) -> DataFrame:
    """Sum of area times density with the error of a product; 95 percent limits."""
    a, sa, c, sc = (F.col(x) for x in (area, area_se, density, density_se))
    var = F.pow(c, 2) * F.pow(sa, 2) + F.pow(a, 2) * F.pow(sc, 2) + F.pow(sa, 2) * F.pow(sc, 2)
    g = df.groupBy(*by).agg(F.sum(a * c).alias("carbon"), F.sqrt(F.sum(var)).alias("carbon_se"))
    return g.withColumn("ci_low", F.col("carbon") - 1.96 * F.col("carbon_se")).withColumn("ci_high", F.col("carbon") + 1.96 * F.col("carbon_se"))


def change_uncertainty(df: DataFrame, order: str, by: list[str] = ()) -> DataFrame:
    """From one period to the next; a row for each period, of which there are few."""
    w = Window.partitionBy(*by).orderBy(order)
    d = df.withColumn("change", F.col("carbon") - F.lag("carbon").over(w)).withColumn("change_se", F.sqrt(F.pow("carbon_se", 2) + F.pow(F.lag("carbon_se").over(w), 2)))
    return d.filter("change IS NOT NULL").select(*by, order, "change", "change_se", (F.abs("change") > 1.96 * F.col("change_se")).alias("significant"))


def gain_loss(df: DataFrame, before: str, after: str, by: list[str] = ()) -> DataFrame:
    d = F.col(after) - F.col(before)
    return df.groupBy(*by).agg(F.sum(d).alias("net"), F.sum(F.least(d, F.lit(0.0))).alias("loss"), F.sum(F.greatest(d, F.lit(0.0))).alias("gain"))


def water_yield(p: Column, et: Column, kc: Column) -> Column:
    """Precipitation less crop evapotranspiration; without ET 40 percent of the precipitation stands for it."""
    return p - F.coalesce(et, 0.4 * p) * kc


def sediment(slope: Column, c_factor: Column) -> Column:
    x = 0.065 * slope
    return (x + 0.045) * x * c_factor


def habitat(suitability: Column, sensitivity: Column, farm: Column, town: Column, road: Column, k: float = 0.5, z: float = 2.5) -> Column:
    """Quality from suitability and threats that decay with distance in metres; a missing distance is no threat."""
    decay = lambda d, r: F.coalesce(F.exp(-d / r), F.lit(0.0))
    threat = (0.6 * decay(farm, 5000.0) + 0.3 * decay(town, 10000.0) + 0.1 * decay(road, 3000.0)) * sensitivity
    t = F.pow(threat, F.lit(z))
    return suitability * (1 - t / (t + k**z))

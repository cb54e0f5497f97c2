"""Statistics of classes by zone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import FOREST


def counts(df: DataFrame, zone: str, cls: str) -> DataFrame:
    return df.groupBy(zone, cls).agg(F.count("*").alias("n"))


def summary(counted: DataFrame, zone: str, cls: str, density: Column, forest: Sequence[int] = FOREST) -> DataFrame:
    """Forest percent, dominant class (ties: the smallest), mean carbon density by zone."""
    total = F.sum("n")
    return counted.groupBy(zone).agg((F.sum(F.when(F.col(cls).isin(*forest), F.col("n")).otherwise(0)) / total * 100).alias("forest_pct"), F.max_by(F.col(cls), F.struct(F.col("n"), -F.col(cls))).alias("dominant"), (F.sum(F.col("n") * density) / total).alias("carbon_density"))

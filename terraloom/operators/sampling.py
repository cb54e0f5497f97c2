"""Deterministic samples: a row's draw follows from a seed and its id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str, key: str) -> Column:
    """A number in [0, 1) that other engines compute alike: 28 bits of md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")), 1, 7), 16, 10).cast("long") / F.lit(float(1 << 28))


def stratified(df: DataFrame, cls: str, key: str, n: int, seed: str = "42") -> DataFrame:
    """n rows of each class, those of least draw. The window keeps n rows a class and task before the shuffle."""
    w = Window.partitionBy(cls).orderBy("__draw", key)
    return df.withColumn("__draw", draw(seed, key)).withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__draw", "__rank")


def split(df: DataFrame, key: str, share: float = 0.7, seed: str = "42") -> DataFrame:
    """Adds is_training."""
    return df.withColumn("is_training", draw(seed, key) < share)


def folds(df: DataFrame, x: str, k: int = 5) -> DataFrame:
    """Adds a fold by equal strips along x."""
    ends = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    return df.join(F.broadcast(ends)).withColumn("fold", F.least(F.floor(F.coalesce(F.try_divide(F.col(x) - F.col("__lo"), (F.col("__hi") - F.col("__lo")) / k), F.lit(0.0))), F.lit(k - 1)).cast("int")).drop("__lo", "__hi")

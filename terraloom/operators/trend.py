"""Series by calendar buckets, trends and drought indices."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def series(df: DataFrame, ts: str, value: str, unit: str = "year", by: Sequence[str] = ()) -> DataFrame:
    """Sum, mean and count by calendar bucket."""
    return df.groupBy(*by, F.date_trunc(unit, F.col(ts)).cast("date").alias("bucket")).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.count(value).alias("n"))


def anomalies(df: DataFrame, by: Sequence[str], value: str, reference: Column | None = None) -> DataFrame:
    """Adds z against the group's mean and population deviation (over rows where `reference` holds); null if flat."""
    x = F.col(value) if reference is None else F.when(reference, F.col(value))
    g = df.groupBy(*by).agg(F.avg(x).alias("__m"), F.stddev_pop(x).alias("__s"))
    return df.join(g, list(by)).withColumn("z", F.try_divide(F.col(value) - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def drought_frequency(df: DataFrame, by: Sequence[str], index: str, below: float = -1.0) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col(index) < below).cast("int")).alias("frequency"))


def pairs(df: DataFrame, by: Sequence[str], t: str, value: str) -> DataFrame:
    """Pairs of a series' points, earlier first; a series is a few dozen buckets, and joined by its key."""
    a = df.select(*by, F.col(t).alias("t1"), F.col(value).alias("v1"))
    b = df.select(*by, F.col(t).alias("t2"), F.col(value).alias("v2"))
    return a.join(b, list(by)).filter("t1 < t2")


def sen_slope(df: DataFrame, by: Sequence[str], t: str, value: str) -> DataFrame:
    return pairs(df, by, t, value).groupBy(*by).agg(F.median((F.col("v2") - F.col("v1")) / (F.col("t2") - F.col("t1"))).alias("sen_slope"))


def normal_p(z: Column) -> Column:
    """Two-sided probability of a standard normal beyond z: the complementary error function by its Chebyshev fit (relative error 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # The fit's coefficients.
    fit = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = functools.reduce(lambda acc, c: acc * t + c, reversed(fit[:-1]), F.lit(fit[-1]))
    return F.least(t * F.exp(-x * x + poly), F.lit(1.0))


#: Series up to this length without ties have an exact probability.
EXACT = 33


def exact_kendall(spark: SparkSession, most: int = EXACT) -> DataFrame:
    """n, c, p: the two-sided probability of c or fewer pairs on the rarer side among orders of n values.

    Orders with k inversions are counted by the rule that a further value adds 0 to n - 1 of them.
    """
    rows, counts = [], [1]
    for n in range(2, most + 1):
        sums = [0, *itertools.accumulate(counts)]
        counts = [sums[min(k + 1, len(counts))] - sums[max(0, k + 1 - n)] for k in range(len(counts) + n - 1)]
        total, run = math.factorial(n), 0
        for c in range(n * (n - 1) // 4 + 1):
            run += counts[c]
            rows.append((n, c, min(1.0, 2 * run / total)))
    return spark.createDataFrame(rows, "n long, c long, p double")


def kendall(df: DataFrame, by: Sequence[str], t: str, value: str) -> DataFrame:
    """Tau-b, S, its normal score with continuity under the tie-corrected variance, and the two-sided probability.

    Exact for up to EXACT values without ties, else of the normal score without continuity. Times are distinct.
    """
    p = pairs(df, by, t, value).groupBy(*by).agg(F.sum(F.signum(F.col("v2") - F.col("v1"))).alias("s"), F.count("*").alias("n0"), F.sum((F.col("v1") == F.col("v2")).cast("int")).alias("tied"))
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    ties = df.groupBy(*by, value).agg(F.count("*").alias("m")).groupBy(*by).agg(F.sum(F.col("m") * (F.col("m") - 1) * (2 * F.col("m") + 5)).alias("ties"))
    d = p.join(n, list(by)).join(ties, list(by))
    var = (F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("ties")) / 18.0
    tau = F.try_divide(F.col("s"), F.sqrt(F.col("n0").cast("double") * (F.col("n0") - F.col("tied"))))
    rarer = F.when(F.col("tied") == 0, F.floor((F.col("n0") - F.abs("s")) / 2).cast("long"))
    d = d.withColumn("c", rarer).join(F.broadcast(exact_kendall(df.sparkSession).withColumnRenamed("p", "exact")), ["n", "c"], "left")  # a few thousand rows
    return d.select(*by, "s", tau.alias("tau"), F.try_divide(F.col("s") - F.signum("s"), F.sqrt(var)).alias("z"), F.coalesce("exact", normal_p(F.try_divide("s", F.sqrt(var)))).alias("p"))


def linear(df: DataFrame, by: Sequence[str], t: str, value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(value, t).alias("slope"), F.regr_intercept(value, t).alias("intercept"), F.regr_r2(value, t).alias("r2"), F.corr(t, value).alias("pearson"))


def consecutive(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """Each bucket with the change since the one before."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("change", F.col(value) - F.lag(value).over(w))


def loss_by_period(losses: DataFrame, periods: DataFrame, year: str, value: str) -> DataFrame:
    """Sums of losses whose year lies in a period; periods are a small dimension table, years few: both are aggregated first."""
    yearly = losses.groupBy(F.col(year).alias("__y")).agg(F.sum(value).alias("__v"))
    return periods.join(yearly, F.col("__y").between(F.col("first_year"), F.col("last_year")), "left").groupBy("period").agg(F.coalesce(F.sum("__v"), F.lit(0.0)).alias("loss"))

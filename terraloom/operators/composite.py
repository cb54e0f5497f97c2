"""Composites over time, stretches and bins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def median_composite(obs: DataFrame, cell: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Exact medians and the number of scenes; nulls are masked values."""
    return obs.groupBy(*cell).agg(*(F.median(b).alias(b) for b in bands), F.count("*").alias("n_scenes"))


def coverage(obs: DataFrame, cell: Sequence[str], band: str) -> DataFrame:
    """The share of observations that are valid."""
    return obs.groupBy(*cell).agg(F.avg(F.col(band).isNotNull().cast("int")).alias("coverage"))


def percentiles(df: DataFrame, x: str, shares: Sequence[float]) -> list[float | None]:
    """Exact percentiles of a column (linear between order statistics), without a buffer of the column.

    A sketch brackets each order statistic that is needed; one pass counts the values below the brackets, and only those
    inside are grouped and ordered, a few thousandths of the column. Nulls don't count; None for an empty column.
    """
    d = df.select(F.col(x).cast("double").alias("v")).filter("v IS NOT NULL")
    n = d.count()
    if not n:
        return [None] * len(shares)
    want = sorted({int(i) for s in shares for i in (math.floor((n - 1) * s), math.ceil((n - 1) * s))})
    slack, grain = 1 / 500, 1000
    ends = [(max(0.0, w / n - 2 * slack), min(1.0, (w + 1) / n + 2 * slack)) for w in want]
    lows, highs = d.agg(F.percentile_approx("v", [e[0] for e in ends], grain), F.percentile_approx("v", [e[1] for e in ends], grain)).first()
    brackets = [(-math.inf if e[0] == 0 else lo, math.inf if e[1] == 1 else hi) for e, lo, hi in zip(ends, lows, highs, strict=True)]
    below = d.agg(*(F.count_if(F.col("v") < lo) for lo, _ in brackets)).first()
    near = None
    for k, ((lo, hi), w) in enumerate(zip(brackets, want, strict=True)):
        row = d.filter((F.col("v") >= lo) & (F.col("v") <= hi)).groupBy("v").agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "v", "n")
        near = row if near is None else near.unionByName(row)
    # order statistic w of a bracket: the least value with more than w - below values up to it
    run = F.sum("n").over(Window.partitionBy("k").orderBy("v"))
    need = F.create_map(*(F.lit(y) for k, w in enumerate(want) for y in (k, w - below[k])))
    found = {want[r["k"]]: r["v"] for r in near.withColumn("run", run).filter(F.col("run") > need[F.col("k")]).groupBy("k").agg(F.min("v").alias("v")).collect()}
    out = []
    for s in shares:
        at = (n - 1) * s
        lo, hi = found[math.floor(at)], found[math.ceil(at)]
        out.append(lo + (hi - lo) * (at - math.floor(at)))
    return out


def with_percentiles(df: DataFrame, x: str, shares: Sequence[float], exact: bool = True) -> DataFrame:
    """Adds the array __p of percentiles of the whole column: a literal, or one row of a sketch, broadcast."""
    if exact:
        return df.withColumn("__p", F.array(*(F.lit(p).cast("double") for p in percentiles(df, x, shares))))
    return df.join(F.broadcast(df.agg(F.percentile_approx(x, [float(s) for s in shares]).alias("__p"))))


def stretch(df: DataFrame, x: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Adds `stretched`: 0 to 255 between two percentiles."""
    d = with_percentiles(df, x, [low, high])
    lo, hi = F.col("__p")[0], F.col("__p")[1]
    y = F.coalesce(F.try_divide(F.col(x) - lo, hi - lo), F.lit(0.0)) * 255
    return d.withColumn("stretched", F.when(F.col(x).isNotNull(), F.floor(F.greatest(F.least(y, F.lit(255.0)), F.lit(0.0))).cast("int"))).drop("__p")


def binned(x: Column, edges: Sequence[Column], right: bool = True) -> Column:
    """The number of edges below x (at or below, if not right)."""
    return sum((((x > e) if right else (x >= e)).cast("int") for e in edges[1:]), ((x > edges[0]) if right else (x >= edges[0])).cast("int"))


def percentile_bins(df: DataFrame, x: str, shares: Sequence[float] = (0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """Adds `bin`: 0 to len(shares), by edge[i-1] < x <= edge[i]."""
    return with_percentiles(df, x, shares).withColumn("bin", binned(F.col(x), [F.col("__p")[k] for k in range(len(shares))])).drop("__p")


def divergent_bins(df: DataFrame, x: str, n: int = 9) -> DataFrame:
    """Adds `bin` of n equal parts of [-v, v], v the larger of the absolute 5th and 95th percentiles."""
    d = with_percentiles(df, x, [0.05, 0.95])
    v = F.greatest(F.abs(F.col("__p")[0]), F.abs(F.col("__p")[1]))
    return d.withColumn("bin", binned(F.col(x), [-v + v * (2.0 * k / n) for k in range(1, n)])).drop("__p")


def standardised(df: DataFrame, x: str) -> DataFrame:
    """Adds z (population deviation, 1 if zero) and unit (0..1, 0 if flat)."""
    g = df.agg(F.avg(x).alias("__m"), F.stddev_pop(x).alias("__s"), F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    d = df.join(F.broadcast(g))
    s = F.when(F.col("__s") > 0, F.col("__s")).otherwise(1.0)
    unit = F.coalesce(F.try_divide(F.col(x) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.when(F.col(x).isNotNull(), F.lit(0.0)))
    return d.withColumn("z", (F.col(x) - F.col("__m")) / s).withColumn("unit", unit).drop("__m", "__s", "__lo", "__hi")


def significance(z: Column) -> Column:
    """-3 to 3 by the two-sided 10, 5 and 1 percent."""
    levels = (1.645, 1.96, 2.576)
    n = sum(((F.abs(z) >= v).cast("int") for v in levels[1:]), (F.abs(z) >= levels[0]).cast("int"))
    return (F.signum(z).cast("int") * n).cast("int")


def z_classes(z: Column, edges: Sequence[float] = (-2.576, -1.96, -1.645, -0.5, 0.5, 1.645, 1.96, 2.576)) -> Column:
    """0 to 8: the number of fixed edges that z exceeds."""
    return binned(z, [F.lit(e) for e in edges])


def mosaic(images: DataFrame, cell: Sequence[str], order: str, bands: Sequence[str]) -> DataFrame:
    """By cell, each band of the last image that has it."""
    return images.groupBy(*cell).agg(*(F.max_by(b, F.when(F.col(b).isNotNull(), F.col(order))).alias(b) for b in bands))


def merged(*collections: DataFrame) -> DataFrame:
    """Collections of the same bands, one after another."""
    out = collections[0]
    for c in collections[1:]:
        out = out.unionByName(c)
    return out

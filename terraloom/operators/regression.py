"""Global and local regression."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import kept, ship_package
from .spatial import within
from .tiles import finite, nearest

#: Points that one call solves at a time, as stacked systems.
POINTS = 1024


def gram(df: DataFrame, y: str, xs: list[str]) -> tuple[np.ndarray, int]:
    """Sums of products of (1, xs, y) in one pass: a row of a few dozen numbers reaches the driver."""
    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in [*xs, y])]
    d = df.dropna(subset=[*xs, y])
    k = len(cols)
    row = d.agg(*(F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k))).first()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"s{i}_{j}"] or 0.0
    return g, int(g[0, 0])


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Terms with coefficient, error, t and variance inflation, and the fit's R2, adjusted R2 and AIC on every row."""
    spark = df.sparkSession
    g, n = gram(df, y, xs)
    k = len(xs) + 1
    a, b = g[:k, :k], g[:k, k]
    inv = np.linalg.pinv(a)
    beta = inv @ b
    sse = float(max(g[k, k] - beta @ b, 0.0))
    sst = float(g[k, k] - g[0, k] ** 2 / max(n, 1))
    dof = max(n - k, 1)
    se = np.sqrt(np.maximum(np.diag(inv) * sse / dof, 0))
    r2 = 1 - sse / sst if sst > 0 else 0.0
    cov = a[1:, 1:] - np.outer(a[0, 1:], a[0, 1:]) / max(n, 1)
    dev = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    vif = np.diag(np.linalg.pinv(cov / np.outer(dev, dev))) if k > 1 else np.zeros(0)
    rows = [(name, float(beta[i]), float(se[i]), float(beta[i] / se[i]) if se[i] else None, float(vif[i - 1]) if i else None, r2, 1 - (1 - r2) * (n - 1) / dof, float(n * np.log(sse / n) + 2 * k) if n and sse else None, n) for i, name in enumerate(["intercept", *xs])]
    return spark.createDataFrame(rows, "term string, coefficient double, std_error double, t double, vif double, r2 double, adj_r2 double, aic double, n long")


def local_fits(x: np.ndarray, y: np.ndarray, w: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
    """Weighted fits of stacked neighbourhoods: x (m, k, p), y and w (m, k), own (m, p) the points themselves, of weight 1.

    Coefficients, local R2, fitted value and the point's own share of it, each of m. Singular systems take the least solution.
    """
    xtw = np.swapaxes(x, 1, 2) * w[:, None, :]
    a, b = xtw @ x, (xtw @ y[:, :, None])[:, :, 0]
    inverse = np.linalg.pinv(a, hermitian=True)
    try:
        good = np.linalg.cond(a) < 1e12
        inverse[good] = np.linalg.inv(a[good])
    except np.linalg.LinAlgError:
        pass
    beta = (inverse @ b[:, :, None])[:, :, 0]
    off = y - (x @ beta[:, :, None])[:, :, 0]
    total = w.sum(1)
    mean = np.divide((w * y).sum(1), total, out=np.zeros(len(y)), where=total > 0)
    sst = (w * (y - mean[:, None]) ** 2).sum(1)
    r2 = np.where(sst > 1e-12, 1 - np.divide((w * off**2).sum(1), sst, out=np.ones(len(y)), where=sst > 1e-12), 0.0)
    return beta, r2, (own * beta).sum(1), np.einsum("mp,mpq,mq->m", own, inverse, own)


def _neighbourhoods(points: DataFrame, y: str, xs: list[str], k: int, radius: float, kernel: str) -> DataFrame:
    """Rows (i, j, d, __y, __x0, ...) of each point itself and of at least its k nearest others, or of those within 8 bandwidths; in buckets of about POINTS."""
    values = {"__y": y} | {f"__x{n}": x for n, x in enumerate(xs)}
    p = kept(points.select("id", "x", "y", *(F.col(c).cast("double").alias(name) for name, c in values.items())), "gwr-points")
    if kernel == "adaptive":
        e = nearest(p, p, k, list(values), itself=False).unionByName(finite(p).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d"), *values))
    else:
        e = within(p, p, 8 * radius).join(p.select(F.col("id").alias("j"), *values), "j")
    buckets = max(1, -(-p.count() // POINTS))
    return e.withColumn("__bucket", F.pmod(F.xxhash64("i"), F.lit(buckets))).repartition(min(buckets, 1024), "__bucket")


def _fits(table: pa.Table, m: int, ks: Sequence[int], radius: float, kernel: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each number of neighbours: ids, coefficients, local R2, fitted value, residual and leverage of a bucket's points."""
    adaptive = kernel == "adaptive"
    i, j, far, v = (table.column(c).to_numpy() for c in ("i", "j", "d", "__y"))
    order = np.lexsort((j, far, i != j, i))  # a point comes before its neighbours
    i, j, far, v = i[order], j[order], far[order], v[order]
    ids, first, many = np.unique(i, return_index=True, return_counts=True)
    z = np.stack([np.ones(len(i)), *(table.column(f"__x{n}").to_numpy()[order] for n in range(m))], 1)
    for k in ks:
        count = np.minimum(many, k + 1) if adaptive else many
        wide = int(count.max())
        place = first[:, None] + np.minimum(np.arange(wide), count[:, None] - 1)
        there = np.arange(wide) < count[:, None]
        x, dist = z[place], far[place]
        if adaptive:
            u = dist / np.maximum(np.where(there, dist, 0).max(1), 1e-12)[:, None]
            w = np.where(there & (u < 1), (1 - u**2) ** 2, 0.0)
        else:
            w = np.where(there, np.exp(-0.5 * (dist / radius) ** 2), 0.0)
        beta, r2, fitted, leverage = local_fits(x, v[place], w, z[first])
        yield k, [ids, *beta.T, r2, fitted, v[first] - fitted, leverage]


def gwr(points: DataFrame, y: str, xs: list[str], k: int, radius: float, kernel: str = "adaptive") -> DataFrame:
    """Local fits: id, b0, b1, ..., local_r2, fitted, residual, leverage for each of points(id, x, y, ...).

    adaptive: bisquare weights up to the k-th nearest other point, which is at the bandwidth. fixed: Gaussian weights of
    bandwidth `radius`, points beyond 8 of which (weights under 1e-13) are left out. Systems are solved POINTS at a time.
    """
    ship_package(points.sparkSession)
    d = _neighbourhoods(points, y, xs, k, radius, kernel)
    m = len(xs)
    names = ["id", *(f"b{n}" for n in range(m + 1)), "local_r2", "fitted", "residual", "leverage"]

    def fit(table: pa.Table) -> pa.Table:
        [(_, columns)] = _fits(table, m, [k], radius, kernel)
        return pa.table(dict(zip(names, columns, strict=True)))

    schema = "id long, " + ", ".join(f"{n} double" for n in names[1:])
    return d.groupBy("__bucket").applyInArrow(lambda t: fit(t), schema)


def fit_aic() -> Column:
    """n ln of the mean squared residual, plus twice the trace."""
    sse = F.when(F.col("sse") > 0, F.col("sse"))
    return (F.col("n") * F.log(sse / F.col("n")) + 2 * F.col("trace")).alias("aic")


def gwr_fit(local: DataFrame) -> DataFrame:
    """One row: n, AIC (n ln of the mean squared residual, plus twice the trace), mean and median R2, the trace and its share of n."""
    g = local.agg(F.count("*").alias("n"), F.sum(F.col("residual") ** 2).alias("sse"), F.sum("leverage").alias("trace"), F.avg("local_r2").alias("mean_r2"), F.median("local_r2").alias("median_r2"))
    return g.select("n", fit_aic(), "mean_r2", "median_r2", "trace", F.try_divide("trace", "n").alias("trace_share"))


def bandwidths(n: int, p: int, steps: int = 20) -> list[int]:
    """Numbers of neighbours from p + 3 to 0.8 n in even steps."""
    return sorted({int(x) for x in np.linspace(p + 3, max(p + 3, int(n * 0.8)), steps)})


def bandwidth_search(points: DataFrame, y: str, xs: list[str], radius: float, steps: int = 20, most: int | None = None) -> DataFrame:
    """bandwidth, aic, mean_r2, trace and whether it is the best, for each of `bandwidths` (up to `most`, if given).

    The neighbours of the widest are found once; each bucket of points fits all bandwidths on them.
    """
    n = points.count()
    ks = [k for k in bandwidths(min(n, most or n), len(xs), steps) if k < n]
    ship_package(points.sparkSession)
    m = len(xs)

    def fit(table: pa.Table) -> pa.Table:
        rows = [(k, len(c[0]), float((c[-2] ** 2).sum()), float(c[-1].sum()), float(c[-4].sum())) for k, c in _fits(table, m, ks, radius, "adaptive")]
        return pa.table(list(zip(*rows, strict=True)), schema=sums)

    sums = pa.schema([("bandwidth", pa.int32()), ("n", pa.int64()), ("sse", pa.float64()), ("trace", pa.float64()), ("r2", pa.float64())])
    parts = _neighbourhoods(points, y, xs, max(ks), radius, "adaptive").groupBy("__bucket").applyInArrow(lambda t: fit(t), "bandwidth int, n long, sse double, trace double, r2 double")
    g = parts.groupBy("bandwidth").agg(*(F.sum(c).alias(c) for c in ("n", "sse", "trace", "r2")))
    found = kept(g.select("bandwidth", fit_aic(), (F.col("r2") / F.col("n")).alias("mean_r2"), "trace"), "gwr-bandwidths")
    best = found.agg(F.min_by("bandwidth", "aic").alias("best"))
    return found.join(F.broadcast(best)).select("bandwidth", "aic", "mean_r2", "trace", (F.col("bandwidth") == F.col("best")).alias("is_best"))  # one row


def compared(global_fit: DataFrame, local_fit: DataFrame) -> DataFrame:
    """The row of `ols` terms against that of `gwr_fit`: gains in R2 and AIC, and which is preferred."""
    o = global_fit.agg(F.first("r2").alias("ols_r2"), F.first("adj_r2").alias("ols_adj_r2"), F.first("aic").alias("ols_aic"))
    d = o.join(F.broadcast(local_fit.select(F.col("mean_r2").alias("gwr_mean_r2"), F.col("aic").alias("gwr_aic"))))  # one row each
    return d.withColumn("r2_improvement", F.col("gwr_mean_r2") - F.col("ols_r2")).withColumn("aic_improvement", F.col("ols_aic") - F.col("gwr_aic")).withColumn("gwr_preferred", F.col("gwr_aic") < F.col("ols_aic"))


def summary(local: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, median, deviation, extremes and signs of local coefficients: one pass."""
    d = local.selectExpr("inline(array(" + ", ".join(f"struct('{c}' AS term, {c} AS b)" for c in columns) + "))")
    return d.groupBy("term").agg(F.avg("b").alias("mean"), F.median("b").alias("median"), F.stddev_pop("b").alias("std"), F.min("b").alias("low"), F.max("b").alias("high"), (F.avg((F.col("b") > 0).cast("int")) * 100).alias("pct_positive"), (F.avg((F.col("b") < 0).cast("int")) * 100).alias("pct_negative"))

"""Classifiers, segmentation of series, and cellular simulation."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dims import BAG, LEAF, SEED, TREES
from ..session import kept, ship_package
from . import accuracy, sampling

#: Cells whose series one call segments.
CELLS = 2048


#: Depth at which a tree stops.
DEPTH = 12


def random_forest(train: DataFrame, rows: DataFrame, label: str, features: list[str], trees: int = TREES, leaf: int = LEAF, share: float = BAG, seed: int = SEED, depth: int = DEPTH) -> tuple[DataFrame, list[tuple[str, float]]]:
    """rows with `predicted` and `confidence` (the largest class probability), and the features by falling importance.

    Rows with a missing feature are left out. Labels are whole numbers from 0 on.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=features, outputCol="__f", handleInvalid="skip")
    model = RandomForestClassifier(labelCol="__l", featuresCol="__f", numTrees=trees, minInstancesPerNode=leaf, maxDepth=depth, subsamplingRate=share, seed=seed).fit(v.transform(train.withColumn("__l", F.col(label).cast("double"))))
    out = model.transform(v.transform(rows)).withColumn("predicted", F.col("prediction").cast("int")).withColumn("confidence", F.array_max(vector_to_array("probability")))
    return out.drop("__f", "rawPrediction", "probability", "prediction"), sorted(zip(features, map(float, model.featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))


def importance_table(spark: SparkSession, runs: Mapping[str, Sequence[tuple[str, float]]]) -> DataFrame:
    """run, feature, importance: a row for each feature that a run has."""
    return spark.createDataFrame([(r, f, float(x)) for r, every in runs.items() for f, x in every], "run string, feature string, importance double")


def spatial_cv(df: DataFrame, key: str, x: str, label: str, features: list[str], folds: int = 5, train_n: int = 500, test_n: int = 100, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """Overall accuracy and kappa of each of `folds` strips along x, classified by a forest of rows outside of it.

    Both sides are stratified: at most train_n and test_n rows a class, drawn by key and the fold's seed.
    """
    strips = kept(sampling.folds(df, x, folds), "cv-strips")
    out = None
    for k in range(folds):
        train = sampling.stratified(strips.filter(F.col("fold") != k), label, key, train_n, str(seed + k))
        test = sampling.stratified(strips.filter(F.col("fold") == k), label, key, test_n, str(seed + k + 100))
        got, _ = random_forest(train, test, label, features, trees=trees, seed=seed)
        row = accuracy.overall(accuracy.confusion(got, label, "predicted")).select(F.lit(k + 1).alias("fold"), "n", "overall_accuracy", "kappa")
        out = row if out is None else out.unionByName(row)
    return kept(out, "cv-folds")


# Drivers of a class's suitability, each scaled to 0..1, with weights; a minus takes one less the driver.
SUITABILITY = {
    1: {"-dist_roads": 0.2, "-pop_density": 0.3, "slope": 0.2, "elevation": 0.15, "dist_rivers": 0.15},
    2: {"-dist_roads": 0.15, "-pop_density": 0.2, "slope": 0.25, "elevation": 0.2, "dist_rivers": 0.2},
    3: {"dist_roads": 0.3, "-slope": 0.3, "-elevation": 0.2, "pop_density": 0.2},
    4: {"dist_roads": 0.25, "dist_rivers": 0.25, "-slope": 0.3, "pop_density": 0.2},
    5: {"dist_rivers": 0.6, "-elevation": 0.3, "-slope": 0.1},
    6: {"dist_roads": 0.35, "pop_density": 0.4, "-slope": 0.15, "-elevation": 0.1},
    7: {"dist_roads": 0.3, "-slope": 0.2, "pop_density": 0.3, "-elevation": 0.2},
}


def suitability(cells: DataFrame, weights: Mapping[int, Mapping[str, float]] = SUITABILITY) -> DataFrame:
    """cells with a column s1, s2, ... for each class: weighted sums of drivers scaled to 0..1 (0 if flat; null stays null)."""
    drivers = sorted({d.lstrip("-") for w in weights.values() for d in w})
    ends = cells.agg(*(f(d).alias(f"__{k}_{d}") for d in drivers for k, f in (("lo", F.min), ("hi", F.max))))
    d = cells.join(F.broadcast(ends))  # one row
    lo, hi = (lambda x: F.col(f"__lo_{x}")), (lambda x: F.col(f"__hi_{x}"))
    unit = {x: F.when(F.col(x).isNotNull(), F.coalesce(F.try_divide(F.col(x) - lo(x), hi(x) - lo(x)), F.lit(0.0))) for x in drivers}
    total = lambda w: functools.reduce(operator.add, ((1 - unit[x[1:]] if x.startswith("-") else unit[x]) * v for x, v in w.items()))
    return d.select(*cells.columns, *(total(w).alias(f"s{k}") for k, w in weights.items()))


def segmented(years: np.ndarray, values: np.ndarray, segments: int = 6, recovery: float = 0.25, gain: float = 0.02) -> np.ndarray:
    """A broken line through a series. Vertices are added one by one where the line is farthest off; of these lines the one
    with the least squared error stays, each vertex costing `gain` of the series' own. A line with a segment that recovers
    faster than 1 / recovery years is not taken.
    """
    n = len(years)
    vertex = [0, n - 1] if n > 1 else [0]
    spread = float(((values - values.mean()) ** 2).sum()) or 1.0
    best = None
    while True:
        fit = np.interp(years, years[vertex], values[vertex])
        rise = np.diff(fit) / np.diff(years) / (np.ptp(values) or 1.0)
        cost = float(((values - fit) ** 2).sum()) + gain * spread * len(vertex)
        if best is None or cost < best[0] and not (rise > 1 / recovery).any():
            best = cost, fit
        off = np.abs(values - fit)
        off[vertex] = 0
        if len(vertex) > segments or off.max() <= 0:
            return best[1]
        vertex = sorted({*vertex, int(off.argmax())})


def disturbances(df: DataFrame, cell: str, year: str, value: str, least: float = 0.0) -> DataFrame:
    """By cell: the largest fall of the segmented series, its year, and the range of the fit. A series is a few dozen years.

    Cells are dealt by hash into groups of about CELLS, each of which one call segments; cells without a value are left out.
    """
    ship_package(df.sparkSession)
    kind = dict(df.dtypes)[cell]
    d = df.select(F.col(cell).alias("cell"), F.col(year).cast("int").alias("t"), F.col(value).cast("double").alias("v")).dropna(subset=["t", "v"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for name, p in pdf.sort_values(["cell", "t"]).groupby("cell", dropna=False):
            fit = segmented(p["t"].to_numpy(float), p["v"].to_numpy(float))
            fall = np.concatenate([[0.0], fit[:-1] - fit[1:]])
            k = int(fall.argmax())
            rows.append((name, float(fall[k]), int(p["t"].iloc[k]), float(fit.max() - fit.min())))
        return pd.DataFrame(rows, columns=["cell", "magnitude", "at", "span"])

    buckets = max(1, -(-d.agg(F.approx_count_distinct("cell")).first()[0] // CELLS))
    return d.groupBy(F.pmod(F.xxhash64("cell"), F.lit(buckets)).alias("__bucket")).applyInPandas(lambda pdf: run(pdf.drop(columns="__bucket", errors="ignore")), f"cell {kind}, magnitude double, at int, span double").filter(F.col("span") >= least)


def simulate(cells: DataFrame, targets: dict[int, int], suitability: str | Mapping[int, str], cls: str = "class_id", weight: float = 0.3, radius: int = 2, chance: dict[tuple[int, int], float] | None = None) -> DataFrame:
    """A cellular automaton on (row, col, class, suitability) that moves the classes to their targets.

    In each round every cell of a class above its target bids for the class below its target where its score is best: the mix
    of suitability (a column, or one for each class) and neighbourhood, times the chance of that transition (1 if not given;
    under 0.001 it is ruled out). A class takes the best bids for it up to what it lacks, and gives the best up to its excess;
    ties by place. Rounds end when no bid is left; each fills a class or empties an excess, or takes all bids, so there are
    few. A cell moves once.
    """
    from .focal import _sent

    def placed(bids: DataFrame, group: str, quota: dict[int, int]) -> DataFrame:
        b = bids.withColumn("__b", F.floor(F.col("__score") * 4096))
        counts = b.groupBy(group, "__b").agg(F.count("*").alias("__n"))  # 4097 rows a class at most
        counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        r = F.col("__before") + F.row_number().over(Window.partitionBy(group, "__b").orderBy(F.desc("__score"), "row", "col"))
        most = F.create_map(*(F.lit(x) for kv in quota.items() for x in kv))
        return b.join(counts, [group, "__b"]).withColumn("__r", r).filter(F.col("__r") <= most[F.col(group)]).select(*bids.columns)

    now = cells.select("row", "col", F.col(cls).alias("__was"), F.col(cls).alias("__now"), *((F.col(suitability).alias("__s"),) if isinstance(suitability, str) else (F.col(c).alias(f"__s{k}") for k, c in suitability.items())))
    suits = F.col("__s") if isinstance(suitability, str) else F.coalesce(*(F.when(F.col("__to") == k, F.col(f"__s{k}")) for k in suitability), F.lit(0.0))
    while True:
        have = {r[0]: r[1] for r in now.groupBy("__now").count().collect()}  # a row a class
        lacks = {k: n - have.get(k, 0) for k, n in targets.items()}
        grow, spare = {k: n for k, n in lacks.items() if n > 0}, {k: -n for k, n in lacks.items() if n < 0}
        ways = [(a, k, 1.0 if chance is None else float(chance.get((a, k), 0.0))) for a in sorted(spare) for k in sorted(grow)]
        ways = [w for w in ways if w[2] >= 0.001]
        if not ways:
            break
        ways = cells.sparkSession.createDataFrame(ways, f"__now {dict(cells.dtypes)[cls]}, __to {dict(cells.dtypes)[cls]}, __p double")
        near = _sent(now, radius, "__now").filter(F.col("v").isin(*grow)).groupBy("row", "col", F.col("v").alias("__to")).agg((F.count("*") / float((2 * radius + 1) ** 2)).alias("__near"))
        bids = now.filter("__now = __was").join(F.broadcast(ways), "__now").join(near, ["row", "col", "__to"], "left")
        bids = bids.withColumn("__score", F.col("__p") * ((1 - weight) * suits + weight * F.coalesce("__near", F.lit(0.0))))
        best = bids.groupBy("row", "col", "__now").agg(F.max(F.struct("__score", (-F.col("__to")).alias("__less"))).alias("__m")).select("row", "col", "__now", F.col("__m")["__score"].alias("__score"), (-F.col("__m")["__less"]).alias("__to"))
        won = kept(placed(placed(best, "__to", grow), "__now", spare).select("row", "col", "__to"), "simulate-won")
        if won.isEmpty():
            break
        now = kept(now.join(won, ["row", "col"], "left").withColumn("__now", F.coalesce("__to", "__now")).drop("__to"), "simulated")
    return cells.join(now.select("row", "col", F.col("__now").alias("simulated")), ["row", "col"])

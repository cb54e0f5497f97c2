"""Tables and indicators of the reports: by municipality, by zone, by period."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions.dims import AREA_CI, CARBON, CARBON_ERROR, CLASSES, ZONAL_FOREST


def transitions_by_zone(cells: DataFrame, zone: str, code: str, area: str) -> DataFrame:
    """By zone: the sum of transition code times area, as published, and the area that changed class, which the code hides."""
    moved = F.col(code).cast("int").isNotNull() & (F.expr(f"{code} div 10") != F.col(code) % 10)
    return cells.groupBy(zone).agg(F.sum(F.col(code) * F.col(area)).alias("code_area"), F.sum(area).alias("area"), F.sum(F.when(moved, F.col(area)).otherwise(0.0)).alias("changed_area"))


def zone_indicators(cells: DataFrame, zone: str, before: str, after: str, cover: str, loss: str, cell_ha: float, forest: Sequence[int] = ZONAL_FOREST, carbon: Mapping[int, float] = CARBON) -> DataFrame:
    """By zone: forest percents at both dates, rate of loss, net change in hectares, carbon change, and tree cover and loss.

    cover and loss count as no data where they are 0 in their means; the share of cells with any loss counts zeros. One pass.
    """
    known = lambda c: F.col(c).isin(*carbon)
    wooded = lambda c: F.count_if(F.col(c).isin(*forest))
    dense = lambda c: F.avg(F.when(known(c), B.class_value(F.col(c), carbon)))
    real = lambda c: F.when(F.col(c) != 0, F.col(c))
    g = cells.groupBy(zone).agg(
        wooded(before).alias("__f1"), wooded(after).alias("__f2"), F.count(before).alias("__n1"), F.count(after).alias("__n2"),
        dense(before).alias("__c1"), dense(after).alias("__c2"), F.avg(real(cover)).alias("tree_cover"), F.avg(real(loss)).alias("loss_mean"), F.avg((F.col(loss) > 0).cast("int")).alias("loss_share"))
    p1, p2 = F.try_divide(F.col("__f1") * 100.0, F.col("__n1")), F.try_divide(F.col("__f2") * 100.0, F.col("__n2"))
    return g.select(
        zone, p1.alias("forest_pct_before"), p2.alias("forest_pct_after"), F.when(p1 > 0, F.try_divide(p1 - p2, p1) * 100).alias("loss_rate_pct"),
        ((F.col("__f2") - F.col("__f1")) * cell_ha).alias("net_forest_ha"), (F.col("__c2") - F.col("__c1")).alias("carbon_change"), "tree_cover", "loss_mean", "loss_share")


def importance_matrix(importance: DataFrame, runs: Sequence[str]) -> DataFrame:
    """importance(run, feature, importance) as a column for each run, 0 where a run lacks a feature, by falling mean."""
    wide = importance.groupBy("feature").pivot("run", list(runs)).agg(F.sum("importance")).fillna(0.0, list(runs))
    mean = sum((F.col(f"`{r}`") for r in runs[1:]), F.col(f"`{runs[0]}`")) / len(runs)
    return wide.withColumn("mean", mean).orderBy(F.desc("mean"), "feature")


def top_features(importance: DataFrame, n: int = 5) -> DataFrame:
    """The n most important features of each run."""
    w = Window.partitionBy("run").orderBy(F.desc("importance"), "feature")
    return importance.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def range_pct(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(largest - least) / least in percent; null where the least is 0."""
    return df.groupBy(*by).agg((F.try_divide(F.max(value) - F.min(value), F.min(value)) * 100).alias("range_pct"))


def approximate_ci(areas: DataFrame, by: Sequence[str], shares: Mapping[int, float] = AREA_CI) -> DataFrame:
    """By period: the area of the classes that have a share, with half the width of its interval, errors being independent."""
    half = F.col("area") * B.class_value(F.col("class_id"), shares)
    d = areas.filter(F.col("class_id").isin(*shares))
    return d.groupBy(*by).agg(F.sum("area").alias("area"), F.sqrt(F.sum(half * half)).alias("half_width"))


def carbon_ci(carbon: Column, error: float = CARBON_ERROR) -> Column:
    """Half the width of the 95 percent interval of a carbon stock, by its default error."""
    return carbon * error * 1.96


def enhanced_carbon(biomass: Column, above: Column, *others: Column) -> Column:
    """Carbon density with the part above ground from biomass where there is any, else from the pool."""
    total = F.coalesce(B.scaled(biomass, "biomass_c"), above)
    for c in others:
        total = total + c
    return total


def class_area_table(areas: DataFrame, periods: Sequence[str], names: Mapping[int, str] = CLASSES) -> DataFrame:
    """areas(period, class_id, area): a row for each class with its area in each period, net change and percent."""
    every = areas.sparkSession.createDataFrame(list(names.items()), "class_id int, class string")
    wide = areas.groupBy("class_id").pivot("period", list(periods)).agg(F.sum("area"))
    d = every.join(wide, "class_id", "left").fillna(0.0, list(periods))
    first, last = F.col(f"`{periods[0]}`"), F.col(f"`{periods[-1]}`")
    return d.withColumn("net_change", last - first).withColumn("change_pct", B.guarded_percent(last - first, first))


def change_rate_table(rates: DataFrame, names: Mapping[int, str] = CLASSES) -> DataFrame:
    """Rows of change tables for classes that either date has, with their names."""
    d = rates.filter((F.col("area_t1") > 0) | (F.col("area_t2") > 0))
    return d.withColumn("class", B.class_name(F.col("class_id"), names))


def accuracy_table(matrix: DataFrame, period: str, counts: DataFrame) -> DataFrame:
    """By period: rows of training and validation, overall accuracy in percent, quantity and allocation disagreement."""
    from .accuracy import disagreement, overall

    oa = overall(matrix, [period]).select(period, (F.col("overall_accuracy") * 100).alias("oa_pct"), "kappa")
    return counts.join(oa, period).join(disagreement(matrix, by=[period]).select(period, "qd", "ad"), period)


def services_table(cells: DataFrame, period: str, carbon: Column, area: str, water: Column, base: Column, quality: Column) -> DataFrame:
    """By period: carbon in Tg, mean water yield, baseflow and habitat quality with its deviation."""
    return cells.groupBy(period).agg((F.sum(carbon * F.col(area)) / 1e6).alias("carbon_tg"), F.avg(water).alias("water_yield"), F.avg(base).alias("baseflow"), F.avg(quality).alias("quality"), F.stddev_pop(quality).alias("quality_std"))


def regression_table(global_fit: DataFrame, local: DataFrame) -> DataFrame:
    """Terms other than the intercept: global coefficient, t, significance, and the summary of local ones."""
    g = global_fit.filter("term <> 'intercept'").select("term", F.col("coefficient").alias("ols"), "t", F.when(F.abs("t") > 1.96, "Yes").otherwise("No").alias("significant"))
    return g.join(local, "term")


def projection_table(projected: DataFrame, by: Sequence[str], names: Mapping[int, str] = CLASSES) -> DataFrame:
    """A row for each scenario and year with each class's share in percent."""
    total = F.sum("area").over(Window.partitionBy(*by))
    d = projected.withColumn("pct", B.guarded_percent(F.col("area"), total)).withColumn("class", B.class_name(F.col("class_id"), names))
    return d.groupBy(*by).pivot("class", list(names.values())).agg(F.sum("pct")).fillna(0.0, list(names.values()))


def driver_sample(layers: Mapping[str, DataFrame], key: Sequence[str], n: int, order: Column, required: Sequence[str] | None = None) -> DataFrame:
    """Layers joined by cell, rows with every required value, the first n by a draw."""
    out: DataFrame | None = None
    for d in layers.values():
        out = d if out is None else out.join(d, list(key))
    out = out.dropna(subset=list(required or [c for c in out.columns if c not in key]))
    return out.withColumn("__draw", order).orderBy("__draw", *key).limit(n).drop("__draw")


def enough(df: DataFrame, n: int) -> bool:
    """Whether there are more than n rows: reads no more than that."""
    return len(df.limit(n + 1).take(n + 1)) > n

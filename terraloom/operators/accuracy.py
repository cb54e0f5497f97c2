"""Confusion matrices and what follows from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, ref: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(ref).isNotNull() & F.col(pred).isNotNull()).groupBy(*by, F.col(ref).alias("ref"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def overall(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Overall accuracy and kappa: two marginals, then one row (a row for each value of `by`)."""
    keys = [*by] or ["__all"]
    matrix = matrix if by else matrix.withColumn("__all", F.lit(1))
    rows = matrix.groupBy(*keys, F.col("ref").alias("k")).agg(F.sum("n").alias("r"))
    cols = matrix.groupBy(*keys, F.col("pred").alias("k")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, [*keys, "k"]).groupBy(*keys).agg(F.sum(F.col("r").cast("double") * F.col("c")).alias("e"))
    got = matrix.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("ref") == F.col("pred"), F.col("n")).otherwise(0)).alias("hit"))
    po, pe = F.try_divide("hit", "n"), F.coalesce("e", F.lit(0.0)) / (F.col("n").cast("double") * F.col("n"))
    return got.join(chance, keys, "left").select(*by, "n", po.alias("overall_accuracy"), F.try_divide(po - pe, 1 - pe).alias("kappa"))


def by_class(matrix: DataFrame) -> DataFrame:
    """Producer's and user's accuracy and F1 by class, zero where undefined."""
    rows = matrix.groupBy(F.col("ref").alias("class_id")).agg(F.sum("n").alias("r"))
    cols = matrix.groupBy(F.col("pred").alias("class_id")).agg(F.sum("n").alias("c"))
    hit = matrix.filter("ref = pred").select(F.col("ref").alias("class_id"), F.col("n").alias("h"))
    d = rows.join(cols, "class_id", "full").join(hit, "class_id", "left").fillna(0, ["r", "c", "h"])
    p, u = F.coalesce(F.try_divide("h", "r"), F.lit(0.0)), F.coalesce(F.try_divide("h", "c"), F.lit(0.0))
    return d.select("class_id", p.alias("producers"), u.alias("users"), F.coalesce(F.try_divide(2 * p * u, p + u), F.lit(0.0)).alias("f1"))


def strata(matrix: DataFrame, mapped: Sequence[int], merged: Mapping[int, int], by: Sequence[str] = ()) -> DataFrame:
    """The matrix of the mapped strata: reference classes are merged as told, other ones that aren't strata are dropped."""
    ref: Column = F.col("ref")
    for old, new in merged.items():
        ref = F.when(F.col("ref") == old, F.lit(new)).otherwise(ref)
    d = matrix.withColumn("ref", ref).filter(F.col("pred").isin(*mapped) & F.col("ref").isin(*mapped))
    return d.groupBy(*by, "ref", "pred").agg(F.sum("n").alias("n"))


def _weighed(matrix: DataFrame, mapped: DataFrame, by: Sequence[str]) -> DataFrame:
    """matrix(ref, pred, n) with the stratum's sample n_i, the row share p, the map's share w and its area in all."""
    total = F.sum("area").over(Window.partitionBy(*by))  # a row for each class
    w = mapped.select(*by, F.col("class_id").alias("pred"), F.try_divide("area", total).alias("w"), total.alias("a"))
    ni = F.sum("n").over(Window.partitionBy(*by, "pred"))
    return matrix.withColumn("ni", ni).withColumn("p", F.try_divide("n", "ni")).join(w, [*by, "pred"])


def _variance() -> Column:
    return F.when(F.col("ni") > 1, F.col("w") ** 2 * F.try_divide(F.col("p") * (1 - F.col("p")), F.col("ni") - 1)).otherwise(0.0)


def olofsson(matrix: DataFrame, mapped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area estimates from a sample stratified by the map: matrix(ref, pred, n), mapped(class_id, area), both with `by`.

    For each class: adjusted area with error and 95 percent limits, user's and producer's accuracy with errors. A class of the
    map that the reference lacks has area zero; accuracies are zero where undefined.
    """
    m = _weighed(matrix, mapped, by)
    area = m.groupBy(*by, F.col("ref").alias("class_id")).agg(F.sum(F.col("w") * F.col("p")).alias("share"), F.sqrt(F.sum(_variance())).alias("share_se"), F.first("a").alias("a"))
    own = m.filter("ref = pred").select(*by, F.col("ref").alias("class_id"), "p", "w", "ni")
    every = area.select(*by, "class_id").unionByName(m.select(*by, F.col("pred").alias("class_id"))).distinct()
    d = every.join(area, [*by, "class_id"], "left").join(own, [*by, "class_id"], "left").fillna(0.0, ["share", "share_se", "p", "w"])
    total = F.coalesce("a", F.lit(0.0))
    adjusted, se = F.col("share") * total, F.col("share_se") * total
    users_se = F.when(F.col("ni") > 1, F.sqrt(F.try_divide(F.col("p") * (1 - F.col("p")), F.col("ni") - 1))).otherwise(0.0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return d.select(
        *by, "class_id", adjusted.alias("adjusted_area"), se.alias("area_se"), (adjusted - 1.96 * se).alias("ci_low"), (adjusted + 1.96 * se).alias("ci_high"),
        F.col("p").alias("users"), users_se.alias("users_se"),
        zero(F.try_divide(F.col("w") * F.col("p"), F.col("share"))).alias("producers"), zero(F.try_divide("share_se", "share")).alias("producers_se"))


def olofsson_overall(matrix: DataFrame, mapped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Overall accuracy weighed by the map, with its error and 95 percent limits."""
    own = _weighed(matrix, mapped, by).filter("ref = pred")
    g = own.groupBy(*by).agg(F.coalesce(F.sum(F.col("w") * F.col("p")), F.lit(0.0)).alias("oa"), F.coalesce(F.sqrt(F.sum(_variance())), F.lit(0.0)).alias("oa_se"))
    return g.withColumn("ci_low", F.col("oa") - 1.96 * F.col("oa_se")).withColumn("ci_high", F.col("oa") + 1.96 * F.col("oa_se"))


def disagreement(matrix: DataFrame, mapped: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Quantity and allocation disagreement. With mapped(class_id, area) rows weigh by the map's area, else by the sample."""
    if mapped is None:
        p = matrix.withColumn("p", F.try_divide("n", F.sum("n").over(Window.partitionBy(*by))))  # a row for each cell of the matrix
    else:
        p = _weighed(matrix, mapped, by).withColumn("p", F.col("w") * F.col("p"))
    keys = [*by, "k"]
    r = p.groupBy(*by, F.col("ref").alias("k")).agg(F.sum("p").alias("r"))
    c = p.groupBy(*by, F.col("pred").alias("k")).agg(F.sum("p").alias("c"))
    d = p.filter("ref = pred").select(*by, F.col("ref").alias("k"), F.col("p").alias("h"))
    j = r.join(c, keys, "full").join(d, keys, "left").fillna(0.0, ["r", "c", "h"])
    g = j.groupBy(*by).agg((F.sum(F.abs(F.col("r") - F.col("c"))) / 2).alias("qd"), F.sum(F.least(F.col("r") - F.col("h"), F.col("c") - F.col("h"))).alias("ad"))
    return g.withColumn("agreement", 1 - F.col("qd") - F.col("ad"))


def figure_of_merit(cells: DataFrame, simulated: str, observed: str, baseline: str) -> DataFrame:
    """A simulated map against the observed one: accuracy, kappa, and hits among changed cells. Classes of 0 or less are no data."""
    s, o, b = F.col(simulated), F.col(observed), F.col(baseline)
    d = cells.filter((s > 0) & (o > 0))
    matrix = confusion(d, observed, simulated)
    said, real = s != b, o != b
    one = d.agg(F.count_if((s == o) & (said | real)).alias("hits"), F.count_if((s != o) & real).alias("misses"), F.count_if((s != o) & said).alias("false_alarms"))
    fom = F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses") + F.col("false_alarms")), F.lit(0.0))
    return overall(matrix).join(F.broadcast(one)).select("n", "overall_accuracy", "kappa", "hits", "misses", "false_alarms", fom.alias("figure_of_merit"))  # one row each

"""Declarative rules: each is one expression over one table. Unique keys."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept

Rule = tuple[str, str, Column]


def check(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rules: (name, severity, aggregate condition). A row a rule: rule, severity, passed, status; one pass over df."""
    one = df.agg(*(F.coalesce(c, F.lit(False)).alias(f"r{k}") for k, (_, _, c) in enumerate(rules)))
    parts = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.col(f"r{k}").alias("passed")) for k, (n, s, _) in enumerate(rules)))
    return one.select(F.inline(parts)).withColumn("status", F.when(F.col("passed"), F.lit("PASS")).otherwise(F.col("severity")))


def summary(checked: DataFrame) -> DataFrame:
    """Rules by status."""
    return checked.groupBy("status").agg(F.count("*").alias("n"))


def accuracy_rules() -> list[Rule]:
    """Over rows (period, overall_accuracy, kappa, n_training, n_validation)."""
    return [
        ("overall accuracy in (0, 1]", "ERROR", (F.min("overall_accuracy") > 0) & (F.max("overall_accuracy") <= 1)),
        ("kappa in [-1, 1]", "ERROR", (F.min("kappa") >= -1) & (F.max("kappa") <= 1)),
        ("training rows", "ERROR", F.min("n_training") > 0),
        ("validation rows", "ERROR", F.min("n_validation") > 0),
    ]


def area_rules(classes: int = 8, low: float = 800_000.0, high: float = 1_500_000.0, drift: float = 20.0) -> list[Rule]:
    """Over rows (period, classes, least_area, dense, total): areas of the periods."""
    return [
        ("no negative area", "ERROR", F.min("least_area") >= 0),
        ("every class", "WARNING", (F.min("classes") == classes) & (F.max("classes") == classes)),
        ("dense forest", "ERROR", F.min("dense") > 0),
        ("total area is reasonable", "WARNING", (F.min("total") > low) & (F.max("total") < high)),
        ("periods have like areas", "WARNING", F.try_divide(F.max("total") - F.min("total"), F.min("total")) * 100 < drift),
    ]


def matrix_rules(tolerance: float = 0.01) -> list[Rule]:
    """Over rows (c_from, total): sums of a transition matrix's rows."""
    return [("rows sum to one", "ERROR", F.max(F.abs(F.col("total") - 1)) < tolerance)]


def share_rules(tolerance: float = 1.0) -> list[Rule]:
    """Over rows (group, total): sums of percents."""
    return [("percents sum to 100", "ERROR", F.max(F.abs(F.col("total") - 100)) < tolerance)]


def model_rules(vif: float = 10.0) -> list[Rule]:
    """Over one row (vif, ols_r2, gwr_r2, ols_aic, gwr_aic) or more."""
    return [
        ("variance inflation", "WARNING", F.max("vif") < vif),
        ("R2 of the global fit in [0, 1]", "ERROR", (F.min("ols_r2") >= 0) & (F.max("ols_r2") <= 1)),
        ("local fits explain more", "ERROR", F.min(F.col("gwr_r2") - F.col("ols_r2")) > 0),
        ("local fits have the lesser AIC", "ERROR", F.max(F.col("gwr_aic") - F.col("ols_aic")) < 0),
    ]


def service_rules(water: float = 8000.0) -> list[Rule]:
    """Over rows (period, carbon, water_yield, quality)."""
    return [
        ("carbon", "ERROR", F.min("carbon") > 0),
        ("water yield is reasonable", "ERROR", (F.min("water_yield") > 0) & (F.max("water_yield") < water)),
        ("habitat quality in [0, 1]", "ERROR", (F.min("quality") >= 0) & (F.max("quality") <= 1)),
        ("carbon falls", "ERROR", F.max_by("carbon", "period") < F.min_by("carbon", "period")),
    ]


def reconciled(one: DataFrame, other: DataFrame, on: Sequence[str], values: Mapping[str, tuple[float, str]]) -> DataFrame:
    """Two tables of the same figures: a row for each key and value, with both, their difference and whether it is within tolerance.

    values: column to (tolerance, kind), where kind is 'absolute' or 'percent' of the first table's figure. A key that one
    table lacks fails.
    """
    a, b = (d.select(*on, *(F.col(v).cast("double").alias(f"__{k}{n}") for n, v in enumerate(values))) for k, d in (("a", one), ("b", other)))
    parts = []
    for n, (v, (tolerance, kind)) in enumerate(values.items()):
        x, y = F.col(f"__a{n}"), F.col(f"__b{n}")
        off = F.abs(x - y) if kind == "absolute" else F.try_divide(F.abs(x - y), F.abs(x)) * 100
        parts.append(F.struct(F.lit(v).alias("value"), x.alias("one"), y.alias("other"), off.alias("difference"), F.coalesce(off <= tolerance, F.coalesce(x == y, F.lit(False))).alias("passed")))
    return a.join(b, list(on), "full").select(*on, F.inline(F.array(*parts)))


def first_by_key(df: DataFrame, key: str, order: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """The first row of each key that `known` (of a column of that name) lacks, and every row whose key is blank."""
    blank = F.coalesce(F.trim(F.col(key)), F.lit("")) == ""
    w = Window.partitionBy(key).orderBy(*order)
    keyed = df.filter(~blank)
    if known is not None:
        keyed = keyed.join(known.select(key).distinct(), key, "left_anti").select(*df.columns)
    keyed = keyed.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
    return keyed.unionByName(df.filter(blank))


#: What suffixes may be made of.
_TAIL = "[^\\x00-`]+$"


def letters(n: Column) -> Column:
    """0 is a, 25 is z, 26 is aa, 701 is zz, 702 is aaa, and so on."""
    start = F.struct(n.cast("long").alias("n"), F.lit("").alias("s"))
    step = lambda a, _: F.struct(F.floor(F.try_divide(a["n"], F.lit(26)) - 1).cast("long").alias("n"), F.when(a["n"] >= 0, F.concat(F.char(97 + a["n"] % 26), a["s"])).otherwise(a["s"]).alias("s"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step, lambda a: a["s"])


def two_letters(n: Column) -> Column:
    """As `letters` up to 701; then the first of two runs on past z through the code points, the second goes from a to z."""
    n = n.cast("long")
    first = F.decode(F.unhex(F.lpad(F.hex(F.lit(96) + F.floor(F.try_divide(n, F.lit(26))).cast("long")), 8, "0")), "UTF-32")
    return F.concat(F.when(n >= 26, first).otherwise(F.lit("")), F.char(97 + n % 26))


def suffixed(df: DataFrame, key: str, order: Sequence[str], known: DataFrame | None = None, rounds: int = 20, suffix: Callable[[Column], Column] = letters) -> DataFrame:
    """Makes keys unique, among themselves and against `known`: the first of a key keeps it, the others get a, b, ..., z, aa, ...

    A suffix that makes a key that is taken is passed over. Two keys may make one (k with aa, ka with a): the shorter has it,
    the other is dealt anew; such rounds end when no two rows have one key. `suffix` makes a suffix of a number from 0 on, of
    characters from a on.
    """
    w = Window.partitionBy(key).orderBy(*order)
    d = df.withColumn("__row", F.monotonically_increasing_id())
    if known is not None:
        d = d.join(known.select(F.col(key).alias("__known")).distinct(), F.col(key) == F.col("__known"), "left")
    else:
        d = d.withColumn("__known", F.lit(None).cast("string"))
    d = kept(d.withColumn("__n", F.row_number().over(w) - F.when(F.col("__known").isNull(), 1).otherwise(0)).drop("__known"), "suffixed")
    done = d.filter("__n = 0").select("__row", F.col(key).alias("__key"))
    taken = done.select("__key")
    if known is not None:
        taken = taken.unionByName(known.select(F.col(key).alias("__key")))
    left = d.filter("__n > 0").select("__row", F.col(key).alias("__base"), "__n")
    for _ in range(rounds):
        if left.isEmpty():
            break
        need = left.groupBy("__base").agg(F.count("*").alias("__m"))
        base = F.regexp_replace("__key", _TAIL, "")
        clash = taken.withColumn("__root", base).join(need.select("__base", F.regexp_replace("__base", _TAIL, "").alias("__root")), "__root").groupBy("__base").agg(F.count("*").alias("__c"))
        free = need.join(clash, "__base", "left").withColumn("__j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__m") + F.coalesce("__c", F.lit(0)) - 1)))
        free = free.withColumn("__key", F.concat("__base", suffix(F.col("__j")))).join(taken, "__key", "left_anti")
        free = free.withColumn("__n", F.row_number().over(Window.partitionBy("__base").orderBy("__j"))).select("__base", "__n", "__key")
        rank = F.row_number().over(Window.partitionBy("__base").orderBy("__n"))
        got = left.withColumn("__n", rank).join(free, ["__base", "__n"])
        first = F.row_number().over(Window.partitionBy("__key").orderBy(F.length("__base"), "__row"))
        got = kept(got.withColumn("__f", first), "suffixed")
        new = got.filter("__f = 1").select("__row", "__key")
        done, taken = done.unionByName(new), taken.unionByName(new.select("__key"))
        left = kept(left.join(new.select("__row"), "__row", "left_anti"), "suffixed")
    else:
        raise RuntimeError("keys did not settle")
    return d.join(done, "__row").withColumn(key, F.col("__key")).select(*df.columns)

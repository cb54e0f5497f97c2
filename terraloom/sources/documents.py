"""Sources and sinks beyond Spark's own readers: nested JSON results, CSV with odd headers, BibTeX, optional inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_document(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """A CSV whose headers may have a byte order mark, blanks and capitals; every column is a string."""
    d = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return d.toDF(*(c.replace("﻿", "").strip().lower() for c in d.columns))


def bibtex_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys and lower-case DOIs of a BibTeX file: kind ('key' or 'doi'), value."""
    t = spark.read.text(path, wholetext=True)
    keys = t.select(F.lit("key").alias("kind"), F.explode(F.regexp_extract_all("value", F.lit(r"@\w+\{\s*([^,\s]+)\s*,"))).alias("value"))
    dois = t.select(F.lit("doi").alias("kind"), F.explode(F.transform(F.regexp_extract_all("value", F.lit(r"(?i)doi\s*=\s*\{([^}]*)\}")), F.lower)).alias("value"))
    return keys.unionByName(dois).distinct()


def scenes(df: DataFrame, start: str, stop: str, cloud: float | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Scenes from start to before stop, below a cloud share, whose point lies in a box. All of it reaches the scan."""
    d = df.filter((F.col("ts") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ts") < F.lit(stop).cast("timestamp_ntz")))
    if cloud is not None:
        d = d.filter(F.col("cloud_pct") < cloud)
    if box is not None:
        d = d.filter(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3]))
    return d


def optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet input that may be missing: then an empty table of its schema."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def with_fallback(df: DataFrame, other: DataFrame, on: str, value: str, constant: float) -> DataFrame:
    """value of `other` by key where it has one, else a constant."""
    return df.join(other.select(on, F.col(value).alias("__v")), on, "left").withColumn(value, F.coalesce("__v", F.lit(constant))).drop("__v")


def write_report(df: DataFrame, path: str, form: str = "parquet") -> None:
    """parquet, json or csv (with a header)."""
    w = df.write.mode("overwrite")
    {"parquet": w.parquet, "json": w.json, "csv": w.option("header", True).csv}[form](path)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files, a row each: path and value."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def occurrences(texts: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """By file, how often each pattern occurs."""
    parts = F.array(*(F.struct(F.lit(k).alias("pattern"), F.regexp_count("value", F.lit(p)).alias("n")) for k, p in patterns.items()))
    return texts.select("path", F.inline(parts))


def image(spark: SparkSession, path: str, bands: Sequence[str]) -> DataFrame:
    """A static raster kept as Parquet cells: row, col and the bands; other columns aren't read."""
    return spark.read.parquet(path).select("row", "col", *bands)


def feature_collection(spark: SparkSession, path: str, columns: Sequence[str], **equal: object) -> DataFrame:
    """Features kept as Parquet, by the values of some columns (one value, or a list of them), which reach the scan."""
    d = spark.read.parquet(path)
    for c, v in equal.items():
        d = d.filter(F.col(c).isin(*v) if isinstance(v, (list, tuple)) else F.col(c) == v)
    return d.select(*columns)


def with_properties(df: DataFrame, **values: object) -> DataFrame:
    """df with constant columns, as a collection's images have properties."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def append_text(df: DataFrame, path: str) -> None:
    """Appends the column `value` to a folder of text files: logs, bibliographies and reports."""
    df.select("value").write.mode("append").text(path)


def report_lines(checked: DataFrame, title: str) -> DataFrame:
    """A report of checked rules in Markdown, a line a row: counts by status, then every rule."""
    head = checked.sparkSession.createDataFrame([(0, 0, f"# {title}"), (2, 0, "| rule | severity | status |"), (2, 1, "|-|-|-|")], "part int, n int, value string")
    counts = checked.groupBy("status").agg(F.count("*").alias("c")).select(F.lit(1).alias("part"), F.lit(0).alias("n"), F.concat(F.lit("- "), "status", F.lit(": "), F.col("c").cast("string")).alias("value"))
    every = checked.select(F.lit(3).alias("part"), F.lit(0).alias("n"), F.concat(F.lit("| "), "rule", F.lit(" | "), "severity", F.lit(" | "), "status", F.lit(" |")).alias("value"))
    return head.unionByName(counts).unionByName(every).orderBy("part", "n", "value").select("value")

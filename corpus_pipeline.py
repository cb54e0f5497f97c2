"""Cleans and packs the documents: language, exact copies, near copies, sequences.

All but the last stage return rows of their input as they are. None needs ids that are unique or set: the first decides row
by row, the others number the rows they read.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm import exact_dedup, jaccard_join, langid, packing
from terraloom.llm.common import dropped, fresh_path, numbered, tidied


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose best two languages compress them alike.

    Null and empty texts go; rows of one text all stay or all go; a null id is an id. No labelled rows: nothing is
    recognised, so nothing stays. Empty table: no rows.
    """
    return langid.accepted(docs, langid.train(docs.filter(~langid.held_out())))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays; nulls come last, and of ties (repeated rows) one stays.

    Null and empty texts are equal. A repeated id may keep several texts. Empty table: no rows.
    """
    return exact_dedup.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of their 5-word shingles (0.8 or more of the union in common) join, that with the smallest id stays.

    Nulls come last; of ties (one id, linked texts) one stays. Null, empty and blank texts are linked with nothing and stay.
    Empty table: no rows.
    """
    every = numbered(docs, "near-numbered")
    found = jaccard_join.jaccard_components(every, shingle=5, hundredths=80, prefixes=True, row_col="__row")
    least = found.filter(F.col("root").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row").alias("__row"))
    stay = least.select("__row").unionByName(found.filter("root IS NULL").select(F.col("row").alias("__row")))
    return every.join(stay, "__row", "left_semi").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens: a row for each piece of a document.

    Null and empty texts are the end token alone; repeated rows and null ids are documents of their own. Empty table: no rows.
    """
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("pack", pack)]
#: SQL can't express the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each writes Parquet that the next one reads and that goes when that one is done."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        with tidied(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            dropped(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

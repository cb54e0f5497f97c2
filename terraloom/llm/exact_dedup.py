"""Exact deduplication by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_texts, looked_up, numbered, stored

#: Salts among which the copies of one text are merged before all are combined.
SALTS = 16


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _marked(rows: DataFrame, salts: int) -> DataFrame:
    """rows(doc_id, body, digest and more) with keep_id and group_size, without the body."""
    merged = rows.withColumn("salt", F.spark_partition_id() % salts).groupBy("salt", "digest", "body").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    contents = merged.groupBy("digest", "body").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    # the number of a digest's contents is known only after all of them were compared; a content is told from the others by its keep_id
    groups = stored(contents.select("digest", F.xxhash64("body").alias("check"), "keep_id", F.col("n").alias("group_size")), "dedup-groups")
    clashes = not groups.groupBy("digest").count().filter("count > 1").isEmpty()
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    on = ["digest", "check"] if clashes else ["digest"]  # sha256 and xxhash64 together, should sha256 alone ever fail
    ids = rows.withColumn("check", F.xxhash64("body")).drop("body") if clashes else rows.drop("body")
    return looked_up(ids, groups.select(*on, "keep_id", "group_size"), on, "group_size", total)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normal forms are, byte by byte. Three combining steps, each of which groups by the digest
    and the whole content: within a task (Spark's partial aggregate, one row a text and task), among the tasks of a salt,
    and among the salts' winners. A hot text thus reaches any task as a few rows. The row that stays has the smallest id.

    Rows then look their group up by digest. If two contents share a digest (none is known), those few rows compare
    contents once more. Digests of hot groups, of which there are at most 1 / HOT_SHARE, are broadcast; the rest are joined.

    Null and empty texts are equal. Rows with one id and one text are one document: all or none are marked as kept (of those
    `kept_documents` returns one); a null id never beats another. Empty table: no rows. Other columns of the input are not
    read.
    """
    rows = keyed_texts(df, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("body"))
    found = _marked(rows.withColumn("digest", F.sha2("body", 256)), salts)
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def kept_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row of df for each text, with all its columns: that with the smallest id (nulls last), of ties one.

    A repeated id keeps a row for each text that no smaller id has. Rows are told apart by a number of their own, so ids need
    be neither unique nor set. Null and empty texts are equal; empty table: no rows.
    """
    every = numbered(df, "dedup-numbered")
    rows = every.select(F.col(id_col).cast("long").alias("doc_id"), F.col("__row").alias("row"), normalised(F.col(text_col).cast("string")).alias("body"))
    found = _marked(rows.withColumn("digest", F.sha2("body", 256)), salts)
    first = found.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", *[c for c in ["check"] if c in found.columns]).agg(F.min("row").alias("__row")).select("__row")
    return every.join(first, "__row", "left_semi").select(*df.columns)


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g USING (body)
"""

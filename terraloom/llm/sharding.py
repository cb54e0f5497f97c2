"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 24
SEED = "terraloom-1"
#: Rows that one task ranks at once; a source's rows are cut into buckets of about this size.
BUCKET_ROWS = 4096
#: Buckets at most; their counts are summed up in one small window.
MOST_BUCKETS = 1 << 16
#: Ranks that a row stands for at once when equal rows are spread.
SPREAD = 1024


def _buckets(rows: int) -> int:
    n = 1
    while n < MOST_BUCKETS and n * BUCKET_ROWS < rows:
        n *= 2
    return n


def stratified_shards(df: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row. Law `rows`: counts at most one apart.

    Rows of a source are shuffled by md5(seed, id, text's checksum) and ranked; rank r of n stands at the fraction (2r-1)/(2n). Sorted by
    this fraction all sources interleave in proportion, and each run of rows has the mixture of the whole; equal cuts
    make the shards.

    No source is ranked in one task: md5 deals a source's rows evenly into buckets, a row's rank is the count of the
    earlier buckets plus its place in its own. The same holds for the order by fraction, whose values are evenly spread.
    Rows with one id and one text, which have one draw, are counted before they are ranked: a group of them is one row on
    the way and is spread over its run of ranks at the end, so not even a source of equal rows fills a task.

    Null sources are one source; a null id counts as empty; a null text has size 8. Rows with one id, source and text are
    interchangeable. Empty table: no rows. Other columns aren't read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("stratum"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.col("size").cast("string")).cast("binary"))
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).withColumn("draw", draw)
    rows = stored(rows, "shard-rows")
    total, groups = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    buckets = _buckets(groups)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * buckets / F.lit(2**32)).cast("long"))
    counts = rows.groupBy("stratum", "bucket").agg(F.sum("n").alias("here"))
    by_stratum = before.partitionBy("stratum")  # at most MOST_BUCKETS rows each
    offsets = counts.select("stratum", "bucket", F.coalesce(F.sum("here").over(by_stratum), F.lit(0)).alias("earlier"), F.sum("here").over(Window.partitionBy("stratum")).alias("in_stratum"))
    place = Window.partitionBy("stratum", "bucket").orderBy("draw", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("rank", F.coalesce(F.sum("n").over(place), F.lit(0))).join(offsets, ["stratum", "bucket"])
    each = F.when(F.col("n") == 1, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(SPREAD))))
    ranked = ranked.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {SPREAD}"))))  # runs of SPREAD ranks
    ranked = ranked.withColumn("n", F.least(F.col("n") - F.col("k") * SPREAD, F.lit(SPREAD))).withColumn("k", F.col("k") * SPREAD).withColumn("each", F.explode(each))
    fraction = (2 * (F.col("earlier") + F.col("rank") + F.col("k") + F.col("each")) - 1).cast("double") / (2 * F.col("in_stratum")).cast("double")
    ranked = ranked.select("doc_id", "stratum", "size", "text_crc32", fraction.alias("fraction"))
    buckets = _buckets(total)
    ranked = stored(ranked.withColumn("bucket", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1)).cast("long")), "shard-ranks")
    cuts = ranked.groupBy("bucket").agg(F.count("*").alias("here")).select("bucket", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("earlier"))  # at most MOST_BUCKETS rows
    place = Window.partitionBy("bucket").orderBy("fraction", "stratum")
    at = F.col("earlier") + F.row_number().over(place) - 1
    dealt = ranked.join(cuts, "bucket").select("doc_id", "size", "text_crc32", at.alias("at"))
    dealt = dealt.withColumn("shard", F.expr(f"cast((at * {shards}) div {max(1, total)} AS int)"))
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"at - ((cast(shard AS long) * {total} + {shards} - 1) div {shards})").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


#: DuckDB has no crc32: a table of 256 entries by the rule, then byte by byte.
_CRC = """list_transform(range(256), lambda x: list_reduce([x::BIGINT] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"""
_BYTES = """list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT)"""

ORACLE_SQL = rf"""
WITH c AS MATERIALIZED (SELECT {_CRC} AS t),
b AS (SELECT DISTINCT coalesce(text, '') AS body FROM documents),
x AS MATERIALIZED (SELECT body, xor(list_reduce([4294967295::BIGINT] || {_BYTES}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32 FROM b, c),
r AS (
  SELECT doc_id, coalesce('=' || source, '') AS stratum, strlen(coalesce(text, '')) + 8 AS size, text_crc32 FROM documents JOIN x ON body = coalesce(text, '')),
d AS (SELECT *, md5('{SEED}:' || coalesce(cast(doc_id AS VARCHAR), '') || ':' || text_crc32 || ':' || size) AS draw FROM r),
k AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY draw, doc_id, text_crc32, size) - 1)::DOUBLE
            / (2 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS fraction FROM d),
p AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum) - 1 AS pos, count(*) OVER () AS total FROM k),
s AS (SELECT *, (pos * {SHARDS}) // total AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
       (pos - ((shard * total + {SHARDS - 1}) // {SHARDS}))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s
"""

"""What the operators of this subpackage share: shared folders, tables, Arrow batches."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

#: Rows of a text table that a Python worker gets at once. Texts average a few KB, so a batch is a few MB.
BATCH_ROWS = 512
#: Bytes at which a batch ends even if it has fewer rows; a single longer text is a batch of its own.
BATCH_BYTES = 32 << 20
#: Folders written since the last `tidied` began.
_written: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only where it is unset (tests on one machine), an own one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="terraloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of the shared folder."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def tidied(spark: SparkSession):
    """Deletes what operators wrote to the shared folder while it was open; their results must have been used up by then."""
    before = len(_written)
    yield
    dropped(spark, *_written[before:])
    del _written[before:]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors, fixes row ids."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds what a Python worker holds of a table with long texts. The package is sent to the workers, too."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A column of strings as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def keyed_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (as long) and the text: columns of the input with any other name can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: A group with more than this share of all rows is hot; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def numbered(df: DataFrame, name: str, column: str = "__row") -> DataFrame:
    """df with a number for each row that stays with it.

    Rows read straight from files are told by file and place, which nothing changes; files are numbered by a broadcast of
    their names, as many as the driver listed. Other rows are numbered and written to the shared folder.
    """
    try:
        rows = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        return stored(df.withColumn(column, F.monotonically_increasing_id()), name)
    files = sorted(r[0] for r in rows.select("__file").distinct().collect())
    if len(files) >= 1 << 22:
        raise ValueError("more than 2**22 files")
    numbers = df.sparkSession.createDataFrame(list(enumerate(files)), "__n long, __file string")
    number = F.shiftleft("__n", 40) + F.col("__at")
    return rows.join(F.broadcast(numbers), "__file").select(*df.columns, number.alias(column))


def looked_up(rows: DataFrame, groups: DataFrame, on: str | Sequence[str], size_col: str, total: int) -> DataFrame:
    """rows with the columns of groups, whose keys are unique; rows without a group are left out. total: rows in all groups.

    Hot groups, at most 1 / HOT_SHARE by their sizes, are broadcast; the others, none of them large, are joined by key.
    """
    keys = [on] if isinstance(on, str) else list(on)
    hot = F.col(size_col) > max(1.0, total * HOT_SHARE)
    others = [c for c in groups.columns if c not in keys]
    marked = rows.join(F.broadcast(groups.filter(hot).withColumnsRenamed({c: f"__{c}" for c in others})), keys, "left")
    is_hot = F.col(f"__{size_col}").isNotNull()
    found = marked.filter(is_hot).select(*rows.columns, *(F.col(f"__{c}").alias(c) for c in others))
    rest = marked.filter(~is_hot).select(*rows.columns).join(groups.filter(~hot), keys).select(*rows.columns, *others)
    return found.unionByName(rest)

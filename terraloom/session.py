"""Sessions, and the package's way to the Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent


def ship_package(spark: SparkSession) -> None:
    """Python workers import this package: sends it to them once a session, unless their path names its place already."""
    if str(_ROOT.parent) in map(os.path.abspath, filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))):
        return
    sc = spark.sparkContext
    if getattr(sc, "_terraloom_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="terraloom-"), "terraloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    sc.addPyFile(path)
    sc._terraloom_shipped = True


def session(master: str | None = None, partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster, submit's own settings hold."""
    b = SparkSession.builder.appName("terraloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    b = b.config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true")
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder where the cluster names one in spark.checkpoint.dir; where it is unset, as in tests, in an own one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:  # one machine, as in tests
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="terraloom-"))
        folder = sc._jsc.sc().getCheckpointDir().get()
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

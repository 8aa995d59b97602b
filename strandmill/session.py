"""Session defaults and the shared folder for tables that cut a lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_OWN: dict[str, str] = {}


def build_session(app: str = "strandmill", cores: int | str = "*", shuffle: int | None = None) -> SparkSession:
    """A local session with the settings the operators expect; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("STRANDMILL_DRIVER_MEMORY", "8g"))
    )
    if shuffle:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``, or one of our own where that is unset and all runs on this machine (tests).

    On a cluster an unset folder is refused, as each executor would write to its own disk.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir is not set; on {master} intermediate tables need a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="strandmill-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return f"file://{_OWN[app]}"


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, deleted at the end of the process at the latest."""
    path = f"{shared_dir(spark)}/strandmill-{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def settle(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back: the lineage ends there, a lost executor costs nothing."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


class Levels:
    """Tables of one kind, one for each level of a search, under one folder: written level by level, read alone or all at once.

    Reading all of them is one scan of one folder, so that no plan grows with the number of levels.
    """

    def __init__(self, spark: SparkSession, name: str, column: str = "dist"):
        self.spark, self.path, self.column = spark, folder(spark, name), column

    def write(self, level: int, df: DataFrame) -> DataFrame:
        self.schema = df.schema
        df.write.mode("overwrite").parquet(f"{self.path}/{self.column}={level}")
        return self.read(level)

    def read(self, level: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{self.column}={level}")

    def all(self) -> DataFrame:
        whole = T.StructType([*self.schema.fields, T.StructField(self.column, T.IntegerType())])
        out = self.spark.read.schema(whole).parquet(self.path)
        out._settled_at = self.path
        return out


def forget(df: DataFrame) -> None:
    """Delete the files of a settled table that is no longer needed; any other table is left alone."""
    if path := getattr(df, "_settled_at", None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone, and with it the need to tidy up
        pass

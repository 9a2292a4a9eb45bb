"""Tables that a plan writes for itself: they cut lineage, outlive lost executors, and give repeated scans something small."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared(spark: SparkSession) -> str:
    """spark.checkpoint.dir; in plain local mode, where it may be unset, a temporary folder."""
    for conf in (spark.conf, spark.sparkContext.getConf()):
        where = conf.get("spark.checkpoint.dir", None)
        if where:
            return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or "cluster" in master:
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    where = f"file://{tempfile.mkdtemp(prefix='lodestar-')}"
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one; it goes with the JVM."""
    where = f"{shared(spark)}/{name}-{uuid.uuid4().hex}"
    _path(spark, where, lambda fs, p: fs.deleteOnExit(p))
    return where


def keep(df: DataFrame, name: str = "rows") -> DataFrame:
    """The frame, written and read back. The files go with the JVM, or by `drop`."""
    spark = df.sparkSession
    where = new_folder(spark, name)
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out._kept = where
    return out


def drop(*frames: DataFrame | None) -> None:
    """Deletes the files of frames that `keep` made and nothing reads any more."""
    for df in frames:
        if df is not None and getattr(df, "_kept", None):
            _path(df.sparkSession, df._kept, lambda fs, p: fs.delete(p, True))


def _path(spark: SparkSession, where: str, act) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    act(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p)

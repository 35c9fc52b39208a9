"""Tables written to the cluster's shared folder and read back: later plans start from files, whichever executors are lost."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a private one only where none is named and driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the table goes when the driver ends, or by ``discard``."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, system = _path(spark, path)
    system.deleteOnExit(at)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_path = path
    return kept


def discard(kept: DataFrame) -> None:
    """Delete a kept table that nothing later reads."""
    at, system = _path(kept.sparkSession, kept._kept_path)
    system.delete(at, True)

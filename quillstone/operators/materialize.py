"""Cutting lineage: tables written to the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", found)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back. The files go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstone-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(kept: DataFrame) -> None:
    """Deletes the files of a materialized table that no plan needs any more."""
    at = kept.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(kept._kept_at)
    at.getFileSystem(kept.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

"""Tables written once into the folder that the whole cluster shares, and small helpers used by several operators."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000  # rows that a Python worker holds at once
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one where that is unset on one machine, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set("spark.checkpoint.dir", found)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/quillstone-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at.getParent())
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(BATCH_ROWS, None)
    spark.conf.set(BATCH_ROWS, str(ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(BATCH_ROWS) if before is None else spark.conf.set(BATCH_ROWS, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM collects the plans that wrote them; this asks for it now, after a large step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(kept: DataFrame) -> None:
    """Deletes the files of a kept table that no plan needs any more."""
    at = kept.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(kept._kept_at).getParent()
    at.getFileSystem(kept.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes the empty text. Pure ASCII texts take the fast path of lower()."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def worker_state(owner: str) -> dict:
    """A dict that lives as long as the Python worker process: caches in it outlast a task. It holds one owner's things at a time, so a
    worker that has served several operators keeps the memory of the last one only."""
    import sys
    import types

    state = sys.modules.setdefault("quillstone_worker_state", types.ModuleType("quillstone_worker_state")).__dict__
    if state.get("owner") != owner:
        state["owner"], state["held"] = owner, {}
        return_memory()
    return state["held"]


def return_memory() -> None:
    """Gives freed memory of this Python process back to the system."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass

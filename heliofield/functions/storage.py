"""Shared-folder tables that cut lineage: every executor can read them, and each is computed once."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex
_known: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A folder of this run in ``spark.checkpoint.dir``; a temporary one only where that is unset and driver and tasks are one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="heliofield-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/heliofield-{_RUN}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already at exit
        pass


def release(spark: SparkSession) -> None:
    """Delete this run's saved tables. Results that were made of them and not yet written are lost, so call it after a query's last action."""
    root = shared_dir(spark)
    if root in _known:
        _remove(spark, root)


def save(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: survives lost executors, is computed once."""
    spark = df.sparkSession
    root = shared_dir(spark)
    if root not in _known:
        _known.add(root)
        atexit.register(_remove, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

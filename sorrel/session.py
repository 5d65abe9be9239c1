"""Session helpers: shared checkpoint folder, scratch tables, input spreading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder of its own.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if current:
        return configured or current
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="spark-")
    sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder, for tables a job writes and reads back."""
    return f"{shared_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, owned: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Later stages neither recompute the input nor see it differently, a lost executor costs
    nothing that was written, and column pruning still works on what is read back. The path is
    added to ``owned``, for ``drop_tables`` once nothing reads the table any more.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    if owned is not None:
        owned.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, owned: list[str]) -> None:
    """Remove tables that ``cut`` has written and that only finished steps have read."""
    while owned:
        p = spark._jvm.org.apache.hadoop.fs.Path(owned.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table folder is there, on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def widen(df: DataFrame) -> DataFrame:
    """Spread an input of few splits before costly expressions; larger inputs pass through."""
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted)

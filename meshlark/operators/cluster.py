"""Where intermediate tables go on a cluster, and how lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    It is `spark.checkpoint.dir` of the session. Only where that is unset (a
    local session, as in tests) a folder of this machine is chosen; on a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "meshlark-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it is removed when the session ends."""
    path = f"{shared_dir(spark)}/meshlark/{tag}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, tag: str, counted: bool = False) -> DataFrame:
    """Write `df` to the shared folder and read it again.

    Lineage ends there: an executor that is lost later costs a re-read of a
    file, not a recomputation, and what was decided once stays decided. counted:
    the write counts the rows on its way, for `is_empty`.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    seen = Observation() if counted else None
    (df.observe(seen, F.count(F.lit(1)).alias("n")) if counted else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._meshlark_path = path
    if counted:
        out._meshlark_rows = seen.get["n"]
    return out


def bucketed(df: DataFrame, tag: str, key: str, grouped: bool = False, rows: int | None = None) -> DataFrame:
    """As `materialize`, in as many buckets by `key` as shuffles have partitions: a join or grouping on it does not shuffle these rows again.

    grouped: the rows of a key lie in one task already, so they are written where they are.
    rows: of a Parquet row group; where a row is large, writers and readers hold no more of them at a time.
    """
    spark = df.sparkSession
    path, parts = scratch_path(spark, tag), int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"meshlark_{uuid.uuid4().hex}"
    writer = (df if grouped else df.repartition(parts, key)).write.format("parquet").option("path", path)
    (writer.option("parquet.block.row.count.limit", rows) if rows else writer).bucketBy(parts, key).saveAsTable(name)
    out = spark.table(name)
    out._meshlark_path = path
    return out


def is_empty(df: DataFrame) -> bool:
    """Whether there is no row; known without a job for what was counted when written."""
    rows = getattr(df, "_meshlark_rows", None)
    return df.isEmpty() if rows is None else rows == 0


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def discard(df: DataFrame) -> None:
    """Remove what `materialize` wrote for `df`, once nothing reads it."""
    path = getattr(df, "_meshlark_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)

"""Intermediate tables in the folder that the cluster shares, named by spark.checkpoint.dir."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def delete_at_end(spark: SparkSession, path: str) -> str:
    """Removes path when the driver's JVM ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def delete_now(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shared_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.  Only a local session may fall back to a folder of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = delete_at_end(spark, "file://" + tempfile.mkdtemp(prefix="symloom-"))
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def path_for(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    return delete_at_end(spark, f"{shared_folder(spark)}/symloom/{tag}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df and reads it again: cuts the lineage, and lost executors cost single tasks."""
    path = path_for(df.sparkSession, tag)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written.scratch_path = path
    return written


def materialize_parts(parts: list[DataFrame], tag: str) -> DataFrame:
    """Writes parts with the same columns one after the other into one table and reads it.  What a part shuffled goes before the next one
    begins, so the disk holds the shuffles of one part at a time."""
    spark = parts[0].sparkSession
    path = path_for(spark, tag)
    for df in parts:
        df.write.mode("append").option("compression", "zstd").parquet(path)
        release(spark)
    written = spark.read.schema(parts[0].schema).parquet(path)
    written.scratch_path = path
    return written


def release(spark: SparkSession) -> None:
    """Spark removes shuffle files when the driver collects their plans as garbage; now, not when its memory runs short.  Its scheduler holds
    the last job until another one comes, so a job of one row goes before; Python holds frames in cycles."""
    gc.collect()
    spark.range(1, numPartitions=1).collect()
    spark.sparkContext._jvm.System.gc()


def alive(table: DataFrame) -> bool:
    """Whether what materialize wrote is still there."""
    spark, path = table.sparkSession, getattr(table, "scratch_path", None)
    if path is None:
        return True
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def forget(*tables: DataFrame | None) -> None:
    """Removes what materialize wrote, where nothing reads it any more: loops keep two rounds, not all of them."""
    for t in tables:
        if path := getattr(t, "scratch_path", None):
            delete_now(t.sparkSession, path)

"""Steps that are written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may leave it unset; it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: steps need a folder that the driver and all executors share")
    held = getattr(spark.sparkContext, "_voxquarry_shared", None)
    if held is None:
        held = "file://" + tempfile.mkdtemp(prefix="voxquarry-")
        spark.sparkContext._voxquarry_shared = held
    return held


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write a step as Parquet in the shared folder and reread it: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, what)
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._voxquarry_path = path
    return out

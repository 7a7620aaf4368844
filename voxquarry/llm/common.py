"""Shared pieces: tables, the shared folder, materialised steps and bounded driver-side state."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxquarry.scratch import materialise, shared_path, shared_root

__all__ = ["materialise", "shared_path", "shared_root"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delete(*steps: DataFrame) -> None:
    """Delete the files of materialised steps."""
    for df in steps:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._voxquarry_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*steps: DataFrame) -> None:
    """Delete materialised steps that no later plan reads: all that was made of them is materialised itself."""
    delete(*steps)
    release(steps[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def renamed(df: DataFrame, *own: str) -> tuple[DataFrame, dict[str, str]]:
    """df with every column but `own` under a name that no step uses, and by name what each column is called there."""
    names = {c: c if c.lower() in own else f"in{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def crc_mod(column, modulus: int):
    """crc32 of an id written as text, modulo `modulus` (null id: null)."""
    return F.crc32(column.cast("string")) % modulus


#: Characters that separate words and are stripped from line keys: space and \t \n \v \f \r.
SPACE = "\\x20\\x09-\\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


#: Bytes of Parquet up to which a step is broadcast.
SMALL_BYTES = 4 << 20


def small(step: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """A materialised step, marked for broadcast if its files have `most` bytes at most; beyond that Spark plans the join as usual."""
    spark = step.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(step._voxquarry_path)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(step) if size <= most else step

"""Plain text sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxquarry.functions.text import base_name, stem_last_dot, strip_bom
from voxquarry.operators.relational import running


def read_lines(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, value): lines of all files, without byte-order marks."""
    t = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).text(path)
    return t.select(F.input_file_name().alias("path"), strip_bom(F.col("value")).alias("value"))


def read_whole(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, value): each file as one text, stripped."""
    t = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path, wholetext=True)
    return t.select(F.input_file_name().alias("path"), F.btrim(strip_bom(F.col("value")), F.lit(" \t\r\n")).alias("value"))


def read_json_blocks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects over several lines, separated by blank lines."""
    t = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    return t.select(F.from_json("value", schema).alias("r")).where("r IS NOT NULL").select("r.*")


def natural_key(name: Column) -> Column:
    """A sort key in which digit runs count as numbers: (text, number) pairs in order."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"))
    return F.transform(parts, lambda p: F.struct(F.when(p.rlike(r"^\d"), F.lit("")).otherwise(p).alias("t"), F.coalesce(p.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("n")))


def in_numeric_order(files: DataFrame, path: str = "path") -> DataFrame:
    """Adds seq: files by number where the stem is one, then by name."""
    stem = stem_last_dot(F.col(path)).try_cast("long")
    t = files.withColumn("_a", stem.isNull()).withColumn("_b", stem).withColumn("_c", base_name(F.col(path)))
    return running(t, ["_a", "_b", "_c"]).withColumn("seq", (F.col("before") + 1).cast("int")).drop("_a", "_b", "_c", "before")


def read_json_documents(spark: SparkSession, path: str, field: str, schema: str) -> DataFrame:
    """(path, pos, schema's columns): the objects of the array `field` of each file, which holds one JSON document. A file
    without the field, or that is no JSON, has no rows. A document has to fit in a task, as it ends with its last byte."""
    t = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"struct<`{field}`: array<struct<{schema}>>>").alias("r"))
    return t.select("path", F.posexplode(f"r.{field}").alias("pos", "o")).select("path", "pos", "o.*")


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b) of allow-list lines, split at the first comma; blank lines and lines without one go."""
    f = F.split(F.trim("value"), ",", 2)
    return read_lines(spark, path).where(F.trim("value") != "").where(F.size(f) == 2).select(f[0].alias("a"), f[1].alias("b"))


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).where(F.trim("value") != "").select(F.trim("value").alias("text"))


def write_new(df: DataFrame, path: str, key: str) -> DataFrame:
    """Appends the rows whose key the sink doesn't have yet (a resumable sink); returns what was written.

    Parquet's committer puts files in place only when their task is done, so an interrupted run leaves no half rows.
    """
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # the sink doesn't exist yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    new = df if done is None else df.join(done, key, "left_anti")
    new.write.mode("append").parquet(path)
    return new

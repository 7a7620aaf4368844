"""Segment lines: `recording channel speaker start end label text`, and time-marked word lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxquarry.sources.text import read_lines


def parse(lines: DataFrame, column: str = "value", variant: str = "split7", strict: bool = False) -> DataFrame:
    """Adds recording_id, channel, speaker, start, end, label and text to lines; comments, blanks and short lines go.

    variant `split7` keeps the text's inner spacing, `rejoin` squeezes it, `single` splits at single blanks so that empty
    fields count. `strict` fails on a short line.
    """
    keep = ~F.col(column).startswith(";") & (F.trim(column) != "")
    if variant == "single":
        f = F.split(column, " ", -1)
        text = F.array_join(F.slice(f, 7, F.greatest(F.size(f) - 6, F.lit(0))), " ")
    elif variant == "rejoin":
        f = F.split(F.trim(column), r"(?U)\s+")
        text = F.array_join(F.slice(f, 7, F.greatest(F.size(f) - 6, F.lit(0))), " ")
    else:
        f = F.split(F.trim(column), r"(?U)\s+", 7)
        text = F.get(f, F.lit(6))
    t = lines.where(keep).withColumn("_f", f).withColumn("text", text)
    ok = F.size("_f") >= 7
    t = t.where(F.assert_true(ok, F.lit("a segment line has fewer than 7 fields")).isNull()) if strict else t.where(ok)
    num = lambda i: F.col("_f")[i].try_cast("double")
    return t.select(
        *[c for c in lines.columns if c not in ("recording_id", "channel", "speaker", "start", "end", "label", "text")],
        F.col("_f")[0].alias("recording_id"), F.col("_f")[1].try_cast("int").alias("channel"), F.col("_f")[2].alias("speaker"),
        num(3).alias("start"), num(4).alias("end"), F.col("_f")[5].alias("label"), "text",
    )


def read(spark: SparkSession, path: str, variant: str = "split7", strict: bool = False) -> DataFrame:
    return parse(read_lines(spark, path, "*.[sS][tT][mM]"), "value", variant, strict)


def line(recording: Column, start: Column, end: Column, text: Column) -> Column:
    return F.format_string("%s 1 %s %.2f %.2f <NA> %s", recording.cast("string"), recording.cast("string"), start, end, text)


def ctm_line(key: Column, start: Column, duration: Column, token: Column, score: Column) -> Column:
    return F.format_string("%s A %.2f %.2f %s %.1f", key.cast("string"), start, duration, token, score)


def write(segments: DataFrame, path: str) -> None:
    """Writes (recording_id, start, end, text) as segment lines."""
    segments.select(line(F.col("recording_id"), F.col("start"), F.col("end"), F.col("text")).alias("value")).write.text(path)


def recogniser_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """`[start end] text` lines to (start, end, text); other lines go."""
    pattern = r"^\[\s*([0-9.]+)\s+([0-9.]+)\s*\]\s*(.*)$"
    t = lines.where(F.col(column).rlike(pattern))
    x = lambda i: F.regexp_extract(column, pattern, i)
    return t.select(*[c for c in lines.columns if c not in ("start", "end", "text")], x(1).cast("double").alias("start"), x(2).cast("double").alias("end"), x(3).alias("text"))

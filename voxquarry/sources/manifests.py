"""JSON-lines manifests, transcripts, lexicons, symbol tables, language models, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxquarry.sources.text import read_lines

RECORDING = "id string, sources array<struct<type: string, channels: array<int>, source: string>>, sampling_rate int, num_samples long, duration double, channel_ids array<int>"
SUPERVISION = "id string, recording_id string, start double, duration double, channel int, text string, language string, speaker string, custom map<string, string>"


def read(spark: SparkSession, path: str, schema: str = SUPERVISION, strict: bool = False) -> DataFrame:
    """A manifest, gzipped or not; bad lines are dropped, or fail the read if `strict`."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def write(df: DataFrame, path: str, compression: str = "gzip") -> None:
    df.write.option("compression", compression).json(path)


def recordings(segments: DataFrame, rate: int = 16000) -> DataFrame:
    """Recording rows of (recording_id, path, duration)."""
    source = F.struct(F.lit("file").alias("type"), F.array(F.lit(0)).alias("channels"), F.col("path").alias("source"))
    return segments.select(F.col("recording_id").alias("id"), F.array(source).alias("sources"), F.lit(rate).alias("sampling_rate"), F.round(F.col("duration") * rate).cast("long").alias("num_samples"), "duration", F.array(F.lit(0)).alias("channel_ids"))


def supervisions(stm: DataFrame, language: str) -> DataFrame:
    """Supervision rows of parsed segment lines, numbered in each recording."""
    n = F.row_number().over(Window.partitionBy("recording_id").orderBy("start", "end"))
    return stm.select(
        F.concat_ws("-", "recording_id", n.cast("string")).alias("id"), "recording_id", "start", F.round(F.col("end") - F.col("start"), 3).alias("duration"), F.lit(0).alias("channel"), "text",
        F.lit(language).alias("language"), "speaker",
    )


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, tokens, line): at least two fields a line and no `<eps>`, or the read fails."""
    t = read_lines(spark, path).where(F.trim("value") != "").withColumn("f", F.split(F.trim("value"), r"\s+"))
    ok = (F.size("f") >= 2) & (F.col("f")[0] != "<eps>")
    t = t.where(F.assert_true(ok, F.lit("a lexicon line has no tokens or defines <eps>")).isNull())
    return t.select(F.col("f")[0].alias("word"), F.slice("f", F.lit(2), F.size("f") - 1).alias("tokens"), "value")


def write_lexicon(lexicon: DataFrame, path: str) -> None:
    lexicon.select(F.concat_ws(" ", "word", F.array_join("tokens", " ")).alias("value")).write.text(path)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    return read_lines(spark, path).where(F.trim("value") != "").select(f[0].alias("symbol"), f[1].cast("long").alias("id"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(id, kind, text) of `id:<tab>kind=text` lines."""
    p = r"^(.*?):\t(\w+)=(.*)$"
    return read_lines(spark, path).where(F.col("value").rlike(p)).select(*[F.regexp_extract("value", p, i).alias(n) for i, n in ((1, "id"), (2, "kind"), (3, "text"))])


def write_arpa(model: DataFrame, path: str) -> None:
    """The usual text form: counts, then a section for each order, log10 values with seven digits; -99 for probability 0.

    Lines are sorted by (section, n-gram) over range partitions, so the parts read in order are one file.
    """
    gram = F.concat_ws("\t", F.format_string("%.7f", F.when(F.col("f") > 0, F.log10("f")).otherwise(F.lit(-99.0))), F.trim(F.concat_ws(" ", "hist", "word")), F.when(F.col("bow").isNotNull(), F.format_string("%.7f", F.log10("bow"))))
    body = model.select(F.col("n").alias("s"), F.lit(1).alias("k"), F.trim(F.concat_ws(" ", "hist", "word")).alias("g"), gram.alias("value"))
    per = model.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    spark = model.sparkSession
    head = spark.createDataFrame([(0, 0, "", "\\data\\"), (99, 0, "", "\\end\\")], "s int, k int, g string, value string")
    counts = per.select(F.lit(0).alias("s"), F.lit(1).alias("k"), F.col("n").cast("string").alias("g"), F.format_string("ngram %d=%d", "n", "c").alias("value"))
    marks = per.select(F.col("n").alias("s"), F.lit(0).alias("k"), F.lit("").alias("g"), F.format_string("\n\\%d-grams:", "n").alias("value"))
    head.unionByName(counts).unionByName(marks).unionByName(body).orderBy("s", "k", "g").select("value").write.text(path)


def read_arpa(spark: SparkSession, path: str) -> DataFrame:
    """(n, hist, word, f, bow): a line's number of words is its section's order, so lines need no state."""
    f = F.split("value", "\t")
    t = spark.read.text(path).where(F.col("value").rlike(r"^-?[0-9.]+\t")).select(f.alias("f"))
    w = F.split(F.col("f")[1], " ")
    return t.select(F.size(w).alias("n"), F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " ").alias("hist"), F.element_at(w, -1).alias("word"), F.pow(F.lit(10.0), F.col("f")[0].cast("double")).alias("f"), F.pow(F.lit(10.0), F.get("f", F.lit(2)).cast("double")).alias("bow"))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Condition tables with a header; `snr` may be inf, an empty cell is null."""
    t = spark.read.option("header", True).csv(path)
    num = [c for c in t.columns if c in ("rt60", "snr", "draw", "M", "S", "I", "D", "wer", "rt60_measured", "slice_seed")]
    return t.select(*[F.when(F.lower(F.col(c)) == "inf", F.lit(float("inf"))).otherwise(F.col(c).try_cast("double")).alias(c) if c in num else F.col(c) for c in t.columns])


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated matrix with a header, as (row, column, value)."""
    t = spark.read.option("header", True).option("sep", "\t").csv(path)
    first, rest = t.columns[0], t.columns[1:]
    return t.select(F.col(first).alias("row"), F.explode(F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*[F.col(c).try_cast("double") for c in rest]))).alias("column", "value"))


def write_matrix(table: DataFrame, path: str) -> None:
    """Tab-separated with a header: the first column names the rows."""
    table.write.option("header", True).option("sep", "\t").csv(path)


def without_name(files: DataFrame, part: str) -> DataFrame:
    """Rows of a file table whose files' paths lack `part` behind the last table folder: selection of manifests by name."""
    return files.where(~F.contains(F.col("_metadata.file_path"), F.lit(part)))

"""Corpus-wide line deduplication, in DataFrame functions only.

Lines are normalised, hashed and exploded; documents are counted per hash; hashes over the threshold are joined
back to (hash, document) rows; each document is reassembled by position without them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxquarry.llm.common import LOWER, UPPER, lower_ascii, materialise, renamed, table


def line_key(line):
    """The line without white space at its ends, A-Z lower-cased (lower() does that too where all is ASCII, and is faster)."""
    line = F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(lower_ascii(line))


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, _text, pos, a, b) of each line whose key is long enough; a and b are a 128-bit hash of the key, _text is a hash of the text."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    keys = lines.where(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    return keys.where(F.char_length("key") >= min_chars).select("doc_id", "_text", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(7), "key").alias("b"))


def _without(lines, drop):
    """The array `lines` without the 0-based positions in the sorted array `drop`: the slices between them, in one pass."""
    begin = F.concat(F.array(F.lit(0)), F.transform(drop, lambda p: p + 1))
    end = F.concat(drop, F.array(F.size(lines)))
    return F.flatten(F.zip_with(begin, end, lambda i, j: F.slice(lines, i + 1, j - i)))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Adds n_lines, n_dropped and replaces `text` with the kept lines; every other column stays.

    A line goes if its key has at least `min_chars` code points and is in at least `min_docs` documents, unless the
    document has the largest doc_id that holds it. Null or empty text: one empty line. Rows with the same doc_id are
    one document when documents are counted, and keep a line together; null doc_ids are one document too, smaller than
    any other. Columns n_lines and n_dropped of the input are replaced.
    """
    docs, names = renamed(docs.drop("n_lines", "n_dropped"), "doc_id", "text")
    hashed = _hashed(docs, min_chars)
    held = hashed.select("a", "b", "doc_id").distinct()
    bad = held.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")).where(F.col("n") >= min_docs).drop("n")
    bad = materialise(bad, "line-dedup-bad")
    drops = (
        hashed.join(bad, ["a", "b"])
        .where(~F.col("doc_id").eqNullSafe(F.col("keep")))
        .groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_t"))
        .agg(F.array_sort(F.collect_set("pos")).alias("_drop"))
    )
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_t")), "left").drop("_id", "_t")
    text = F.coalesce(F.col("text"), F.lit(""))
    n_lines = (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
    n_dropped = F.when(F.col("_drop").isNull(), F.lit(0)).otherwise(F.size("_drop")).cast("long")
    left = F.when(F.col("_drop").isNull(), text).otherwise(F.array_join(_without(_lines(F.col("text")), F.col("_drop")), "\n"))
    row = [left.alias(c) if n.lower() == "text" else F.col(n).alias(c) for c, n in names.items()]
    return joined.select(*row, n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB's form of the whole operator; {cols} and {tail} let the query and the pipeline stage share it.
OP2_SQL = f"""
WITH lines AS (
  SELECT doc_id, pos, line,
         regexp_replace(translate(line, '{UPPER}', '{LOWER}'), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
bad AS (SELECT k, max(doc_id) AS keep FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT l.doc_id, l.pos, l.line, (b.k IS NOT NULL AND l.doc_id <> b.keep) AS dropped
           FROM lines l LEFT JOIN bad b ON l.k = b.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

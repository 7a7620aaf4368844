"""Corpus preparation: each stage works on all that its predecessor kept, read back from Parquet.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Rows
that repeat a doc_id are one document where documents are counted, linked or drawn; a row leaves by its own language or
its own benchmark passage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxquarry.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from voxquarry.llm.common import materialise, table

#: Language predictions below this score are rejected, as is `und`.
LEAST_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the training rows of docs and drops texts without a language (null, letterless) or with an unsure one."""
    model = language_id.fit(language_id.training_rows(docs).select("text", "lang"))
    told = language_id.predict(docs, model)
    if not model.langs:  # nothing to learn from: only texts without a letter can be told
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return told.where((F.col("lang_pred") != language_id.UND) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that many documents repeat; n_chars follows. A text may end up empty."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of similar ones. Texts without words are no copies of each other."""
    groups = ngram_join.jaccard_components(docs.select("doc_id", "text"))
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    return docs.alias("d").join(stay.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi").select("d.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes: the columns of documents, copy (from 1), size and the source's target."""
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "size", "target")


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: Language ID is learned and the links are exact over all sets; SQL can't express the chain. Tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

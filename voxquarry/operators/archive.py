"""Training archive of a language model as ragged tables: values and where each row's values begin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxquarry.operators.relational import running
from voxquarry.operators.vocab import first_seen_ids


def _positions(sentences: DataFrame, order: list[str], words: str) -> DataFrame:
    return sentences.select(*order, F.posexplode(words).alias("pos", "word"))


def words_table(sentences: DataFrame, order: list[str], words: str, pieces: Callable[[Column], Column]) -> DataFrame:
    """(word_id, word, pieces, begin): words numbered from 0 by first appearance, each word's pieces, and the sum of all earlier
    words' numbers of pieces. Null words don't count. `order` must be unique."""
    ids = first_seen_ids(_positions(sentences, order, words).where("word IS NOT NULL"), "word", [*order, "pos"])
    t = ids.select(F.col("id").alias("word_id"), "word", pieces(F.col("word")).alias("pieces"))
    return running(t, ["word_id"], F.size("pieces").cast("long"), "begin")


def sentences_table(sentences: DataFrame, order: list[str], words: str, table: DataFrame) -> DataFrame:
    """(order, word_ids, begin): the ids of each sentence's words, and the sum of all earlier sentences' numbers of words."""
    hit = _positions(sentences, order, words).join(table.select("word", "word_id"), "word")
    ids = hit.groupBy(*order).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word_id"))), lambda x: x["word_id"]).alias("word_ids"))
    t = sentences.select(*order).join(ids, order, "left").withColumn("word_ids", F.coalesce("word_ids", F.array().cast("array<bigint>")))
    return running(t, order, F.size("word_ids").cast("long"), "begin")


def lengths_table(sentences: DataFrame, order: list[str], words: str, table: DataFrame) -> DataFrame:
    """(order, length): each sentence's number of pieces. Words are counted by sentence before they meet the table."""
    n = _positions(sentences, order, words).groupBy(*order, "word").agg(F.count(F.lit(1)).alias("_n"))
    hit = n.join(table.select("word", F.size("pieces").alias("_k")), "word").groupBy(*order).agg(F.sum(F.col("_n") * F.col("_k")).alias("length"))
    return sentences.select(*order).join(hit, order, "left").withColumn("length", F.coalesce("length", F.lit(0).cast("long")))

"""Vocabularies, symbol tables and lexicons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxquarry.functions import text as T
from voxquarry.operators.relational import running


def letter_counts(lines: DataFrame, column: str = "line") -> DataFrame:
    """(letter, n) over all letters, lower-cased. Characters are counted first and told apart once each."""
    chars = lines.select(F.explode(F.split(column, "")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    return chars.where(F.col("c").rlike(r"^\p{L}$")).groupBy(F.lower("c").alias("letter")).agg(F.sum("n").alias("n"))


def distinct_words(lines: DataFrame, column: str = "line") -> DataFrame:
    return lines.select(F.explode(T.words(F.col(column))).alias("word")).distinct()


def dense_ids(items: DataFrame, column: str, start: int = 0) -> DataFrame:
    """Ids in sorted order without gaps; no task holds the whole vocabulary."""
    return running(items.select(column), [column]).select(column, (F.col("before") + start).alias("id"))


def word_ids(words: DataFrame, column: str = "word") -> DataFrame:
    """Symbol table: `<eps>` 0, `!SIL` 1, sorted words from 2, then `<unk>` unless it is a word, `#0`, `<s>`, `</s>`."""
    spark = words.sparkSession
    body = dense_ids(words.select(F.col(column).alias("symbol")).distinct(), "symbol", 2)
    stats = body.agg(F.coalesce(F.max("id"), F.lit(1)).alias("last"), F.coalesce(F.max(F.col("symbol") == "<unk>"), F.lit(False)).alias("has"))
    tail = stats.select(F.posexplode(F.when(F.col("has"), F.array(*map(F.lit, ["#0", "<s>", "</s>"]))).otherwise(F.array(*map(F.lit, ["<unk>", "#0", "<s>", "</s>"])))).alias("k", "symbol"), "last")
    head = spark.createDataFrame([("<eps>", 0), ("!SIL", 1)], "symbol string, id long")
    return head.unionByName(body).unionByName(tail.select("symbol", (F.col("last") + 1 + F.col("k")).alias("id")))


def first_seen_ids(tokens: DataFrame, token: str, order: list[str], start: int = 0) -> DataFrame:
    """Ids in order of first appearance."""
    firsts = tokens.groupBy(token).agg(F.min(F.struct(*order)).alias("first"))
    return running(firsts, ["first"]).select(token, (F.col("before") + start).alias("id"))


def char_lexicon(words: DataFrame, chars: DataFrame, word: str = "word", char: str = "char") -> DataFrame:
    """Words whose characters are all known, with their characters; words with an unknown one are left out."""
    t = words.select(F.col(word).alias("word"), F.filter(F.split(word, ""), lambda c: c != "").alias("tokens"))
    unknown = t.select("word", F.explode("tokens").alias("char")).distinct().join(chars.select(F.col(char).alias("char")), "char", "left_anti")
    return t.join(unknown.select("word").distinct(), "word", "left_anti")


def unique_pronunciations(lexicon: DataFrame, word: str = "word", order: str = "line_no") -> DataFrame:
    """The first row of each word."""
    keep = [c for c in lexicon.columns if c != word]
    return lexicon.groupBy(word).agg(F.min_by(F.struct(*keep), F.col(order)).alias("r")).select(word, *[F.col(f"r.{c}").alias(c) for c in keep])


def unknown_tokens(lexicon: DataFrame, vocabulary: DataFrame, tokens: str = "tokens", symbol: str = "symbol") -> DataFrame:
    """Tokens of a lexicon that a vocabulary lacks; empty if the lexicon is valid."""
    return lexicon.select("word", F.explode(tokens).alias("token")).join(vocabulary.select(F.col(symbol).alias("token")), "token", "left_anti").select("word", "token")


def merge_symbol_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """(symbol, id, conflict): the union; conflict where the two give a symbol different ids."""
    t = a.withColumnRenamed("id", "_a").join(b.withColumnRenamed("id", "_b"), "symbol", "full")
    return t.select("symbol", F.coalesce("_a", "_b").alias("id"), F.coalesce(F.col("_a") != F.col("_b"), F.lit(False)).alias("conflict"))


def disambiguate(lexicon: DataFrame, word: str = "word", tokens: str = "tokens", order: str = "line_no") -> DataFrame:
    """Adds tag: `#k` for a token sequence that several rows share or that begins another row's, else null.

    Rows of one sequence are numbered from 1 in order; a sequence that only begins others gets #1.
    """
    t = lexicon.withColumn("_key", F.array_join(tokens, " "))
    counts = t.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    begins = t.select(F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(1))), lambda i: F.when(i < F.size(tokens), F.array_join(F.slice(tokens, F.lit(1), i), " "))), lambda x: x.isNotNull())).alias("_key")).distinct()
    out = t.join(counts, "_key").join(begins.withColumn("_begins", F.lit(True)), "_key", "left")
    k = F.row_number().over(Window.partitionBy("_key").orderBy(order))
    need = (F.col("_n") > 1) | F.coalesce("_begins", F.lit(False))
    return out.withColumn("tag", F.when(need, F.concat(F.lit("#"), k.cast("string")))).drop("_key", "_n", "_begins")


def encode(sentences: DataFrame, keys: list[str], words: str, ids: DataFrame, unknown: int) -> DataFrame:
    """Sentence arrays of ids: a word without an id gets `unknown`."""
    t = sentences.select(*keys, F.posexplode(words).alias("_pos", "word"))
    t = t.join(ids.select(F.col("symbol").alias("word"), "id"), "word", "left").withColumn("id", F.coalesce("id", F.lit(unknown).cast("long")))
    return t.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "id"))), lambda x: x["id"]).alias("ids"))


def script_filter(words: Column, allowed: str = "[^a-z']") -> Column:
    return F.filter(words, lambda w: ~w.rlike(allowed))

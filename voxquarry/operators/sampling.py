"""Seeded sampling: every draw is a hash of a key and a seed, so that reruns agree on any number of executors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxquarry.functions.text import words

_DIGITS = 13


def uniform(seed: str, *keys: Column | str) -> Column:
    """A number in [0, 1) from keys and a seed: the first 52 bits of the MD5 of `seed|key|key...`."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]).cast("binary"))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def interleave(parts: list[tuple[DataFrame, float]], key: str, seed: str = "mux") -> DataFrame:
    """Union of datasets in weighted random order: rows get place, a key that sorts them so (a race of exponential clocks)."""
    rows = []
    for i, (df, weight) in enumerate(parts):
        u = uniform(f"{seed}|{i}", key)
        rows.append(df.withColumn("source", F.lit(i)).withColumn("place", -F.log(1 - u) / weight))
    return reduce(DataFrame.unionByName, rows)


def corrupt(df: DataFrame, keys: list[str], text: str, substitute: float, delete: float, insert: float, seed: str = "corrupt", pool: int = 1000) -> DataFrame:
    """Word errors at given rates: one draw a word decides to delete, replace by another word of the corpus, or add one
    after it. Replacements come from the `pool` most frequent words, never the word itself."""
    if min(substitute, delete, insert) < 0 or substitute + delete + insert > 1:
        raise ValueError("rates must be at least 0 and sum to 1 at most")
    t = df.select(*keys, F.posexplode(words(F.col(text))).alias("pos", "word"))
    often = t.groupBy("word").count().orderBy(F.desc("count"), "word").limit(pool).select("word")
    often = often.agg(F.array_sort(F.collect_list("word")).alias("pool")).select(F.size("pool").alias("n"), F.posexplode("pool").alias("place", "word"))  # `pool` rows
    size = F.broadcast(often.agg(F.max("n").alias("n")))
    u, pick = uniform(seed, *keys, "pos"), uniform(seed + "|pick", *keys, "pos")
    t = t.crossJoin(size).join(F.broadcast(often.select("word", "place")), "word", "left").withColumn("u", u)
    # a place among the others of the pool: its own word is stepped over
    at = F.floor(pick * (F.col("n") - F.col("place").isNotNull().cast("int"))).cast("int")
    t = t.withColumn("at", at).withColumn("at", F.col("at") + F.coalesce(F.col("at") >= F.col("place"), F.lit(False)).cast("int"))
    t = t.join(F.broadcast(often.select(F.col("place").alias("at"), F.col("word").alias("new"))), "at", "left")
    out = F.when(F.col("u") < delete, F.array().cast("array<string>")).when(F.col("u") < delete + substitute, F.array("new")).when(F.col("u") < delete + substitute + insert, F.array("word", "new")).otherwise(F.array("word"))
    g = t.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", out.alias("o")))).alias("l"))
    return g.select(*keys, F.array_join(F.flatten(F.transform("l", lambda x: x["o"])), " ").alias(text))

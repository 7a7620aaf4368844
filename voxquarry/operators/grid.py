"""Tables of conditions: pooled rates, draws, marginals, bootstrap intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def errors(prefix: str = ""):
    c = lambda x: F.col(prefix + x)
    return c("s") + c("i") + c("d"), c("m") + c("s") + c("d")


def cells(counts: DataFrame, cell: list[str]) -> DataFrame:
    """(cell, err, ref, wer): counts pooled over draws and utterances."""
    e, n = errors()
    t = counts.groupBy(*cell).agg(F.sum(e).alias("err"), F.sum(n).alias("ref"))
    return t.withColumn("wer", F.when(F.col("ref") == 0, F.lit(0.0)).otherwise(F.col("err") / F.col("ref")))


def draws(counts: DataFrame, cell: list[str], draw: str) -> DataFrame:
    """(cell, k, mean, sd): mean and sample deviation of the draws' rates; the deviation of one draw is 0."""
    t = cells(counts, [*cell, draw])
    return t.groupBy(*cell).agg(F.count(F.lit(1)).alias("k"), F.avg("wer").alias("mean"), F.coalesce(F.stddev_samp("wer"), F.lit(0.0)).alias("sd"))


def marginal(table: DataFrame, axis: str, value: str = "wer") -> DataFrame:
    """Unweighted mean of the cells over the other axis (not pooled)."""
    return table.groupBy(axis).agg(F.avg(value).alias(value))


#: Entries of a matrix of weights that the driver may draw.
MOST_WEIGHTS = 20_000_000


def _drawn(rng: np.random.Generator, n: int, replicates: int) -> np.ndarray:
    if n * replicates > MOST_WEIGHTS:
        raise ValueError(f"{n} items in {replicates} replicates are more weights than the driver draws; take fewer replicates")
    return rng.multinomial(n, np.full(n, 1 / n), replicates)


def _weight_rows(w: np.ndarray, item: str) -> pd.DataFrame:
    rep, at = np.nonzero(w)
    return pd.DataFrame({"rep": rep.astype("int64"), item: at.astype("int64"), "w": w[rep, at].astype("int64")})


def bootstrap_weights(spark: SparkSession, utterances: int, replicates: int, seed: int) -> DataFrame:
    """(rep, utt, w): multinomial resampling weights of a NumPy generator, drawn in its own order on the driver. The matrix
    has replicates * utterances entries, at most MOST_WEIGHTS; only those over 0 become rows."""
    return spark.createDataFrame(_weight_rows(_drawn(np.random.default_rng(seed), utterances, replicates), "utt"))


def two_level_weights(counts: DataFrame, cell: list[str], draw: str, utterances: int, replicates: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rep, utt, w) and (cell, rep, draw, w): weights of utterances and, from the same generator behind them, of each cell's draws,
    cell by cell in sorted order. The driver gets the list of cells with their draws, a table of conditions."""
    rng, spark = np.random.default_rng(seed), counts.sparkSession
    utts = spark.createDataFrame(_weight_rows(_drawn(rng, utterances, replicates), "utt"))
    parts = []
    for row in counts.groupBy(*cell).agg(F.array_sort(F.collect_set(draw)).alias("_d")).orderBy(*cell).collect():
        own = _weight_rows(_drawn(rng, len(row["_d"]), replicates), draw)
        own[draw] = np.array(row["_d"])[own[draw]]
        for c in cell:
            own[c] = row[c]
        parts.append(own)
    return utts, spark.createDataFrame(pd.concat(parts)[[*cell, "rep", draw, "w"]])


def two_level_replicates(counts: DataFrame, utts: DataFrame, draws_: DataFrame, cell: list[str], draw: str, utt: str = "utt") -> DataFrame:
    """(cell, rep, wer): ratio of sums under both levels' weights; utterances are weighed within draws first."""
    e, n = errors()
    per = counts.groupBy(*cell, draw, utt).agg(F.sum(e).alias("e"), F.sum(n).alias("n"))
    one = per.join(utts, utt).groupBy(*cell, draw, "rep").agg(F.sum(F.col("w") * F.col("e")).alias("e"), F.sum(F.col("w") * F.col("n")).alias("n"))
    t = one.join(draws_, [*cell, draw, "rep"]).groupBy(*cell, "rep").agg(F.sum(F.col("w") * F.col("e")).alias("e"), F.sum(F.col("w") * F.col("n")).alias("n"))
    return t.select(*cell, "rep", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("e") / F.col("n")).alias("wer"))


def replicates(counts: DataFrame, weights: DataFrame, cell: list[str], utt: str = "utt") -> DataFrame:
    """(cell, rep, wer): weighted ratio of sums in each replicate; all cells share the utterances' weights, so they pair."""
    e, n = errors()
    per = counts.groupBy(*cell, utt).agg(F.sum(e).alias("e"), F.sum(n).alias("n"))
    t = per.join(weights, utt).groupBy(*cell, "rep").agg(F.sum(F.col("w") * F.col("e")).alias("e"), F.sum(F.col("w") * F.col("n")).alias("n"))
    return t.select(*cell, "rep", F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("e") / F.col("n")).alias("wer"))


def intervals(reps: DataFrame, cell: list[str], value: str = "wer", level: float = 0.95) -> DataFrame:
    """(cell, lo, hi): percentile interval, linear between order statistics."""
    a = (1 - level) / 2
    t = reps.groupBy(*cell).agg(F.percentile(value, F.array(F.lit(a), F.lit(1 - a))).alias("q"))
    return t.select(*cell, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def deltas(reps: DataFrame, cell: list[str], base: DataFrame, value: str = "wer") -> DataFrame:
    """Differences from a base condition (rep, value) in the same replicate."""
    b = base.select("rep", F.col(value).alias("_b"))
    return reps.join(b, "rep").select(*cell, "rep", (F.col(value) - F.col("_b")).alias("delta"))

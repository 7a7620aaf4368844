"""Functions for SQL, and the hook that stands for a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from voxquarry.functions import text
from voxquarry.operators.align import align_pairs, word_distance


@udtf(returnType="pos int, ref string, hyp string")
class AlignWords:
    """align_words(ref, hyp): the aligned word pairs of two texts."""

    def eval(self, ref: str, hyp: str):
        for i, (a, b) in enumerate(align_pairs((ref or "").split(), (hyp or "").split())):
            yield i, a, b


def register(spark: SparkSession) -> None:
    spark.udf.register("number_in_malay", text.number_in_malay)
    spark.udf.register("number_in_malay_prefixed", text.number_in_malay_prefixed)
    spark.udf.register("normalise_sentence", text.normalise_sentence_gold)
    spark.udf.register("normalise_text", text.normalise_text)
    spark.udf.register("nfc", text.nfc)
    spark.udf.register("word_distance", word_distance)
    spark.udtf.register("align_words", AlignWords)


def apply_model(df: DataFrame, score_fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Runs score_fn, pandas in and pandas out, over batches: a recogniser, a language model, any scorer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield score_fn(pdf)

    return df.mapInPandas(run, schema)

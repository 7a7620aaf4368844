"""Sub-word pieces of a public vocabulary, whose path is $PIECE_MODEL or that of the installed files; SQL has no vocabulary to follow with."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from voxquarry.functions import text as X
from voxquarry.functions.pieces import Segmenter
from voxquarry.plans.registry import query, table
from voxquarry.sources import pieces as P


def segmenter(spark):
    path = os.environ.get("PIECE_MODEL")
    if not path:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Segmenter(*P.read(spark, path))


@query("piece_ids")
def piece_ids(spark, d):
    """Piece ids of every document, with words of 15 letters and more as unknown ones."""
    s = segmenter(spark)
    t = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[\p{L}]{15,}", "<unk>").alias("text"))
    ids = s.ids_around(F.col("text"))
    return t.select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").alias("n"), F.array_size(F.filter("ids", lambda i: i == s.table.unknown)).alias("unknown"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("piece_lexicon")
def piece_lexicon(spark, d):
    """Pieces of every word of the transcripts, and of the unknown word."""
    words = table(spark, d, "conversations").select(F.explode(X.words(F.col("text"))).alias("word"))
    return segmenter(spark).lexicon(words).select("word", F.array_join("tokens", " ").alias("tokens"))

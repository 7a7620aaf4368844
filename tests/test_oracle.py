"""Every query of the library against DuckDB's SQL on the smallest tables."""

import pytest
from helpers import DATA, rows

from voxquarry.plans.all_queries import ORACLES, QUERIES

#: Queries that SQL can't follow, and the tests that hold their results.
HELD_ELSEWHERE = {
    "anchored_error_rates": "test_align.py::test_anchored_rates_of_documents_equal_whole_alignments",
    "multi_talker_wer": "test_extra.py::test_query_equals_all_assignments",
    "normalise_sentences": "test_text.py::test_sentences_of_documents",
    "numpy_bootstrap": "test_segments.py::test_bootstraps_equal_numpy",
    "piece_ids": "test_pieces.py::test_queries_over_documents",
    "piece_lexicon": "test_pieces.py::test_unknown_marks_and_the_lexicon",
    "prefix_beam_search": "test_ranking.py::test_wide_beams_give_the_sums_of_all_alignments",
    "two_level_bootstrap": "test_segments.py::test_bootstraps_equal_numpy",
}


def test_every_query_is_held_to_something():
    assert set(QUERIES) - set(ORACLES) == set(HELD_ELSEWHERE)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df)
    res = duck.execute(ORACLES[name])
    names = [x[0] for x in res.description]
    cols = sorted(names)
    assert cols == sorted(df.columns)
    want = sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in res.fetchall())
    assert got == want


def test_beams_run_over_all_vectors(spark):
    got = QUERIES["prefix_beam_search"](spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/embeddings.parquet").count() and all(r["log_p"] <= 0 for r in got)

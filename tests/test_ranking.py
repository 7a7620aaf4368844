import numpy as np
import pytest

from voxquarry.operators import ranking as R

PHRASES = ["S", "HE", "SHE", "SHELL", "HIS", "HERS", "HELLO", "THIS", "THEM"]
#: Queries and their bonus for equal and for phrase-wise scores, all matches and one at a time.
EXPECTED = {
    (0, True): {"HEHERSHE": 14, "HERSHE": 12, "HISHE": 9, "SHED": 6, "SHELF": 6, "HELL": 2, "HELLO": 7, "DHRHISQ": 4, "THEN": 2},
    (0, False): {"HEHERSHE": 7, "HERSHE": 5, "HISHE": 5, "SHED": 3, "SHELF": 3, "HELL": 2, "HELLO": 2, "DHRHISQ": 3, "THEN": 2},
    (5, True): {"HEHERSHE": 35.84, "HERSHE": 30.84, "HISHE": 24.18, "SHED": 18.34, "SHELF": 18.34, "HELL": 5, "HELLO": 13, "DHRHISQ": 10.84, "THEN": 5},
    (5, False): {"HEHERSHE": 20, "HERSHE": 15, "HISHE": 10.84, "SHED": 10, "SHELF": 10, "HELL": 5, "HELLO": 5, "DHRHISQ": 5.84, "THEN": 5},
}


@pytest.mark.parametrize("case", EXPECTED)
def test_phrase_bonus(case):
    score, strict = case
    g = R.PhraseGraph([tuple(p) for p in PHRASES], 1.0, [round(score / len(p), 2) for p in PHRASES])
    assert {q: round(g.total(q, strict), 2) for q in EXPECTED[case]} == EXPECTED[case]


def test_prefix_beam_merges_prefixes():
    p = np.log(np.array([[0.4, 0.6], [0.4, 0.6]]))
    best = dict(R.prefix_beam(p, 4))
    assert np.isclose(np.exp(best[(1,)]), 0.84) and np.isclose(np.exp(best[()]), 0.16)


def test_collapse(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([([0, 1, 1, 0, 1, 2, 2],), ([],), ([0, 0],)], "t array<int>")
    assert [r[0] for r in df.select(R.collapse(F.col("t"))).collect()] == [[1, 1, 2], [], []]


def test_state_costs(spark):
    states = spark.createDataFrame([(1, "ab", 0.0, "x")], "utt int, state string, cost double, token string")
    arcs = spark.createDataFrame([("b", "x", "bx", 2.0), ("", "x", "x", 5.0)], "src string, token string, dst string, cost double")
    back = spark.createDataFrame([("ab", "b", 1.0), ("b", "", 1.0)], "src string, dst string, cost double")
    assert sorted(map(tuple, R.state_costs(arcs, back, states, "token", 2).collect())) == [(1, "bx", 3.0), (1, "x", 7.0)]


def test_wide_beams_give_the_sums_of_all_alignments(spark):
    import itertools

    rng = np.random.default_rng(3)
    utts = [np.log(rng.dirichlet(np.ones(3), n)) for n in (0, 1, 3, 5)]
    df = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(utts)] + [(9, None)], "i int, f array<array<double>>")
    got = {}
    for r in R.prefix_beams(df, ["i"], "f", 10_000).orderBy("i", "rank").collect():
        got.setdefault(r["i"], []).append(r)
    assert set(got) == {0, 1, 2, 3}
    for i, f in enumerate(utts):
        total = {}
        for path in itertools.product(range(3), repeat=len(f)):
            key = tuple(k for k, _ in itertools.groupby(path) if k)
            total[key] = np.logaddexp(total.get(key, -np.inf), sum(f[t, k] for t, k in enumerate(path)))
        assert {tuple(b["prefix"]): pytest.approx(b["log_p"], abs=1e-9) for b in got[i]} == total
        assert [b["log_p"] for b in got[i]] == sorted((b["log_p"] for b in got[i]), reverse=True)
    assert R.prefix_beams(df, ["i"], "f", 2).groupBy("i").count().where("count > 2").count() == 0
    assert [r["prefix"] for r in R.prefix_beams(df, ["i"], "f", 10_000, best=1).orderBy("i").collect()] == [b[0]["prefix"] for _, b in sorted(got.items())]


def test_reading_tokens_over_back_off_paths(spark):
    arcs = spark.createDataFrame([("ab", "c", "bc", 1.0), ("b", "c", "bc", 0.1), ("root", "c", "c", 9.0), ("bc", "d", "cd", 5.0), ("c", "d", "cd", 0.5)], "src string, token string, dst string, cost double")
    back = spark.createDataFrame([("ab", "b", 0.3), ("b", "root", 1.0), ("bc", "c", 0.2), ("c", "root", 1.0)], "src string, dst string, cost double")
    tokens = spark.createDataFrame([(1, 0, "c"), (1, 1, "d"), (2, 0, "c"), (3, 0, "x"), (3, 1, "c")], "utt int, pos int, token string")
    got = {r["utt"]: r["cost"] for r in R.read_tokens(arcs, back, tokens, "ab", 2, 2).collect()}
    assert got == {1: pytest.approx(0.3 + 0.1 + 0.2 + 0.5), 2: pytest.approx(0.4), 3: None}

import random
import tracemalloc

import numpy as np
from helpers import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxquarry.operators import align as A

WORDS = st.lists(st.sampled_from("abcd"), max_size=12)


def plain(ref, hyp):
    """The same alignment, cell by cell."""
    n, m = len(ref), len(hyp)
    s = [[0.0] * (m + 1) for _ in range(n + 1)]
    op = [[""] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                best = s[i - 1][j - 1] + (2 if ref[i - 1] == hyp[j - 1] else -1)
                o = "p"
                if s[i - 1][j] - 0.75 > best:
                    best, o = s[i - 1][j] - 0.75, "d"
                if s[i][j - 1] - 0.75 > best:
                    best, o = s[i][j - 1] - 0.75, "i"
                s[i][j], op[i][j] = best, o
            elif i or j:
                s[i][j], op[i][j] = -0.75 * (i + j), "d" if i else "i"
    out, i, j = [], n, m
    while i or j:
        o = op[i][j]
        i, j = i - (o != "i"), j - (o != "d")
        out.append((ref[i] if o != "i" else None, hyp[j] if o != "d" else None))
    return out[::-1]


@settings(max_examples=300, deadline=None)
@given(WORDS, WORDS)
def test_score_alignment_agrees_with_the_plain_loop(ref, hyp):
    pairs = A.align_pairs(ref, hyp)
    assert pairs == plain(ref, hyp)
    assert [r for r, _ in pairs if r is not None] == ref and [h for _, h in pairs if h is not None] == hyp


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_edit_alignment_is_minimal(ref, hyp):
    pairs = A.edit_pairs(ref, hyp)
    d = list(range(len(hyp) + 1))
    for i, r in enumerate(ref, 1):
        new = [i]
        for j, h in enumerate(hyp, 1):
            new.append(min(d[j] + 1, new[-1] + 1, d[j - 1] + (r != h)))
        d = new
    assert sum(r != h for r, h in pairs) == d[-1]


def test_column_zero():
    assert A.align_pairs(["a", "b", "c"], ["c"]) == [("a", None), ("b", None), ("c", "c")]
    assert A.align_pairs(["a", "b", "c"], ["c"], legacy_column0=True) == [("c", "c")]


def totals(spark, ref, hyp, reps=(), ins=(), dels=()):
    df = spark.createDataFrame([(1, ref.split(), hyp.split())], "k int, ref array<string>, hyp array<string>")
    pairs = A.explode_pairs(df.withColumn("pairs", A.aligned(F.col("ref"), F.col("hyp"))), ["k"])
    one = lambda x: spark.createDataFrame([(t,) for t in x], "text string")
    sp = A.apply_allow_lists(A.spans(pairs, ["k"]), spark.createDataFrame(list(reps), "a string, b string"), one(ins), one(dels))
    return A.totals(sp, ["k"]).first()


def test_allowed_replacement_counts_as_one_match(spark):
    ref, hyp = "the moviemaker filmed a beautiful scene", "the movie maker filmed a beautiful scene"
    t = totals(spark, ref, hyp, [("movie maker", "moviemaker")])
    assert (t.m, t.s, t.i, t.d, t.wer) == (6, 0, 0, 0, 0.0)
    t = totals(spark, ref, hyp)
    assert (t.m, t.s, t.i, t.d) == (5, 1, 1, 0)


def test_allowed_insertions_and_deletions_count_nothing(spark):
    t = totals(spark, "a b c", "a x b", ins=["x"], dels=["c"])
    assert (t.m, t.s, t.i, t.d) == (2, 0, 0, 0)


def test_runaway_and_null_are_not_aligned(spark):
    df = spark.createDataFrame([(["a"], ["b"] * 9), (None, ["a"]), (["a"], ["a"])], "ref array<string>, hyp array<string>")
    assert [(x["status"], x["pairs"] is None) for x in A.guarded(df, "ref", "hyp", max_words=8).collect()] == [("runaway", True), ("scored", True), ("scored", False)]
    assert [x[0] is None for x in df.select(A.aligned(F.col("ref"), F.col("hyp"))).collect()] == [False, True, False]


def changed(rng, n, words, rate):
    """A sequence, and the same with words lost, changed and put in."""
    ref = [str(rng.randrange(words)) for _ in range(n)]
    hyp = []
    for w in ref:
        x = rng.random() / rate
        hyp += [] if x < 1 / 3 else [str(rng.randrange(words))] if x < 2 / 3 else [w, "x"] if x < 1 else [w]
    return ref, hyp


def matrix(ref, hyp, scores):
    """Steps by the full matrix, ties pair, deletion, insertion."""
    match, sub, gap = scores
    r, h = A._numbers(ref, hyp)
    rows = [gap * np.arange(len(h) + 1)]
    for x in r:
        row = [rows[-1][0] + gap]
        for j in range(len(h)):
            row.append(max(rows[-1][j] + (match if h[j] == x else sub), rows[-1][j + 1] + gap, row[-1] + gap))
        rows.append(np.array(row))
    out, i, j = [], len(r), len(h)
    while i or j:
        if i and j and rows[i][j] == rows[i - 1][j - 1] + (match if r[i - 1] == h[j - 1] else sub):
            out, i, j = [0, *out], i - 1, j - 1
        elif i and rows[i][j] == rows[i - 1][j] + gap:
            out, i = [1, *out], i - 1
        else:
            out, j = [2, *out], j - 1
    return int(rows[-1][-1]), out


def test_bands_give_the_path_of_the_full_matrix(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(A, "CELLS", 0)
    for scores in (A.SCORE, A.EDIT):
        for _ in range(120):
            ref, hyp = changed(rng, rng.randrange(70), rng.choice([2, 6, 60]), rng.choice([0.05, 0.3, 0.95]))
            hyp = hyp[: rng.randrange(4)] if rng.random() < 0.1 else hyp
            for width in (0, 1, 3, 9, 80):  # a band that says it is certain has the best path
                band = A.Band(*A._numbers(ref, hyp), scores, width)
                if band.certain():
                    assert (band.score, band.path().tolist()) == matrix(ref, hyp, scores)
            assert A.best_band(*A._numbers(ref, hyp), scores).path().tolist() == matrix(ref, hyp, scores)[1]


def test_long_pairs_are_aligned_in_little_memory():
    rng = random.Random(6)
    ref, hyp = changed(rng, 12_000, 4000, 0.2)
    r, h = A._numbers(ref, hyp)
    tracemalloc.start()
    band = A.best_band(r, h, A.SCORE)
    steps = band.path()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30e6  # the matrix has 144 million cells
    at = np.cumsum([steps != 2, steps != 1], axis=1)
    pair = steps == 0
    same = r[at[0][pair] - 1] == h[at[1][pair] - 1]
    assert band.score == 8 * same.sum() - 4 * (~same).sum() - 3 * (~pair).sum()
    row = -3 * np.arange(len(h) + 1)  # the score of the full matrix, row by row
    for x in r:
        best = np.maximum(row[:-1] + np.where(h == x, 8, -4), row[1:] - 3)
        row = np.maximum.accumulate(np.append(row[0] - 3, best) + 3 * np.arange(len(h) + 1)) - 3 * np.arange(len(h) + 1)
    assert band.score == row[-1]


def test_anchored_parts_join_to_the_whole(spark):
    rng = random.Random(7)
    data = [(1, *changed(rng, 900, 300, 0.1)), (2, ["a"] * 50, ["a"] * 40), (3, [], ["b"]), (4, None, ["b"]), (5, *changed(rng, 400, 300, 0.1))]
    data.append((6, data[0][1], data[0][1][450:] + data[0][1][:450]))  # halves swapped: only one can be the chain
    df = spark.createDataFrame(data, "k int, ref array<string>, hyp array<string>")
    parts = {}
    for x in A.anchored(df, ["k"], "ref", "hyp", least=100).orderBy("k", "part").collect():
        parts.setdefault(x["k"], []).append((x["part"], x["ref"], x["hyp"]))
    score = lambda a, b: matrix(a, b, A.SCORE)[0]
    for k, ref, hyp in data:
        assert [p for p, _, _ in parts[k]] == [*range(len(parts[k]))]
        if ref is None:
            assert parts[k] == [(0, None, hyp)]
            continue
        assert [w for _, r, _ in parts[k] for w in r] == ref and [w for _, _, h in parts[k] for w in h] == hyp
        if k in (1, 5):
            assert len(parts[k]) > 2 and sum(score(r, h) for _, r, h in parts[k]) == A.best_band(*A._numbers(ref, hyp), A.SCORE).score
    assert len(parts[6]) > 2 and len(parts[2]) == 1


def test_anchored_rates_of_documents_equal_whole_alignments(spark):
    from voxquarry.plans.alignment import anchored_error_rates, recordings

    got = {x["doc_id"]: (x["m"], x["s"], x["i"], x["d"]) for x in anchored_error_rates(spark, DATA).collect()}
    same = 0
    for x in recordings(spark, DATA).where("size(ref) > 0").collect():
        pairs = A.align_pairs(x["ref"], x["hyp"])
        m, s, i, d = got[x["doc_id"]]
        assert m + s + d == len(x["ref"]) and m + s + i == len(x["hyp"])
        whole = (sum(r == h for r, h in pairs), sum(None not in (r, h) and r != h for r, h in pairs), sum(r is None for r, _ in pairs), sum(h is None for _, h in pairs))
        assert 8 * m - 4 * s - 3 * (i + d) <= 8 * whole[0] - 4 * whole[1] - 3 * (whole[2] + whole[3])
        same += (m, s, i, d) == whole
    assert same >= 0.95 * len(got)


def test_attribution_sums_to_totals(spark):
    rng = random.Random(3)
    data = [(k, [rng.choice("abcde") for _ in range(20)], [rng.choice("abcde") for _ in range(rng.randint(0, 25))]) for k in range(8)]
    df = spark.createDataFrame(data, "k int, ref array<string>, hyp array<string>")
    pairs = A.explode_pairs(df.withColumn("pairs", A.aligned(F.col("ref"), F.col("hyp"))), ["k"])
    utt = spark.createDataFrame([(k, i, i // 4) for k in range(8) for i in range(20)], "k int, ref_pos int, utt int")
    by_utt = A.attribute(pairs, ["k"], utt).groupBy("k").agg(*[F.sum(c).alias(c) for c in "msid"])
    all_ = A.totals(A.apply_allow_lists(A.spans(pairs, ["k"])), ["k"]).select("k", *"msid")
    assert sorted(map(tuple, by_utt.select("k", *"msid").collect())) == sorted(map(tuple, all_.collect()))


def test_identity_has_no_errors(spark):
    assert totals(spark, "a b c", "a b c").wer == 0.0


def test_cer_of_empty_reference(spark):
    df = spark.createDataFrame([("", ""), ("", "x"), ("abcd", "abxd")], "r string, h string")
    assert [x[0] for x in df.select(A.cer(F.col("r"), F.col("h"))).collect()] == [0.0, 1.0, 0.25]


def test_segment_projection(spark):
    pairs = spark.createDataFrame([(1, 0, "a", "a"), (1, 1, "b", None), (1, 2, "c", "c"), (1, 3, None, "x"), (1, 4, "d", "e")], "k int, pos int, ref string, hyp string")
    seg = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 2, 3)], "k int, seg int, first_hyp int, last_hyp int")
    assert sorted(map(tuple, A.project_segments(pairs, seg, ["k"]).collect())) == [(1, 0, 0, 2), (1, 1, 3, 3)]


def test_batches_of_alignments_hold_no_objects_for_their_pairs():
    import pyarrow as pa

    rng = random.Random(11)
    kind = pa.list_(pa.string())
    data = [changed(rng, 60, 40, 0.2) for _ in range(400)] + [(None, ["a"]), (["a"], None), ([], []), ([], ["b"]), (["c", "d"], []), (["x", None, "y"], ["y"])]
    ref, hyp = (pa.array([["skipped"], *x], kind).slice(1) for x in zip(*data, strict=True))
    for udf, f in ((A._score_udf, A.align_pairs), (A._legacy_udf, lambda a, b: A.align_pairs(a, b, True)), (A._edit_udf, A.edit_pairs)):
        tracemalloc.start()
        out = udf.func(ref, hyp)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert [None if x is None else [(p["ref"], p["hyp"]) for p in x] for x in out.to_pylist()] == [None if None in (a, b) else f(a, b) for a, b in data]
        assert peak < 60 * len(out.values)


def test_anchored_rates_move_each_word_once(spark):
    from voxquarry.plans.alignment import anchored_error_rates

    plan = anchored_error_rates(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Window" not in plan  # the parts, and sums by document


def test_pair_totals_equal_totals_of_spans(spark):
    rng = random.Random(9)
    data = [(k % 5, k, *changed(rng, 20, 6, 0.3)) for k in range(20)] + [(6, 21, [], []), (7, 22, None, ["a"]), (8, 23, [], ["b"])]
    df = spark.createDataFrame(data, "k int, t int, ref array<string>, hyp array<string>").withColumn("pairs", A.aligned(F.col("ref"), F.col("hyp")))
    want = A.totals(A.apply_allow_lists(A.spans(A.explode_pairs(df, ["k", "t"]), ["k", "t"])), ["k"])
    got = A.pair_totals(df, ["k"])
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_distances_leave_out_common_ends(monkeypatch):
    import pandas as pd

    rng = random.Random(4)
    data = [changed(rng, 12, 4, 0.3) for _ in range(50)] + [([], []), (["a"], []), (["a", "a"], ["a"]), (["a", "b"], ["b", "a"])]
    want = [sum(r != h for r, h in A.edit_pairs(a, b)) for a, b in data]
    ref, hyp = (pd.Series(list(x)) for x in zip(*data, strict=True))
    assert A.word_distance.func(ref, hyp).tolist() == want
    monkeypatch.setattr(A, "best_band", None)  # nothing is left to align
    assert A.word_distance.func(pd.Series([list("abc")]), pd.Series([list("abcx")])).tolist() == [1]


def test_pairs_are_aligned_once(spark):
    from voxquarry.plans.alignment import anchored_error_rates, score_pairs

    plan = lambda t: t._jdf.queryExecution().executedPlan().toString()
    assert plan(anchored_error_rates(spark, DATA)).count("ArrowEvalPython") == 2  # cuts and counts, with no copy below a filter
    assert plan(score_pairs(spark, DATA)).count("ArrowEvalPython") == 1


def test_pairs_aligned_together_have_the_paths_of_full_matrices(monkeypatch):
    import pyarrow as pa

    rng = random.Random(12)
    data = [changed(rng, rng.choice([0, 1, 2, 9, 40]), rng.choice([2, 6, 60]), rng.choice([0.05, 0.3, 0.95])) for _ in range(80)]
    data += [(a, changed(rng, rng.randrange(60), 6, 0.3)[1]) for a, _ in data[:20]] + [(["a"] * 30 + ["b"] * 30, ["b"] * 30 + ["a"] * 30)]
    ref, hyp = (pa.array([[], *x, None, ["a"]], pa.list_(pa.string())).slice(1) for x in zip(*data, strict=True))
    for scores in (A.SCORE, A.EDIT):
        want = [matrix(r, h, scores)[1] for r, h in data]
        for together, alone in ((1 << 19, 1 << 24), (3000, 1 << 24), (0, 200)):  # all at once, few at once, long ones by kept rows
            monkeypatch.setattr(A, "TOGETHER", together)
            monkeypatch.setattr(A, "ALONE", alone)
            ok, _, _, steps, length = A._batch(ref, hyp, scores)
            assert ok.tolist() == [True] * len(data) + [False, True]
            assert [x.tolist() for x in np.split(steps, np.cumsum(length)[:-1])] == [*want, [0]]
            counts = A._counted(scores).func(ref, hyp).to_pylist()
            assert counts[-2:] == [None, {"m": 1, "s": 0, "i": 0, "d": 0}]
            for (r, h), c, steps in zip(data, counts[:-2], want, strict=True):
                assert (c["m"] + c["s"], c["i"], c["d"]) == (steps.count(0), steps.count(2), steps.count(1))
                pairs = A.align_pairs(r, h, scores=scores)
                assert c["m"] == sum(a == b for a, b in pairs)


def test_anchored_numbers_stand_for_the_words(spark, monkeypatch):
    rng = random.Random(13)
    data = [(k, *changed(rng, rng.choice([0, 5, 700]), 300, 0.1)) for k in range(12)] + [(12, None, ["b"]), (13, ["b"], None), (14, [], [])]
    df = spark.createDataFrame(data, "k int, ref array<string>, hyp array<string>").coalesce(1)
    parts = lambda **how: {(x["k"], x["part"]): (x["ref"], x["hyp"]) for x in A.anchored(df, ["k"], "ref", "hyp", least=100, **how).collect()}
    words, numbers = parts(), parts(numbers=True)
    assert words.keys() == numbers.keys() and len(words) > 30
    meant: dict = {}
    for (k, part), sides in words.items():
        for w, n in zip(sides, numbers[k, part], strict=True):
            assert (w is None) == (n is None) and (w is None or len(w) == len(n))
            for a, b in zip(w or [], n or [], strict=True):
                assert meant.setdefault((k, "word", a), b) == b and meant.setdefault((k, "number", b), a) == a
    want = A.pair_totals(A.anchored(df, ["k"], "ref", "hyp", least=100), ["k"]).orderBy("k").collect()
    assert A.pair_totals(A.anchored(df, ["k"], "ref", "hyp", least=100, numbers=True), ["k"]).orderBy("k").collect() == want


def test_batches_are_worked_on_by_pieces(monkeypatch):
    import pyarrow as pa

    rng = random.Random(14)
    kind = pa.list_(pa.string())
    data = [changed(rng, rng.choice([0, 0, 3, 30, 90]), 9, 0.3) for _ in range(50)]
    ref, hyp = (pa.array([["skipped"], *x, None], kind).slice(1) for x in zip(*data, strict=True))
    for f in (A._udf(A.SCORE), A._udf(A.SCORE, True), A._counted(A.EDIT)):
        want = f.func(ref, hyp)
        for piece in (1, 50, 400):
            monkeypatch.setattr(A, "PIECE", piece)
            assert f.func(ref, hyp).equals(want)
            assert len(f.func(ref[:0], hyp[:0])) == 0
        monkeypatch.undo()

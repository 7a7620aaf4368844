import itertools
import random
import tracemalloc

import numpy as np
from voxquarry.operators import multitalker as M


def test_best_assignment():
    refs = [["a", "b"], ["c"], ["d", "e"]]
    assert M.best_assignment(refs, [["a", "b", "d", "e"], ["c"]]) == (0, [0, 1, 0])
    assert M.best_assignment([["a"]], []) == (1, [0])
    many = [[f"w{i}"] for i in range(14)]
    errors, who = M.best_assignment(many, [[f"w{i}" for i in range(0, 14, 2)], [f"w{i}" for i in range(1, 14, 2)]])
    assert len(who) == 14 and errors <= 14


def brute(refs, channels):
    """All assignments, each channel by plain edit distance; the first of equals."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    tries = []
    for who in itertools.product(range(len(channels)), repeat=len(refs)):
        said = [[w for r, k in zip(refs, who, strict=True) if k == c for w in r] for c in range(len(channels))]
        tries.append((sum(map(edits, said, channels)), list(who)))
    return min(tries)


def test_assignment_equals_all_assignments():
    rng = random.Random(15)
    for trial in range(150):
        n = 1 + trial % 3
        refs = [[rng.choice("abcd") for _ in range(rng.randrange(4))] for _ in range(rng.randrange(6))]
        channels = [[rng.choice("abcd") for _ in range(rng.randrange(7))] for _ in range(n)]
        if trial % 2:
            for r in refs:
                channels[rng.randrange(n)] += [w for w in r if rng.random() < 0.8]
        assert M.best_assignment(refs, channels) == brute(refs, channels), (refs, channels)


def test_few_utterances_are_tried_instead_of_wide_boxes(monkeypatch):
    rng, cells, read = random.Random(17), [0], M._Reader.read

    def counted(self, box, u, axis):
        cells[0] += box[1].size * len(self.refs[u]) if box else 0
        return read(self, box, u, axis)

    monkeypatch.setattr(M._Reader, "read", counted)
    for n in (3, 4, 5):
        refs = [[f"w{rng.randrange(30)}" for _ in range(50)] for _ in range(n)]
        channels = [[f"w{rng.randrange(30)}" for _ in range(rng.randrange(120, 150))] for _ in range(2)]
        assert M.best_assignment(refs, channels) == brute(refs, channels)
    assert cells[0] < 2_000_000, cells


def test_tried_subsets_equal_all_assignments():
    rng = random.Random(18)
    for _ in range(150):
        refs = [[rng.choice("abcd") for _ in range(rng.randrange(4))] for _ in range(rng.randrange(6))]
        channels = [[rng.choice("abcd") for _ in range(rng.randrange(8))] for _ in range(2)]
        assert M._tried(refs, channels) == brute(refs, channels), (refs, channels)


def test_query_equals_all_assignments(spark):
    from helpers import DATA

    from voxquarry.plans.extra import multi_talker_wer

    turns = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"].lower().split()))
    got = {r["conv_id"]: r for r in multi_talker_wer(spark, DATA).collect()}
    assert set(got) == set(turns)
    for k, t in turns.items():
        refs = [w for _, role, w in t if role == "user"]
        channels = [[x for n, role, w in t if role != "user" and (n % 4 == 1) == odd for x in w] for odd in (True, False)]
        errors, who = brute(refs, channels)
        assert (got[k]["errors"], got[k]["words"], got[k]["assignment"]) == (errors, sum(map(len, refs)), " ".join(map(str, who)))


def test_long_sessions_in_little_memory():
    rng = random.Random(16)
    refs = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 15))] for _ in range(300)]
    who = [rng.randrange(2) for _ in refs]
    channels = [[], []]
    for r, k in zip(refs, who, strict=True):
        channels[k] += [w if rng.random() > 0.01 else "x" for w in r]
    tracemalloc.start()
    errors, got = M.best_assignment(refs, channels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert errors <= sum(c.count("x") for c in channels) and sum(a == b for a, b in zip(got, who, strict=True)) > 290
    assert most < 50e6


def test_delay_without_correct_words(spark):
    df = spark.createDataFrame([(1, "a", "b", 1.0, 2.0), (2, "a", "a", 1.0, 1.5), (2, "b", "b", 2.0, 3.5)], "k int, ref string, hyp string, r double, h double")
    got = {r.k: (r.n, r["mean"], r["var"]) for r in M.symbol_delay(df, ["k"], "r", "h").collect()}
    assert got == {1: (0, float("inf"), float("inf")), 2: (2, 1.0, 0.25)}


def test_mel_filters():
    f = M.mel_filters(20, 512, 16000, 60, 7600)
    assert f.shape == (20, 257) and (f >= 0).all() and (f.max(1) > 0.4).all() and (np.diff(f.argmax(1)) >= 0).all()

import pytest
import math
import os
import re

import numpy as np
from pyspark.sql import functions as F

from voxquarry.operators import ngram_lm as L
from voxquarry.sources import audio, manifests, stm, text


def test_segment_lines(spark, tmp_path):
    p = tmp_path / "a.STM"
    p.write_text("﻿r1 1 s 0.00 1.50 <NA> hello  there\n;; comment\nr1 1 s 1.50\nr1 1 s 1.50 2.00 <NA> x\n\n")
    got = stm.read(spark, str(tmp_path)).orderBy("start").collect()
    assert [(r.recording_id, r.start, r.end, r.text) for r in got] == [("r1", 0.0, 1.5, "hello  there"), ("r1", 1.5, 2.0, "x")]
    assert stm.read(spark, str(tmp_path), "rejoin").orderBy("start").first().text == "hello there"
    stm.write(stm.read(spark, str(tmp_path)), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).where("value LIKE 'r1 1 r1 1.50 2.00 <NA> x'").count() == 1
    sup = manifests.supervisions(stm.read(spark, str(tmp_path / "a.STM")), "ms")
    manifests.write(sup, str(tmp_path / "sup"))
    assert sorted(r.id for r in manifests.read(spark, str(tmp_path / "sup")).collect()) == ["r1-1", "r1-2"]


def test_recogniser_lines(spark):
    df = spark.createDataFrame([("[0.00 1.25] hi",), ("junk",)], "value string")
    assert [tuple(r) for r in stm.recogniser_lines(df).select("start", "end", "text").collect()] == [(0.0, 1.25, "hi")]


def test_json_blocks_and_pairs(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"id": 1,\n "t": "x"}\n\n{"id": 2, "t": "y"}\n')
    assert sorted(r.id for r in text.read_json_blocks(spark, str(tmp_path / "b.json"), "id int, t string").collect()) == [1, 2]
    (tmp_path / "p.txt").write_text("a,b,c\n\nd,e\n")
    assert sorted(map(tuple, text.read_pairs(spark, str(tmp_path / "p.txt")).collect())) == [("a", "b,c"), ("d", "e")]


def test_natural_order(spark):
    df = spark.createDataFrame([("w10.txt",), ("w9.txt",), ("w9a.txt",)], "path string")
    assert [r.path for r in df.orderBy(text.natural_key(F.col("path"))).collect()] == ["w9.txt", "w9a.txt", "w10.txt"]
    n = spark.createDataFrame([("/x/10.txt",), ("/x/9.txt",), ("/x/b.txt",)], "path string")
    assert [r.path for r in text.in_numeric_order(n).orderBy("seq").collect()] == ["/x/9.txt", "/x/10.txt", "/x/b.txt"]


def test_resumable_sink(spark, tmp_path):
    df = spark.range(5)
    text.write_new(df.where("id < 3"), str(tmp_path / "s"), "id")
    text.write_new(df, str(tmp_path / "s"), "id")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [0, 1, 2, 3, 4]


def test_arpa_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(["a", "b", "a"],), (["a", "c"],), (["b"],)], "w array<string>")
    m = L.estimate(df, "w", 2)
    manifests.write_arpa(m, str(tmp_path / "lm"))
    back = {(r.n, r.hist, r.word): (round(r.f, 5), None if r.bow is None else round(r.bow, 5)) for r in manifests.read_arpa(spark, str(tmp_path / "lm")).collect()}
    want = {(r.n, r.hist, r.word): (round(r.f, 5), None if r.bow is None else round(r.bow, 5)) for r in m.collect()}
    assert back == want


def test_model_is_sound_and_prunes(spark):
    df = spark.createDataFrame([("a b a c".split(),), ("a c b".split(),), ("b a".split(),), ("a b b d".split(),)], "w array<string>")
    m = L.estimate(df, "w", 2).cache()
    assert all(abs(r.total - 1) < 1e-9 for r in L.mass(m, 2).collect())
    p = L.prune(m, 2, 0.05)
    assert p.where("n = 2").count() < m.where("n = 2").count() and p.where("n = 1").count() == m.where("n = 1").count()
    assert L.prune(m, 2, 0.0).count() == m.count()
    unseen = spark.createDataFrame([("c", "d"), ("a", "zzz")], "hist string, word string")
    got = {(r.hist, r.word): r.log_p for r in L.score(m, unseen, 2).collect()}
    assert got["c", "d"] is not None and got["a", "zzz"] is None


def test_audio(spark, tmp_path):
    x = (np.sin(np.arange(8000) / 20) * 9000).astype(np.int16)
    (tmp_path / "a.wav").write_bytes(audio.encode(x, 8000))
    r = audio.read_audio(spark, str(tmp_path), 16000).first()
    assert abs(r.duration - 1.0) < 1e-3 and len(r.pcm) == 32000
    q = audio.probe(spark, str(tmp_path), 8000).first()
    assert q.duration == 1.0 and q.samples == 8000
    assert (audio.decode(audio.encode(x, 8000), 8000) - x).max() <= 1
    both = audio.concatenate(audio.read_audio(spark, str(tmp_path)).withColumn("k", F.lit(1)).withColumn("i", F.explode(F.array(F.lit(1), F.lit(2)))), ["k"], "i").first()
    assert len(both.pcm) == 64000


def test_htk(spark, tmp_path):
    x = np.arange(12, dtype=float).reshape(4, 3)
    (tmp_path / "f.htk").write_bytes(audio.write_htk(x))
    assert np.allclose(audio.read_htk(audio.write_htk(x))[0], x)
    assert audio.read_features(spark, str(tmp_path / "f.htk")).count() == 4


def test_lexicon_and_grids(spark, tmp_path):
    (tmp_path / "lex.txt").write_text("foo f o o\nbar b a r\n")
    assert {r.word: r.tokens for r in manifests.read_lexicon(spark, str(tmp_path / "lex.txt")).collect()} == {"foo": ["f", "o", "o"], "bar": ["b", "a", "r"]}
    (tmp_path / "g.csv").write_text("id,snr,wer\na,inf,0.5\nb,,\n")
    rows = {r.id: (r.snr, r.wer) for r in manifests.read_grid(spark, str(tmp_path / "g.csv")).collect()}
    assert rows == {"a": (float("inf"), 0.5), "b": (None, None)}
    (tmp_path / "m.tsv").write_text("x\ta\tb\nr1\t1\t2\n")
    assert sorted(map(tuple, manifests.read_matrix(spark, str(tmp_path / "m.tsv")).collect())) == [("r1", "a", 1.0), ("r1", "b", 2.0)]
    assert os.path.exists(tmp_path)


def test_disambiguation(spark):
    from voxquarry.operators.vocab import disambiguate

    lex = [("foo", "f o o"), ("food", "f o o d"), ("food2", "f o o d"), ("bar", "b a r"), ("fo", "f o")]
    df = spark.createDataFrame([(w, t.split(), i) for i, (w, t) in enumerate(lex)], "word string, tokens array<string>, line_no int")
    assert {r.word: r.tag for r in disambiguate(df).collect()} == {"foo": "#1", "food": "#1", "food2": "#2", "bar": None, "fo": "#1"}


@pytest.mark.parametrize(("own", "rate"), [(8000, 16000), (44100, 16000), (16000, 8000), (48000, 16000)])
def test_resampling(own, rate):
    """Tones below both Nyquist frequencies stay, others go; short signals equal filtering on the common grid."""
    n = own // 2
    t = np.arange(n) / own
    for f in (300, 1500, 3000):
        y = audio.resample(np.sin(2 * np.pi * f * t), own, rate)
        want = np.sin(2 * np.pi * f * np.arange(len(y)) / rate)
        assert len(y) == -(-n * rate // own) and np.abs(y - want)[rate // 50 : -rate // 50].max() < 0.01
    if own > rate:
        y = audio.resample(np.sin(2 * np.pi * 0.75 * rate * t), own, rate)
        assert np.abs(y[rate // 50 : -rate // 50]).max() < 0.01
    g = math.gcd(own, rate)
    up, down, x = rate // g, own // g, np.random.default_rng(1).normal(size=57)
    half = 10 * max(up, down)
    k = np.arange(-half, half + 1)
    taps = np.sinc(k / max(up, down)) * np.kaiser(2 * half + 1, 5.0)
    wide = np.zeros(57 * up)
    wide[::up] = x
    whole = np.convolve(wide, taps * up / taps.sum())[half : half + 57 * up][::down]
    assert np.allclose(audio.resample(x, own, rate), whole)
    assert len(audio.resample(np.zeros(0), own, rate)) == 0


def test_stereo_is_averaged():
    x = np.stack([np.full(800, 1000), np.full(800, 3000)], 1)
    assert (audio.decode(audio.encode(x, 16000)) == 2000).all()
    y = audio.decode(audio.encode(x, 8000))
    assert len(y) == 1600 and np.abs(y[200:-200] - 2000).max() <= 10


def test_counts_equal_plain_counting_and_models_broadcast_nothing(spark):
    import random
    from collections import Counter, defaultdict

    rng = random.Random(5)
    data = [["<s>" if rng.random() < 0.05 else rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in data], "w array<string>")
    for order in (1, 2, 3, 4):
        c, x = Counter(), defaultdict(set)
        for w in data:
            w = [L.BOS, *w, L.EOS]
            for n in range(1, order + 1):
                for i in range(len(w) - n + 1):
                    g = (n, " ".join(w[i : i + n - 1]), w[i + n - 1])
                    c[g] += 1
                    if n < order and i:
                        x[g].add(w[i - 1])
        got = {(r.n, r.hist, r.word): (r.c, r.n_ctx) for r in L.counts(df, "w", order).collect()}
        assert got == {g: (k, len(x[g])) for g, k in c.items()}
    m = L.estimate(df, "w", 3)
    scored = L.sentence_scores(m, df.withColumn("k", F.monotonically_increasing_id()), ["k"], "w", 3)
    pruned = L.prune(L.estimate(df, "w", 2), 2, 1e-6)
    for t in (m, L.mass(m, 3), scored, pruned):  # only the discounts, a row for each order, may be broadcast
        plan = t._jdf.queryExecution().executedPlan().toString()
        joins = re.findall(r"BroadcastHashJoin \[(.*?)\]", plan)
        assert plan.count("SortMergeJoin") and all(re.fullmatch(r"n#\d+", j) for j in joins), joins

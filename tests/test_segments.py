import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxquarry.operators import grid, relational, sampling, vad
from voxquarry.operators import segments as S


def test_batches_by_length(spark):
    df = spark.createDataFrame([(0, 0, 5), (0, 1, 3), (0, 2, 3), (0, 3, 3), (0, 4, 2), (0, 5, 1)], "k int, i int, n int")
    got = [r.batch for r in S.batches_by_length(df, ["k"], "i", "n", 4, 3).orderBy("i").collect()]
    assert got == [0, 0, 0, 1, 1, 1]


def test_split_long_cuts_at_quiet_frames():
    e = np.full(1000, 10.0)
    e[420] = 0.0
    parts = S.split_long(0.0, 40.0, e, 25.0, 30.0)
    assert parts == [(0.0, 16.8), (16.8, 40.0)]
    flat = S.split_long(0.0, 100.0, np.ones(2500), 25.0, 30.0)
    assert flat[0][0] == 0.0 and flat[-1][1] == 100.0 and all(b - a <= 30 for a, b in flat)


def test_levels_split_as_one_by_one(spark):
    rng = np.random.default_rng(14)
    energies = {k: np.round(rng.choice([1.0, 5.0, 9.0], n) + rng.normal(0, 0.4, n), 2) for k, n in enumerate([10, 700, 1500, 4000, 64, 65])}
    energies[6] = np.ones(900)
    segs = [(k, 0.0, len(e) / 10) for k, e in energies.items()] + [(2, 20.5, 99.9), (3, 0.0, 500.0), (9, 0.0, 77.0), (1, 60.0, 60.1)]
    df = spark.createDataFrame([(k, i, float(x)) for k, e in energies.items() for i, x in enumerate(e)], "k int, i long, e double").repartition(4)
    got = S.split_levels(spark.createDataFrame(segs, "k int, a double, z double"), S.energy_tiles(df, "k", "i", "e"), "k", "a", "z", 10.0)
    want = [(k, *p) for k, a, z in segs for p in (S.split_long(a, z, energies[k], 10.0) if k in energies else [(a, z)])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_sampler(spark):
    rng = np.random.default_rng(17)
    data = [(i, float(x)) for i, x in enumerate(np.round(rng.gamma(2, 5, 500), 1))] + [(500, None), (501, 999.0)]
    df = spark.createDataFrame(data, "id long, s double")
    edges = S.quantile_edges(df, "s", 8)
    assert len(edges) == 7 and edges == sorted(edges)
    whole = {r["id"]: r for r in S.sampled_batches(df, "id", "s", edges, 100.0, 2, drop_last=False).collect()}
    assert set(whole) == {i for i, x in data if x is not None}
    assert all(r["bucket"] == sum(data[i][1] > e for e in edges) for i, r in whole.items())
    sizes = {}
    for i, r in whole.items():
        sizes.setdefault((r["bucket"], r["shard"], r["batch"]), []).append(data[i][1])
    assert all(sum(v) <= 100 or len(v) == 1 for v in sizes.values())
    last = {}
    for b, s, k in sizes:
        last[b, s] = max(k, last.get((b, s), 0))
    kept = S.sampled_batches(df, "id", "s", edges, 100.0, 2).collect()
    assert {r["id"] for r in kept} == {i for i, r in whole.items() if r["batch"] < last[r["bucket"], r["shard"]]}
    assert S.quantile_edges(df.where("false"), "s", 4) == []


def test_hysteresis():
    x = np.array([0, 0.6, 0.9, 0.4, 0.9, 0.1, 0.4, 0.1, 0.1, 0.9])
    assert S.hysteresis(x, 0.5, 0.3, 2, 3) == [(1, 5)]
    assert S.hysteresis(np.ones(4), 0.5, 0.3, 2, 3) == [(0, 4)]


def test_core_gaps(spark):
    ch = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0), (1, 1, 4.0, 1.0, 6.0), (1, 2, 12.0, 0.0, 3.0)], "k int, chunk int, offset double, left double, right double")
    assert [r.chunk for r in S.core_gaps(ch, "k").collect()] == [2]


def test_coverage(spark):
    a = spark.createDataFrame([(1, 0, 10), (1, 5, 12)], "k int, start int, end int")
    b = spark.createDataFrame([(1, 2, 6), (1, 11, 15)], "k int, start int, end int")
    assert tuple(relational.coverage(a, b, "k").first()) == (1, 12, 5, 3)


def plain_activity(channels, s):
    """Probability, power and background of every frame of one recording's channels, frame by frame."""
    bands = len(channels[0][0])
    est = [[0.0, 1.0, 0.0, 1.0, []] for _ in range(bands)]  # active mean and variance, inactive ones, shares of updates
    out = []
    for frames in channels:
        rows = []
        for t, x in enumerate(frames):
            if t % s.interval == 0 and t + 10 < len(frames):
                for b in range(bands):
                    v = [f[b] for f in frames[t : t + s.interval]]
                    lo, hi = min(v), max(v)
                    for _ in range(3):
                        up, down = [y for y in v if abs(y - hi) < abs(y - lo)], [y for y in v if not abs(y - hi) < abs(y - lo)]
                        hi, lo = sum(up) / len(up) if up else hi, sum(down) / len(down) if down else lo
                    on, on_var, off, off_var, shares = est[b]
                    share = 10 ** (0.1 * ((hi - lo) - (on - off))) if shares and hi - lo < on - off else 1.0
                    if len(shares) == 1 or (len(shares) > 1 and (sum(shares) - 1) / (len(shares) - 1) < 0.5):
                        share = max(share, 0.5)
                    spread = lambda w, mean, old, share=share: max(sum(y * y for y in w) / len(w) - mean**2, 0.5) if w else (1 - share) * old + share * 0.5
                    est[b] = [(1 - share) * on + share * hi, spread(up, hi, on_var), (1 - share) * off + share * lo, spread(down, lo, off_var), [*shares, share]]
            x = [s.smooth * p + (1 - s.smooth) * c for p, c in zip(frames[t - 1], x, strict=True)] if t else x
            p = []
            for y, (on, on_var, off, off_var, _) in zip(x, est, strict=True):
                bell = lambda m, v, y=y: math.exp(-((y - m) ** 2) / (2 * v))
                p.append(0.0 if y < off else 1.0 if y < on else 0.5 * (bell(on, on_var) + 1 - bell(off, off_var)))
            whole = p[0] if bands == 1 else (p[0] * (sum(p[1:]) / (bands - 1)) ** 2) ** 0.3333333
            rows.append([whole, x[0], est[0][2]])
        out.append(rows)
    for t in range(max(map(len, out))):
        loudest = max(rows[t][1] for rows in out if t < len(rows))
        for rows in out:
            if t < len(rows):
                rows[t][0] *= 10 ** (0.1 * (rows[t][1] - loudest))
    return out


def test_activity_carries_over_channels(spark):
    rng = np.random.default_rng(11)
    s = vad.Settings(interval=40)
    data, want = [], {}
    for rec in range(4):
        channels = [[(20 + 30 * (t // 25 % 2) + rng.normal(0, 3 + 4 * c, 3)).round(3).tolist() for t in range(n)] for c, n in enumerate([(170, 170), (91, 91), (5, 60), (85, 50)][rec])]
        for c, rows in enumerate(plain_activity(channels, s)):
            data += [(rec, c, t, x) for t, x in enumerate(channels[c])]
            want |= {(rec, c, t): r for t, r in enumerate(rows)}
    df = spark.createDataFrame(data, "rec int, ch int, fr long, x array<double>").repartition(5)
    got = vad.probabilities(df, "rec", "ch", "fr", "x", s).collect()
    assert len(got) == len(want)
    for r in got:
        assert np.allclose([r["prob"], r["power"], r["background"]], want[r["rec"], r["ch"], r["fr"]], rtol=1e-9, atol=1e-12)


def test_runs_give_the_hysteresis_of_the_walk(spark):
    rng = np.random.default_rng(12)
    data = [(k, i, float(x)) for k in range(60) for i, x in enumerate(rng.choice([0.0, 0.2, 0.4, 0.45, 0.6, 0.9], rng.integers(1, 60)))]
    df = spark.createDataFrame(data, "k int, i long, x double")
    for enter, leave in ((1, 1), (2, 3), (4, 2)):
        got = sorted(map(tuple, vad.hysteresis_runs(df, ["k"], "i", "x", 0.5, 0.3, enter, leave).collect()))
        assert got == sorted((k, *z) for k in range(60) for z in S.hysteresis(np.array([x for q, _, x in data if q == k]), 0.5, 0.3, enter, leave))


def test_vad_finds_the_loud_part(spark):
    power = [10.0] * 200 + [60.0] * 100 + [10.0] * 200
    rng = np.random.default_rng(13)
    data = [(1, c, i, [p + float(e) * 0.1 - 20 * c]) for c in (0, 1) for i, (p, e) in enumerate(zip(power, rng.normal(size=500), strict=True))]
    df = spark.createDataFrame(data, "rec int, ch int, frame long, bands array<double>")
    got = vad.segment(df, "rec", "ch", "frame", "bands", vad.Settings(interval=500)).collect()
    assert {r["ch"] for r in got} == {0}  # the other channel is 20 dB below
    assert any(r["start"] <= 2 and r["end"] >= 3 and 0 < r["confidence"] <= 1 for r in got) and all(r["start"] < r["end"] for r in got)
    assert vad.segment(df.where("false"), "rec", "ch", "frame", "bands").collect() == []


def test_facts_of_joined_segments_are_weighed():
    s = vad.Settings(margin=5, longest=100, shortest=4)
    out = vad.final_segments(np.array([[10, 30], [35, 75], [300, 310]]), np.array([[1.0], [4.0], [9.0]]), 400, s)
    assert [(a, z, float(f[0])) for a, z, f in out] == [(5, 80, 3.0), (295, 315, 9.0)]
    assert [(a, z) for a, z, _ in vad.final_segments(np.array([[0, 500]]), np.zeros((1, 0)), 500, s)] == [(0, 125), (125, 250), (250, 375), (375, 500)]


def test_finalise_joins_and_cuts():
    s = vad.Settings(margin=5, longest=100, shortest=4)
    assert vad.finalise([(10, 30), (35, 60)], 200, s) == [(5, 65)]
    assert vad.finalise([(10, 80), (85, 130)], 200, s) == [(5, 82), (82, 135)]
    assert vad.finalise([(50, 52)], 200, s) == []


def test_draw_deviation_of_one_draw_is_zero(spark):
    df = spark.createDataFrame([("a", 1, 0, 9, 1, 0, 0)], "cell string, draw int, utt int, m int, s int, i int, d int")
    r = grid.draws(df, ["cell"], "draw").first()
    assert (r.k, r.mean, r.sd) == (1, 0.1, 0.0)


def test_bootstrap_weights_follow_numpy(spark):
    w = grid.bootstrap_weights(spark, 7, 5, 3)
    want = np.random.default_rng(3).multinomial(7, np.full(7, 1 / 7), 5)
    got = np.zeros((5, 7), int)
    for r in w.collect():
        got[r.rep, r.utt] = r.w
    assert (got == want).all()


def test_corruption_rates(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{j % 50}" for j in range(100))) for i in range(40)], "k int, text string")
    same = sampling.corrupt(df, ["k"], "text", 0, 0, 0)
    assert sorted(map(tuple, same.collect())) == sorted(map(tuple, df.collect()))
    n = sampling.corrupt(df, ["k"], "text", 0, 0.2, 0).select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert 3000 < n < 3400


def test_interval_join_is_half_open(spark):
    p = spark.createDataFrame([(1, 2.0), (1, 4.0)], "k int, at double")
    i = spark.createDataFrame([(1, 2.0, 4.0)], "k int, start double, end double")
    assert [r.at for r in relational.interval_join(p, i, "k", "at", "start", "end", 1.0).collect()] == [2.0]


def test_strict_join_fails(spark):
    import pytest

    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="no match"):
        relational.strict_join(a, b, ["k"]).collect()


def test_bootstraps_equal_numpy(spark):
    """Both levels in NumPy on dense tables, in the generator's order."""
    from helpers import DATA

    from voxquarry.plans import scoring

    t = scoring.counts(spark, DATA).toPandas()
    cells = sorted({tuple(x) for x in t[["rt60", "snr"]].to_numpy().tolist()})
    err, ref = t.s + t.i + t.d, t.m + t.s + t.d
    dense = lambda v, rows: np.bincount(t.utt[rows].astype(int), v[rows].astype(float), 101)
    w = np.random.default_rng(0).multinomial(101, np.full(101, 1 / 101), 1000)
    got = {(r["rt60"], r["snr"]): (r["lo"], r["hi"]) for r in scoring.numpy_bootstrap(spark, DATA).collect()}
    for c in cells:
        rows = ((t.rt60 == c[0]) & (t.snr == c[1])).to_numpy()
        wer = (w @ dense(err, rows)) / (w @ dense(ref, rows))
        assert np.allclose(got[c], np.quantile(wer, [0.025, 0.975]), rtol=1e-12)
    rng = np.random.default_rng(0)
    w = rng.multinomial(101, np.full(101, 1 / 101), 400)
    got = {(r["rt60"], r["snr"]): (r["lo"], r["hi"]) for r in scoring.two_level_bootstrap(spark, DATA).collect()}
    assert set(got) == set(cells)
    for c in cells:
        own = (t.rt60 == c[0]) & (t.snr == c[1])
        ks = sorted(t.draw[own].unique())
        e, n = (np.stack([w @ dense(v, (own & (t.draw == k)).to_numpy()) for k in ks], 1) for v in (err, ref))
        wd = rng.multinomial(len(ks), np.full(len(ks), 1 / len(ks)), 400)
        assert np.allclose(got[c], np.quantile((wd * e).sum(1) / (wd * n).sum(1), [0.025, 0.975]), rtol=1e-12)
    with pytest.raises(ValueError, match="more weights"):
        grid.bootstrap_weights(spark, 10**6, 1000, 0)

"""Line dedup, n-gram join, substring dedup, decontamination on small and odd tables."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from voxquarry.llm import arrays, components, decontaminate, line_dedup, ngram_join, substring_dedup

SCHEMA = "doc_id long, text string, n_lines string, score string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "extra", "x") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "   \n\t"), (None, "a b c d e f g"), (5, "x"), (5, "x"), (6, "é" * 50), (7, "word " * 30_000)]


# ---- arrays ------------------------------------------------------------------------------------------------------------


def test_words_never_cross_rows():
    for _, n, buf, offsets in arrays.chunks(pa.array(["ab c", None, "d", "", " e"])):
        s, e, c = arrays.words(buf, offsets)
        assert n == 5 and c.tolist() == [2, 0, 1, 0, 1] and [bytes(buf[i:j]) for i, j in zip(s, e, strict=True)] == [b"ab", b"c", b"d", b"e"]


def test_chunks_cover_all_rows_and_slices():
    t = pa.array([str(i) * 300 for i in range(5000)]).slice(7, 4000)
    seen = []
    for i, n, buf, offsets in arrays.chunks(t):
        seen += [bytes(buf[offsets[k] : offsets[k + 1]]).decode() for k in range(n)]
        assert len(seen) == i + n
    assert seen == t.to_pylist()


def test_hashes_tell_words_apart():
    w = ["a", "b", "ab", "ba", "a" * 64, "a" * 65, "a" * 128, "b" + "a" * 127]
    for _, _, buf, offsets in arrays.chunks(pa.array([" ".join(w)])):
        s, e, _ = arrays.words(buf, offsets)
        h = arrays.word_hashes(buf, s, e)
        assert len(set(h.tolist())) == len(w)


def test_short_rows_have_one_shingle():
    for _, _, buf, offsets in arrays.chunks(pa.array(["a b", "a b", "b a", "", "a b c d e", "A B C D E"])):
        r, h, sizes = arrays.shingle_sets(buf, offsets)
        d = list(zip(*(x.tolist() for x in arrays.set_digests(r, h, sizes)), strict=True))
        assert sizes.tolist() == [1, 1, 1, 0, 1, 1] and d[0] == d[1] != d[2] and d[4] == d[5]


# ---- components --------------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None), (None, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- line dedup --------------------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    line = "This Line Has More Than Forty Characters In It"
    rows = [(i, f"own {i}\n  {line.upper() if i % 2 else line}\t\nshort\n{line}") for i in range(5)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert [got[i].n_dropped for i in range(5)] == [2, 2, 2, 2, 0] and all(r.n_lines == 4 for r in got.values())
    assert got[0].text == "own 0\nshort" and got[4].text == rows[4][1] and got[0].score == "x"
    few = line_dedup.dedup_lines(table(spark, rows[:4])).collect()
    assert all(r.n_dropped == 0 for r in few)


def test_line_dedup_odd_rows(spark):
    got = line_dedup.dedup_lines(table(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r.text for r in got if r.doc_id in (1, 2)} == {""} and all(r.n_dropped == 0 for r in got)
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0
    line = "y" * 45
    same = [(None, line)] * 3 + [(i, line) for i in range(4)] + [(3, line)]  # null ids are one document, rows of an id too
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(table(spark, same)).collect()]
    assert collections.Counter(got) == {(None, ""): 3, (0, ""): 1, (1, ""): 1, (2, ""): 1, (3, line): 2}


def test_line_key_is_ascii_only(spark):
    rows = [(i, ("É" if i % 2 else "é") + "x" * 50) for i in range(8)]
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(table(spark, rows)).collect())


# ---- n-gram join -------------------------------------------------------------------------------------------------------


def sets(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = []
    for _, t in rows:
        w = [x for x in (t or "").translate(lower).replace("\t", " ").replace("\n", " ").split(" ") if x]
        out.append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    s = sets(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(s[i] & s[j])
            if o and 100 * o >= 80 * (len(s[i]) + len(s[j]) - o):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return s, [find(i) for i in range(len(rows))]


def test_join_against_brute_force(spark, prose):
    rng = random.Random(5)
    rows, n = [], 0
    for g in range(12):
        base = prose(rng.choice([4, 5, 6, 40, 60, 150]), g)
        for _ in range(rng.randint(1, 14)):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((n, rng.choice([" ", "  ", "\n"]).join(w)))
            n += 1
    shared = prose(60, 99)
    rows += [(n + i, " ".join(prose(10, 1000 + i) + shared)) for i in range(30)]
    s, comp = brute(rows)
    got = {r.doc_id: r for r in ngram_join.jaccard_components(table(spark, rows)).collect()}
    assert [got[i].n_shingles for i, _ in rows] == [len(x) for x in s]
    assert [got[i].component_id for i, _ in rows] == comp


def test_join_odd_rows(spark):
    got = ngram_join.jaccard_components(table(spark, ODD)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [by[i][0].n_shingles for i in (1, 2, 3)] == [0, 0, 0] and [by[i][0].component_id for i in (1, 2, 3)] == [1, 2, 3]
    assert by[None][0].component_id is None and [r.component_id for r in by[5]] == [5, 5] and by[7][0].n_shingles == 1
    assert ngram_join.jaccard_components(table(spark, [])).count() == 0
    linked = ngram_join.jaccard_components(table(spark, [(None, "a b c d e f"), (4, "A b c d e f"), (9, "a b c d e f")])).collect()
    assert {r.component_id for r in linked} == {4}


def test_join_of_repeated_ids_with_different_texts(spark, prose):
    """Rows are sets of their own, whatever their ids; each row of an id gets its own component's smallest id."""
    rng, rows = random.Random(11), []
    for g in range(10):
        base = prose(60, 40 + g)
        for _ in range(6):
            w = list(base)
            w[rng.randrange(60)] = f"new{rng.randrange(10**6)}"
            rows.append((rng.choice([None, 1, 2, 3, 50 + g]), " ".join(w)))
    rows += rows[:20]  # repeated rows
    _, comp = brute(rows)
    low = {}
    for (i, _), c in zip(rows, comp, strict=True):
        low[c] = min((x for x in (i, low.get(c)) if x is not None), default=None)
    want = collections.Counter((i, low[c]) for (i, _), c in zip(rows, comp, strict=True))
    got = ngram_join.jaccard_components(table(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.component_id) for r in got) == want


def test_join_with_salted_hubs_gives_the_same(spark, prose, monkeypatch):
    rng, base = random.Random(12), prose(80, 3)
    rows = [(i, " ".join(w if rng.random() > 0.01 else f"z{i}x{j}" for j, w in enumerate(base))) for i in range(60)]
    _, comp = brute(rows)
    monkeypatch.setattr(ngram_join, "HUB_PAIRS", 5)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(table(spark, rows)).collect()}
    assert [got[i] for i in range(60)] == comp


def test_fragments_cut_the_global_order():
    rng = np.random.default_rng(3)
    level = rng.integers(0, 40, 1 << 22).astype(np.uint8)
    _, fragment = ngram_join._order(level)
    by = np.argsort(level, kind="stable")
    assert (np.diff(fragment[by].astype(int)) >= 0).all() and set(np.unique(fragment)) == set(range(ngram_join.FRAGMENTS))
    mass = np.bincount(fragment, weights=np.exp2(level / 4) - 1)
    assert mass.max() < 1.2 * mass.min()


def test_join_of_one_large_group(spark, prose):
    base = prose(120, 7)
    rng = random.Random(1)
    rows = [(i, " ".join(w if rng.random() > 0.012 else f"z{i}x{j}" for j, w in enumerate(base))) for i in range(150)]
    _, comp = brute(rows)
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(table(spark, rows)).collect()}
    assert [got[i] for i in range(150)] == comp


# ---- passages ----------------------------------------------------------------------------------------------------------


def test_passages_inside_other_text(spark, prose):
    passage = prose(55, 500)
    rows = [(i, " ".join(prose(100, i))) for i in range(60)]
    for i in (3, 20, 41):
        w = prose(100, i)
        rows[i] = (i, " ".join(w[:37] + passage[:20]) + "\n" + " ".join(passage[20:] + w[37:]))
    got = substring_dedup.repeated_passages(table(spark, rows)).collect()
    assert {r.doc_id for r in got} == {3, 20, 41} and {r.doc_id for r in got if r.removed} == {20, 41}
    for r in got:
        assert 37 <= r.first_word and r.first_word + r.n_words <= 92 and r.keeper_doc_id == 3


def removed_words(got):
    return {(r.doc_id, w) for r in got if r.removed for w in range(r.first_word, r.first_word + r.n_words)}


def test_one_copy_of_nested_and_overlapping_passages_stays(spark, prose):
    low, own, high = prose(90, 700), prose(150, 701), prose(90, 702)
    rows = [
        (1, prose(60, 1) + low + prose(60, 2)), (2, prose(60, 3) + high + prose(60, 4)),
        (5, own[:70] + low + own[70:] + high), (9, own[:70] + low + own[70:] + high),  # copies that hold a passage each of 1 and 2
        (12, prose(60, 5) + own[30:70] + low[:50] + prose(60, 6)),  # overlaps both
    ]
    got = substring_dedup.repeated_passages(table(spark, [(i, " ".join(w)) for i, w in rows])).collect()
    gone = removed_words(got)
    assert all(r.removed == (r.doc_id != r.keeper_doc_id) for r in got)
    left = {w for i, t in rows for j, w in enumerate(t) if (i, j) not in gone}
    grams = {tuple(t[j : j + 5]) for i, t in rows for j in range(len(t) - 4) if all((i, j + k) not in gone for k in range(5))}
    lost = [(i, j) for i, t in rows for j in range(len(t) - 4) if all((i, j + k) in gone for k in range(5)) and tuple(t[j : j + 5]) not in grams]
    # only n-grams over a change of keeper may have no copy in one piece
    assert set(own) <= left and len(lost) <= 4 * 4
    assert sum(i == 9 for i, _ in gone) >= 300 and 60 <= sum(i == 5 for i, _ in gone) <= 190 and not any(i in (1, 2) for i, _ in gone)


def test_near_paragraphs_that_share_a_band_are_joined(spark, prose):
    """All paragraphs of a band that are similar enough end in one cluster, whoever leads the band."""
    rng, rows = random.Random(3), []
    common = "of the first part that is in all of".split()
    for g in range(40):
        base = prose(2, 800 + g) + common + prose(2, 900 + g)
        for e in range(3):
            w = list(base)
            if e:
                w[-1 if e == 1 else 0] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    got = {}
    for r in substring_dedup.repeated_passages(table(spark, rows), min_words=5).collect():
        got[r.doc_id] = r.cluster
    s, held = sets(rows), {}
    for i in range(len(rows)):
        ((_, _, buf, offsets),) = arrays.chunks(pa.array([rows[i][1]]))
        t = substring_dedup.Words(buf, offsets)
        _, h = substring_dedup._line_shingles(t, *t.lines(), 5)
        held[i] = set(substring_dedup.bands(h, np.zeros(1, np.int64))[0].tolist())
    near = [(i, j) for i in range(len(rows)) for j in range(i) if held[i] & held[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    apart = [(i, j) for i, j in near if i not in got or got[i] != got.get(j)]
    assert len(near) > 60 and not apart, f"{len(apart)} of {len(near)} similar pairs are apart"


def test_lines_with_a_word_changed_inside(spark, prose):
    """Similarity 0.81 to 0.88, and no run of 20 equal words that holds whole cuts."""
    rows = []
    for g, n in enumerate([51, 55, 60, 70, 80] * 6):
        line, end = prose(n, 600 + g), prose(n, 600 + g)
        end[n // 2] = "changed"
        rows += [(2 * g, "\n".join(" ".join(w) for w in (prose(30, g), line, prose(30, g + 100)))), (2 * g + 1, "\n".join(" ".join(w) for w in (prose(30, g + 200), end, prose(30, g + 300))))]
    got = removed_words(substring_dedup.repeated_passages(table(spark, rows)).collect())
    whole = [g for g in range(30) if {(2 * g + 1, w) for w in range(30, 30 + [51, 55, 60, 70, 80][g % 5])} <= got]
    assert len(whole) >= 27, f"{len(whole)} of 30 edited lines are found whole"
    assert not {i for i, _ in got if i % 2 == 0}


def test_passages_odd_rows(spark):
    got = substring_dedup.repeated_passages(table(spark, ODD)).collect()
    assert got == []  # one document's own repetition is none
    assert substring_dedup.repeated_passages(table(spark, [])).count() == 0
    twice = [(7, "word " * 3000), (8, "word " * 3000)]
    assert {r.doc_id for r in substring_dedup.repeated_passages(table(spark, twice)).collect()} == {7, 8}


def places(texts, at):
    """Windows and lines of one of the texts: first words, sizes, hashes."""
    ((_, _, buf, offsets),) = arrays.chunks(pa.array(texts))
    t = substring_dedup.Words(buf, offsets)
    windows, (lines, size) = t.windows(), t.lines()
    out = []
    for first, n in ((windows, np.full(len(windows), substring_dedup.PIECE)), (lines, size)):
        own = t.row[first] == at
        out.append([((first - t.first[at])[own]).tolist(), n[own].tolist(), *[x[own].tolist() for x in arrays.sequence_digests(t.hash, first, n)]])
    return out


def test_paragraphs_depend_on_the_text_alone(prose):
    for i in range(60):
        text = " ".join(prose(5 + i, i))
        alone = places([text], 0)
        assert bool(alone[0][0]) == (5 + i >= 20) and bool(alone[1][0]) == (5 + i >= 10)
        assert all(places([" ".join(prose(9 + 7 * k, 2000 + k)), text, " ".join(prose(9 + 7 * k, 3000 + k))], 1) == alone for k in range(8))
    assert places(["a", "", None, "b c"], 3) == [[[], [], [], []]] * 2


def test_windows_against_plain_loops(prose):
    for n in (20, 21, 39, 40, 41, 200):
        text = prose(n, n)
        ((_, _, buf, offsets),) = arrays.chunks(pa.array([" ".join(prose(70, 1)), " ".join(text), " ".join(prose(7, 1))]))
        t = substring_dedup.Words(buf, offsets)
        h = [int(x) for x in t.hash[70 : 70 + n]]
        g = [int(arrays.mix64(np.array([(h[i] + 3 * h[i + 1] + 7 * h[i + 2]) % 2**64], np.uint64))[0]) >> 32 for i in range(n - 2)]
        last = n - substring_dedup.PIECE
        want = {min(range(a, min(a + substring_dedup.REACH, last + 1)), key=lambda i: (g[i], i)) for a in range(max(1, last + 2 - substring_dedup.REACH))}
        at = t.windows()
        assert {int(x) - 70 for x in at[t.row[at] == 1]} == want


def test_any_forty_equal_words_hold_an_equal_window(prose):
    need = substring_dedup.PIECE + substring_dedup.REACH - 1
    for seed in range(200):
        passage = prose(need, seed)
        one, two = (places([" ".join(prose(50, seed + a) + passage + prose(50, seed + b))], 0)[0] for a, b in ((1000, 2000), (3000, 4000)))
        assert set(one[2]) & set(two[2])


def test_recall_of_passages(spark, prose):
    """All exact repeats of 51 words and more, and 0.9 of those with a word replaced, in different surroundings inside one line; nothing else."""
    rng, rows, want = random.Random(8), [], {}
    for g in range(240):
        n = rng.choice([51, 55, 60, 80, 120])
        passage, other = prose(n, 5000 + g), prose(n, 5000 + g)
        if g % 2:
            other[rng.randrange(n)] = f"changed{g}"
        for k, p in enumerate((passage, other)):
            a, b = rng.randrange(30, 90), rng.randrange(30, 90)
            rows.append((2 * g + k, " ".join(prose(a, 10_000 + 4 * g + k) + p + prose(b, 20_000 + 4 * g + k))))
            want[2 * g + k] = (a, a + n)
    rows += [(10_000 + i, " ".join(prose(100, 50_000 + i))) for i in range(60)]
    gone = removed_words(substring_dedup.repeated_passages(table(spark, rows)).collect())
    found = {i for i, _ in gone}
    assert all(2 * g + 1 in found for g in range(0, 240, 2))
    assert sum(2 * g + 1 in found for g in range(1, 240, 2)) >= 0.9 * 120
    assert all(i in want and want[i][0] <= w < want[i][1] and i % 2 for i, w in gone)


def test_recall_of_similar_lines(spark, prose):
    """Links of lines against brute force over all pairs: no wrong one, 0.9 of the right ones; components as of all links."""
    rng, rows = random.Random(4), []
    for g in range(140):
        base = prose(rng.randrange(12, 90), 700 + g)
        for _ in range(5):
            w = list(base)
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    s, ids = sets(rows), {}
    kinds = []
    for i, (_, text) in enumerate(rows):
        ((_, _, buf, offsets),) = arrays.chunks(pa.array([text]))
        t = substring_dedup.Words(buf, offsets)
        h, h2 = (int(x[0]) for x in arrays.sequence_digests(t.hash, *t.lines()))
        _, grams = substring_dedup._line_shingles(t, *t.lines(), 5)
        ids.setdefault(f"{h % 2**64:016X}{h2 % 2**64:016X}", i)
        kinds.append((h, h2, *substring_dedup.bands(grams, np.zeros(1, np.int64))[0].view(np.int64).tolist()))
    df = spark.createDataFrame(sorted(set(kinds)), "h long, h2 long, " + ", ".join(f"b{b} long" for b in range(substring_dedup.BANDS)))
    got = {tuple(sorted((ids[r.a.hex().upper()], ids[r.b.hex().upper()]))) for r in substring_dedup.line_links(df, table(spark, rows).select("text")).collect()}
    first = sorted(ids.values())
    near = {(i, j) for k, j in enumerate(first) for i in first[:k] if 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])}
    assert got <= near and len(near) > 100

    def groups(pairs):
        parent = {i: i for i in first}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return {i: find(i) for i in first}

    a, b = groups(got), groups(near)
    together = [(i, j) for k, j in enumerate(first) for i in first[:k] if b[i] == b[j]]
    assert sum(a[i] == a[j] for i, j in together) >= 0.9 * len(together)


def test_passages_do_not_depend_on_the_order_of_rows(spark, prose):
    rng, rows = random.Random(5), []
    passages = [prose(rng.randrange(24, 70), 60 + g) for g in range(12)]
    for i in range(120):
        p = list(passages[rng.randrange(12)])
        if i % 3 == 0:
            p[rng.randrange(len(p))] = "changed"
        cut = rng.choice([" ", "\n"])
        rows.append((i, cut.join([" ".join(prose(rng.randrange(5, 50), 100 + i)), " ".join(p), " ".join(prose(rng.randrange(5, 50), 300 + i))])))
    rows += [(200 + i, rows[i][1]) for i in range(10)]

    def run(rows, parts):
        return sorted(map(tuple, substring_dedup.repeated_passages(table(spark, rows).repartition(parts)).collect()))

    one = run(rows, 1)
    assert run(rows[::-1], 1) == one and run(rng.sample(rows, len(rows)), 7) == one and len(one) > 100


def test_copies_are_one_passage(spark, prose):
    text, other = " ".join(prose(50, 1)), " ".join(prose(15, 2))
    rows = [(3, text), (9, text.upper().replace(" ", "\n")), (9, text), (4, other), (5, other), (None, text)]
    got = sorted((r.doc_id, r.first_word, r.n_words, r.keeper_doc_id, r.removed) for r in substring_dedup.repeated_passages(table(spark, rows)).collect())
    assert got == [(3, 0, 50, 3, False), (9, 0, 50, 3, True)]  # fewer than 20 words are no passage


# ---- decontamination ---------------------------------------------------------------------------------------------------


def distance(item, text):
    """Least edits between item and any region of text, on normalised bytes."""
    a, b = (bytes(decontaminate.normal(np.frombuffer(x.encode(), np.uint8))) for x in (item, text))
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, e in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return min(row)


def test_leaks_against_brute_force(spark, prose):
    rng = random.Random(9)
    items = [(i, " ".join(prose(n, 300 + i))) for i, n in enumerate((12, 18, 25, 30))]
    docs = []
    for i in range(40):
        w = prose(30, i)
        _, text = items[i % 4]
        t = list(text)
        for _ in range(rng.randint(0, 16)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice([[], ["x"], [t[k], "y"]])
        docs.append((i, " ".join(w[:15]) + " " + "".join(t).upper() + "\n" + " ".join(w[15:])))
    index = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_leaks(table(spark, docs), index).collect()}
    want = {}
    for i, t in docs:
        for k, x in items:
            budget = decontaminate.edit_budget(len(x.encode()), decontaminate.Q, decontaminate.EDITS)
            e = distance(x, t)
            if e <= budget:
                want[i, k] = e
    assert got == want and 0 < len(want) < 40


def test_leaks_odd_rows(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "this is an item of some length"), (4, "this is an item of some length")], "item_id long, text string")
    docs = table(spark, [*ODD, (10, "a Short one"), (11, "xx THIS IS\nan item of some length yy"), (11, "xx THIS IS\nan item of some length yy")])
    got = sorted((r.doc_id, r.item_id, r.edits, r.start, r.end) for r in decontaminate.find_leaks(docs, items).collect())
    assert got == [(10, 3, 0, 2, 7)] + [(11, 4, 0, 3, 33)] * 4
    assert decontaminate.find_leaks(table(spark, []), items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0
    kept = decontaminate.clean(docs, items)
    assert kept.count() == len(ODD) and kept.columns == docs.columns


def test_a_benchmark_in_blocks_gives_the_same(spark, prose):
    items = spark.createDataFrame([(i, " ".join(prose(20, 300 + i))) for i in range(20)], "item_id long, text string")
    docs = table(spark, [(i, " ".join(prose(9, i) + prose(20, 300 + i % 25) + prose(9, i + 50))) for i in range(50)])
    one = sorted(map(tuple, decontaminate.find_leaks(docs, items).collect()))
    assert one == sorted(map(tuple, decontaminate.find_leaks(docs, items, block_bytes=500).collect())) and len(one) == 40


def test_leaks_with_null_item_ids(spark):
    items = spark.createDataFrame([(None, "the first of two items without an id"), (7, "an item that has an id, quite long"), (None, "the second one, also without any id")], "item_id long, text string")
    docs = table(spark, [(1, "xx the second one, also without any id"), (2, "an item that has an id, quite long xx"), (3, "nothing here")])
    got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.find_leaks(docs, items).collect()}
    assert got == {(1, None, 0), (2, 7, 0)}
    assert [r.doc_id for r in decontaminate.clean(docs, items).collect()] == [3]


def test_leaks_in_repetitive_texts(spark):
    """Runs of 1 MB against items with runs: counted by cells, found exactly, and at an edit's distance."""
    items = [(1, "a" * 2000), (2, "ab" * 300), (3, "x" * 400 + " end of the run"), (4, "a" * 300 + "Q" + "a" * 300)]
    docs = [(1, "a" * 1_000_000), (2, "ab" * 200_000), (3, "x" * 300_000 + " end of the sun"), (4, "b" * 1000), (5, "w " + "a" * 1990 + " w")]
    got = {(r.doc_id, r.item_id): (r.edits, r.start) for r in decontaminate.find_leaks(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(1, 1): (0, 0), (1, 4): (1, 0), (2, 2): (0, 0), (3, 3): (1, 299_600), (5, 1): (10, 0), (5, 4): (1, 2)}


def test_cells_of_frequent_qgrams_lose_nothing(prose, monkeypatch):
    """Counting by cells gives at least the counts of listing all pairs, so no band is lost."""
    text = ("ab" * 150 + " ".join(prose(30, 1)) + "ab" * 80 + " ".join(prose(20, 2))).encode()
    index = decontaminate.Items([(1, ("ab" * 100).encode()), (2, " ".join(prose(30, 1)).encode())], decontaminate.Q, decontaminate.EDITS)
    b = np.frombuffer(text, np.uint8)
    rows = np.zeros(len(b), np.int64)
    listed = dict(zip(*(x.tolist() for x in index.cells(b, rows, 5000)), strict=True))
    monkeypatch.setattr(decontaminate, "LISTED", 3)
    counted = dict(zip(*(x.tolist() for x in index.cells(b, rows, 5000)), strict=True))
    assert len(listed) > 10 and all(counted.get(key, 0) >= n for key, n in listed.items())
    monkeypatch.setattr(decontaminate, "HITS", 7)
    monkeypatch.setattr(decontaminate, "LISTED", 1 << 16)
    assert dict(zip(*(x.tolist() for x in index.cells(b, rows, 5000)), strict=True)) == listed


def test_clean_in_blocks(spark, prose):
    items = spark.createDataFrame([(i, " ".join(prose(20, 300 + i))) for i in range(20)], "item_id long, text string")
    docs = table(spark, [(i, " ".join(prose(9, i) + prose(20, 300 + i % 25) + prose(9, i + 50))) for i in range(50)])
    for size in (decontaminate.BLOCK_BYTES, 500):
        kept = decontaminate.clean(docs, items, block_bytes=size)
        assert sorted(r.doc_id for r in kept.collect()) == [i for i in range(50) if i % 25 >= 20] and kept.columns == docs.columns


@pytest.mark.parametrize("n", [1, 2, 3])
def test_item_at_the_edges_of_a_text(spark, n):
    text = " ".join(f"w{i}x" for i in range(20))
    docs = table(spark, [(1, text), (2, text[n:]), (3, text[:-n])])
    got = {r.doc_id: r.edits for r in decontaminate.find_leaks(docs, spark.createDataFrame([(1, text)], "item_id long, text string")).collect()}
    assert got == {1: 0, 2: n, 3: n}

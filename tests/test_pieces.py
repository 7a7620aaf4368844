"""Pieces against all segmentations, a plain merger and the tokenizer library; ragged tables against a plain loop."""

import os
import random
import time

import pytest
from helpers import DATA
from pyspark.sql import functions as F

from voxquarry.functions.pieces import BLANK, MOST_PIECES, Pieces, Segmenter
from voxquarry.operators import archive as R
from voxquarry.sources import pieces as P

MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer file")
SMALL = [(0, "<unk>", 0.0, "unknown"), (1, BLANK, -2.0, "normal"), (2, "a", -1.5, "normal"), (3, "b", -1.7, "normal"), (4, "ab", -2.5, "normal"), (5, BLANK + "a", -2.2, "normal"), (6, "ba", -3.1, "normal"), (7, "bab", -3.3, "normal"), (8, "<s>", 0.0, "control")]


def best_sum(text, score, worst):
    """The highest sum over all segmentations into pieces, an unknown character costing `worst`."""
    if not text:
        return 0.0
    tries = [score[text[:k]] + best_sum(text[k:], score, worst) for k in range(1, len(text) + 1) if text[:k] in score]
    return max(tries + ([worst + best_sum(text[1:], score, worst)] if text[0] not in score else []))


def test_best_segmentation_equals_all_segmentations():
    p, rng = Pieces("unigram", SMALL), random.Random(2)
    score = {x: s for _, x, s, kind in SMALL if kind == "normal"}
    by_id = {i: x for i, x, _, _ in SMALL}
    for _ in range(300):
        text = BLANK + "".join(rng.choice("aabbx") for _ in range(rng.randrange(9)))
        ids = p.segment(text)
        assert abs(sum(score[by_id[i]] if i else 0 for i in ids) + p.worst * text.count("x") - best_sum(text, score, p.worst)) < 1e-9
        assert "".join(by_id[i] if i else "x" for i in ids) == "x".join(filter(None, text.split("x"))) if "xx" in text and not text.endswith("x") else True
    assert p.ids("xxa") == [1, 0, 2] and p.ids("") == [] and p.ids("<s>")[-1] == 0


def test_merging_takes_the_best_pair_first():
    p = Pieces("bpe", SMALL)
    assert [p.pieces[i] for i in p.segment(BLANK + "abab")] == [BLANK + "a", "bab"] or p.segment(BLANK + "abab") == [5, 3, 4]
    plain = list(BLANK + "abab")
    score = {x: s for _, x, s, kind in SMALL if kind == "normal"}
    while True:
        tries = [(-score[a + b], i) for i, (a, b) in enumerate(zip(plain, plain[1:], strict=False)) if a + b in score]
        if not tries:
            break
        i = min(tries)[1]
        plain[i : i + 2] = [plain[i] + plain[i + 1]]
    assert [p.pieces[i] for i in p.segment(BLANK + "abab")] == plain


def test_merges_at_once_equal_a_plain_merger():
    rng = random.Random(4)
    for rows in (SMALL, [*SMALL, (9, "zb", -1.1, "normal"), (10, "abb", -2.5, "normal")], [*SMALL, *((20 + b, f"<0x{b:02X}>", 0.0, "byte") for b in range(256))]):
        p, score = Pieces("bpe", rows), {x: s for _, x, s, kind in rows if kind == "normal"}
        number = {x: i for i, x, _, kind in rows if kind == "normal"}
        texts = ["".join(rng.choice("aabbxyzé") for _ in range(rng.choice((1, 3, 7, 20, 45)))) for _ in range(200)]
        for text, got in zip(texts, p.encoded([p.slices(t) for t in texts]), strict=True):
            plain, want = list(BLANK + text), []
            while tries := [(-score[a + b], i) for i, (a, b) in enumerate(zip(plain, plain[1:], strict=False)) if a + b in score]:
                i = min(tries)[1]
                plain[i : i + 2] = [plain[i] + plain[i + 1]]
            for x in plain:
                want += [number[x]] if x in number else [p.bytes[b] for b in x.encode()] if p.bytes else [0] if want[-1:] != [0] else []
            assert [int.from_bytes(got[k : k + 4], "little") for k in range(0, len(got), 4)] == want == p.segment(BLANK + text)


def test_text_without_blanks_takes_time_in_proportion():
    p, text, start = Pieces("bpe", SMALL), "ab" * 40_000, time.process_time()
    assert p.ids(text) == [5, 7, *[4] * 39_998]
    assert time.process_time() - start < 10


def test_bounds():
    with pytest.raises(ValueError, match="no segmentation"):
        Pieces("word", SMALL)
    with pytest.raises(ValueError, match="blank behind"):
        Pieces("bpe", [*SMALL, (9, "a" + BLANK, -1.0, "normal")])
    assert MOST_PIECES > 32_000


@needs_model
def test_model_file_and_ids_equal_the_library(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    kind, t = P.read(spark, MODEL)
    rows = t.orderBy("id").collect()
    assert kind == "bpe" and [r["piece"] for r in rows] == [lib.id_to_piece(i) for i in range(lib.vocab_size())]
    assert all(abs(r["score"] - lib.get_score(r["id"])) < 1e-6 for r in rows) and [r["id"] for r in rows if r["kind"] == "byte"] == [i for i in range(lib.vocab_size()) if lib.is_byte(i)]
    s = Segmenter(kind, t)
    texts = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").limit(60).collect()] + ["", " ", "a  b ", "  x", "tab\tand\nline", "漢字 😀 <s>", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    for r in df.select("t", s.ids(F.col("t")).alias("ids"), s.pieces(F.col("t")).alias("p")).collect():
        assert r["ids"] == (None if r["t"] is None else lib.encode(r["t"])) and r["p"] == (None if r["t"] is None else lib.encode(r["t"], out_type=str))


@needs_model
def test_unknown_marks_and_the_lexicon(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    s = Segmenter(*P.read(spark, MODEL))
    df = spark.createDataFrame([("hello <unk> world",), ("<unk>",), ("a<unk><unk>",), (None,), ("",)], "t string")
    mark = [lib.piece_to_id(BLANK), lib.unk_id()]

    def want(t):
        first, *rest = [lib.encode(x) for x in t.split("<unk>")]
        return first + [i for x in rest for i in mark + x]

    assert [r[0] for r in df.select(s.ids_around(F.col("t"))).collect()] == [want("hello <unk> world"), mark, want("a<unk><unk>"), None, []]
    words = spark.createDataFrame([("hello",), ("xylophones",), ("hello",), (None,)], "word string")
    got = {r["word"]: r["tokens"] for r in s.lexicon(words).collect()}
    assert got == {"hello": lib.encode("hello", out_type=str), "xylophones": lib.encode("xylophones", out_type=str), "<UNK>": [BLANK, "<unk>"]}


@needs_model
def test_queries_over_documents(spark):
    import re

    import sentencepiece

    from voxquarry.plans.pieces import piece_ids

    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    got = piece_ids(spark, DATA).collect()
    assert len(got) == len(texts) and any(r["unknown"] for r in got)
    for r in got:
        parts = re.sub(r"[^\W\d_]{15,}", "<unk>", texts[r["doc_id"]]).split("<unk>")
        ids = [i for k, x in enumerate(parts) for i in ([lib.piece_to_id(BLANK), lib.unk_id()] if k else []) + lib.encode(x)]
        assert r["ids"] == " ".join(map(str, ids)) and r["n"] == len(ids)


def test_archive_equals_a_loop(spark):
    data = [(2, 0, ["b", "a", "b"]), (1, 0, ["ccc", "a"]), (1, 1, []), (3, 0, None), (3, 1, ["dd", None, "a"])]
    df = spark.createDataFrame(data, "k int, i int, ws array<string>")
    pieces = lambda w: F.filter(F.split(w, ""), lambda c: c != "")
    words = R.words_table(df, ["k", "i"], "ws", pieces)
    assert [tuple(r) for r in words.orderBy("word_id").select("word_id", "word", "pieces", "begin").collect()] == [(0, "ccc", ["c"] * 3, 0), (1, "a", ["a"], 3), (2, "b", ["b"], 4), (3, "dd", ["d", "d"], 5)]
    s = R.sentences_table(df, ["k", "i"], "ws", words).orderBy("k", "i").select("k", "i", "word_ids", "begin")
    assert [tuple(r) for r in s.collect()] == [(1, 0, [0, 1], 0), (1, 1, [], 2), (2, 0, [2, 1, 2], 2), (3, 0, [], 5), (3, 1, [3, 1], 5)]
    n = R.lengths_table(df, ["k", "i"], "ws", words).orderBy("k", "i").collect()
    assert [r["length"] for r in n] == [4, 0, 3, 0, 3]

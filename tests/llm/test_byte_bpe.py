"""Byte-level BPE against the tiktoken library, and its parts against plain ones."""

import hashlib
import random

import numpy as np
import pytest
import regex
import tiktoken
from helpers import DATA
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

from voxquarry.llm import byte_bpe, slices

ODD = ["a", "b", "s", "t", "re", "ve", "ll", "m", "d", "'", "'", " ", " ", "  ", "\n", "\t", "\r\n", "1", "½", "é", "漢", "。", "!", "...", "_", " ", "　", " ", "́", "🎉", "\U00010d40", "\x1c", "\x85", "<|endoftext|>", "the", " quick"]


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(byte_bpe.vocabulary_bytes())


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


def test_composition_is_associative_and_complete():
    number, compose, value, _ = byte_bpe.automaton()
    m = len(compose)
    f, g = np.indices((m, m))
    assert (value[compose[f, g]] == value[g[..., None], value[f]]).all()
    h = np.arange(m)
    assert (compose[compose[f, g][..., None], h] == compose[f[..., None], compose[g[..., None], h]]).all()


def test_scan_equals_a_loop():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 17, 1000):
        symbols = rng.integers(0, 16, n).astype(np.uint8)
        state, want = byte_bpe.FRESH, []
        for x in symbols.tolist():
            want.append(state)
            state = byte_bpe._step(state, x)[0]
        assert (byte_bpe.scan(symbols).tolist() if n else []) == want


def test_slices_equal_the_pattern():
    rng, bmp = random.Random(5), regex.compile(PATTERN)
    for _ in range(300):
        text = "".join(rng.choice(ODD[:-7]) for _ in range(rng.randrange(30)))
        starts, ends = byte_bpe.split(*packed([text]))
        assert [text.encode()[a:b].decode() for a, b in zip(starts, ends, strict=True)] == bmp.findall(text)


def test_ids_and_ends_equal_the_library(vocabulary, library):
    rng = random.Random(7)
    for _ in range(150):
        texts = ["".join(rng.choice(ODD) for _ in range(rng.choice([0, 1, 2, 5, 40, 300]))) for _ in range(20)]
        ids, ends, first = vocabulary.encode(*packed(texts))
        for k, text in enumerate(texts):
            own = ids[first[k] : first[k + 1]].tolist()
            assert own == library.encode_ordinary(text)
            assert ends[first[k] : first[k + 1]].tolist() == np.cumsum([len(vocabulary.tokens[x]) for x in own]).tolist()


def test_long_slices_and_long_texts(vocabulary, library, monkeypatch):
    rng = random.Random(9)
    word = "".join(rng.choice("abcdeé") for _ in range(5000))
    assert np.frombuffer(vocabulary.merge([word.encode()])[0], np.int32).tolist() == library.encode_ordinary(word)
    text = "".join(rng.choice(ODD) for _ in range(20000)) + word + " ".join(rng.choice(ODD) for _ in range(5000))
    monkeypatch.setattr("voxquarry.llm.arrays.CHUNK_BYTES", 700)
    monkeypatch.setattr(slices.parts, "__defaults__", (700,))
    ids, ends, _ = byte_bpe._in_parts(vocabulary, *packed([text]))
    assert ids.tolist() == library.encode_ordinary(text)
    assert ends.tolist() == np.cumsum([len(vocabulary.tokens[x]) for x in ids]).tolist()


def test_slices_whose_hashes_meet(monkeypatch):
    buf, offsets = packed(["ab", "cd", "ab", "abc", "cd", ""])
    want = [b"ab", b"cd", b"ab", b"abc", b"cd"]
    for same in (False, True):
        if same:
            monkeypatch.setattr("voxquarry.llm.arrays.word_hashes", lambda b, s, e: np.zeros(len(s), np.uint64))
        keys, number = slices.distinct(buf, offsets[:5], offsets[1:6])
        assert [keys[i] for i in number] == want
        assert len(set(keys[i] for i in number)) == len(set(number.tolist())) == 3


def test_memory_keeps_what_is_in_use():
    made = []
    memory = slices.Memory(3)
    for key in range(50):
        assert memory.fill([b"often", b"%d" % key], lambda missing: made.extend(missing) or [x * 2 for x in missing]) == [b"oftenoften", b"%d" % key * 2]
    assert made.count(b"often") == 1 and len(memory.new) + len(memory.old) < 12


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {x["doc_id"]: x for x in byte_bpe.op11_byte_bpe(spark, DATA).collect()}
    assert len(got) == len(docs)
    for x in docs:
        ids, text = library.encode_ordinary(x["text"] or ""), (x["text"] or "").encode()
        assert got[x["doc_id"]]["n_tokens"] == len(ids)
        assert got[x["doc_id"]]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[x["doc_id"]]["decoded_sha256"] == hashlib.sha256(text).hexdigest()


def test_odd_rows(spark, library):
    long = "word's " * 300_000
    texts = [(1, None), (2, ""), (2, ""), (None, "don't"), (3, long), (4, "x" * 40_000), (5, "<|endoftext|>")]
    df = spark.createDataFrame([(i, t, "kept", "k") for i, t in texts], "doc_id long, text string, ids string, other string")
    out = byte_bpe.decode(byte_bpe.encode(df))
    assert out.columns == ["doc_id", "text", "other", "ids", "ends", "decoded"]
    rows = out.collect()
    assert len(rows) == len(texts)
    for x in rows:
        assert x["ids"] == library.encode_ordinary(x["text"] or "") and bytes(x["decoded"]) == (x["text"] or "").encode()
        for k in (0, len(x["ids"]) // 2):  # the ends lead back to the text
            if x["ids"]:
                begin = x["ends"][k - 1] if k else 0
                assert (x["text"].encode())[begin : x["ends"][k]] == library.decode_single_token_bytes(x["ids"][k])
    assert byte_bpe.encode(df.limit(0)).collect() == [] and byte_bpe.decode(byte_bpe.encode(df.where("false"))).collect() == []


def test_decoding_unknown_ids(spark):
    df = spark.createDataFrame([([31373],), ([31373, 60000],), ([-1],), ([],), (None,), ([31373, None],)], "ids array<int>")
    assert [None if x["decoded"] is None else bytes(x["decoded"]) for x in byte_bpe.decode(df).collect()] == [b"hello", None, None, b"", None, None]
    assert byte_bpe.decode(df.withColumn("decoded", F.lit(1))).columns == ["ids", "decoded"]

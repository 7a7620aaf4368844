"""Aligned tokens of two tokenizers against a plain loop over whole texts."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from helpers import DATA
from public_tokenizers import path
from tokenizers import Tokenizer

from voxquarry.llm import slices, token_links

ODD = ["a", "b", "'s", "'", " ", " ", "  ", "\n", "\t", "\r\n", " \n ", "1", "½", "é", "漢字", "。", "!", "...", " ", "　", " ", "́", "🎉", "\x00", "\x85", "<|endoftext|>", "<s>", "<0x41>", "the", " quick", "internationalisation", "﻿"]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    alphabet = {v: bytes([k]) for k, v in zip(range(256), map(chr, _alphabet()), strict=True)}
    names = {i: b"".join(alphabet[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if t != "<|endoftext|>"}
    return a, names, sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))


def _alphabet():
    spare = 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            yield b
        else:
            yield spare
            spare += 1


def plain(tools, texts):
    """By the definition: whole texts, all overlaps, cuts where both end."""
    a, names, b = tools
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    docs, count = [], Counter()
    for text in texts:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        ax, by = [names[i] for i in x], [piece(i) for i in y]
        if not text or not b"".join(ax) == b"".join(by) == (" " + text).encode():
            docs.append(([], [], [], []))
            continue
        ends = [np.cumsum([*map(len, z)]).tolist() for z in (ax, by)]
        links, groups, i, j, at = [], [], 0, 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            g, h = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((x[i:g], y[j:h]))
            for p in range(i, g):
                for q in range(j, h):
                    if max(ends[0][p] - len(ax[p]), ends[1][q] - len(by[q])) < min(ends[0][p], ends[1][q]):
                        links.append((x[p], y[q]))
            i, j, at = g, h, end
        docs.append((x, y, groups, links))
        count.update(set(links))
    best = defaultdict(int)
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for x, y, groups, links in docs:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(x), len(y), len(groups), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if x else "", text))
    return out, count


def test_components_equal_a_loop():
    rng = np.random.default_rng(6)
    for n in (1, 5, 40):
        for m in (0, n // 2, 2 * n):
            u, v = rng.integers(0, n, (2, m))
            label = list(range(n))
            for _ in range(n):
                for i, j in zip(u, v, strict=True):
                    label[i] = label[j] = min(label[i], label[j])
            assert token_links.components(n, u, v).tolist() == label


def test_cuts_split_both_tokenizers(tools):
    rng, (a, _, b) = random.Random(8), tools
    for _ in range(400):
        text = " " + "".join(rng.choice(ODD) for _ in range(12))
        raw = text.encode()
        at = [0, *slices.cuts(np.frombuffer(raw, np.uint8)).tolist(), len(raw)]
        parts = [raw[i:j].decode() for i, j in zip(at, at[1:], strict=False)]
        assert [i for p in parts for i in a.encode(p, add_special_tokens=False).ids] == a.encode(text, add_special_tokens=False).ids
        blank = b.piece_to_id("▁")
        assert [i for p in parts for i in (b.encode(p[1:]) or [blank])] == b.encode(text[1:] or "x")[: None if text[1:] else 0] or not text[1:]


def test_query_equals_the_definition(spark, tools):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {x["doc_id"]: w[:7] for x, w in zip(rows, plain(tools, [x["text"] for x in rows])[0], strict=True)}
    got = token_links.op13_token_links(spark, DATA).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x["n_a"], x["n_b"], x["n_groups"], x["n_links"], x["n_best"], x["count_sum"], x["groups_sha256"]) == want[x["doc_id"]]


@pytest.mark.parametrize("block", [300, 8 << 20])
def test_odd_texts(spark, tools, monkeypatch, block):
    monkeypatch.setattr(token_links, "BLOCK_BYTES", block)
    monkeypatch.setattr("voxquarry.llm.arrays.CHUNK_BYTES", 400 if block == 300 else 1 << 20)
    rng = random.Random(10)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.choice([1, 3, 20, 80]))) for _ in range(150)]
    texts += [None, "", " ", "  ", "foo ", "▁x", "a ▁", "the the the", "the the the", "word " * 900, "ab" * 500]
    df = spark.createDataFrame([(None if k % 7 == 0 else k % 50, t, k, "z") for k, t in enumerate(texts)], "doc_id long, text string, docs long, extra string").repartition(3)
    df = df.withColumnRenamed("docs", "k")
    aligned = token_links.materialise(token_links.align(df), "t")
    got = {x["k"]: x for x in token_links.link_scores(aligned).collect()}
    want, count = plain(tools, texts)
    assert len(got) == len(texts)
    for k, w in enumerate(want):
        x = got[k]
        assert (x["n_a"], x["n_b"], x["n_groups"], x["n_links"], x["n_best"], x["count_sum"]) == w[:6]
        assert x["groups"] == w[7] and x["extra"] == "z"
    pairs = {x["pair"]: x["docs"] for x in token_links.pair_counts(aligned).collect()}
    assert pairs == {a << 32 | b: n for (a, b), n in count.items()}


def test_clashing_names_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, n_a long, Block int")
    out = token_links.link_scores(token_links.materialise(token_links.align(df), "t"))
    assert out.columns == ["doc_id", "block", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert [tuple(x)[2:6] for x in out.collect()] == [(2, 2, 2, 2)]
    none = token_links.link_scores(token_links.materialise(token_links.align(df.where("false")), "t"))
    assert none.collect() == []


def test_a_text_worked_on_in_parts(tools):
    one, two = (token_links.Aligner(*token_links.files()) for _ in range(2))
    rng = random.Random(12)
    text = "".join(rng.choice(ODD) for _ in range(3000)).encode()
    a, b = token_links.Block(0), token_links.Block(1)
    want = a.add(one, [text])[0]
    slices.parts.__defaults__, kept = (500,), slices.parts.__defaults__
    size, token_links.arrays.CHUNK_BYTES = token_links.arrays.CHUNK_BYTES, 500
    try:
        got = b.add(two, [text])[0]
    finally:
        slices.parts.__defaults__, token_links.arrays.CHUNK_BYTES = kept, size
    assert got[:5] == want[:5] == (*plain(tools, [text.decode()])[0][0][:4], plain(tools, [text.decode()])[0][0][7].encode())


def test_ranks_and_json_are_the_same_vocabulary(tools):
    with open(path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    assert tools[1] == ranks

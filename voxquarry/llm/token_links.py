"""Alignment of two tokenizers' tokens: minimal groups by union-find, links by overlap, distributed counts of linked ids.

Texts are cut where no token of either tokenizer can reach across, so that a slice is aligned once wherever it stands.
Tokens of a slice are the nodes of a bipartite graph, overlapping ones its edges; its connected components are the minimal
groups. Documents lie in blocks of some megabytes. A block counts in how many of its documents each pair of ids is
linked; Spark sums these counts by pair and hands each block the sums of its own pairs back, so that neither the
table of pairs nor the documents' links ever meet in one place.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxquarry.llm import arrays, slices
from voxquarry.llm.common import materialise, table

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Columns that align() adds: of documents, then of blocks.
ADDED = {
    "block": T.LongType(), "n_a": T.LongType(), "n_b": T.LongType(), "n_groups": T.LongType(), "n_links": T.LongType(), "groups": T.StringType(),
    "slice": T.ArrayType(T.IntegerType()), "times": T.ArrayType(T.IntegerType()),
    "pairs": T.ArrayType(T.LongType()), "docs": T.ArrayType(T.LongType()), "first": T.ArrayType(T.IntegerType()), "member": T.ArrayType(T.IntegerType()),
}


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component: union-find over all edges at once, by hooking roots and halving paths."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        open_ = a != b
        if not open_.any():
            return parent
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def overlaps(a_lens: np.ndarray, b_lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and B tokens of each overlap, in order; both cover the same bytes."""
    a_end, b_end = np.cumsum(a_lens), np.cumsum(b_lens)
    low = np.searchsorted(b_end, a_end - a_lens, side="right")
    n = np.searchsorted(b_end - b_lens, a_end, side="left") - low
    return np.repeat(np.arange(len(a_lens)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - low, n)


def _byte_alphabet() -> dict[str, int]:
    """The printable character of each byte in byte-level vocabularies: printable bytes stand for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All entries, and how many each list has."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(n.sum())), n


def _steps(ends: np.ndarray) -> list[int]:
    return np.diff(ends, prepend=0).tolist()


def _cut(data: bytes, ends: np.ndarray) -> list[bytes]:
    ends = ends.tolist()
    return [data[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def _same(tokens: pa.Array, ids: np.ndarray, n: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """Whether the joined bytes of each slice's tokens are the slice."""
    words = tokens.take(pa.array(ids))
    place = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1) if len(words) else np.zeros(1, np.int64)
    joined = _cut(words.buffers()[2].to_pybytes() if len(words) else b"", place[np.cumsum(n)])
    return np.fromiter((x == k for x, k in zip(joined, keys, strict=True)), bool, len(keys))


class Aligner:
    """Two tokenizers from the contents of their files: byte-level BPE (A) and pieces with byte fallback that add a blank (B)."""

    def __init__(self, a_file: str, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        alphabet = _byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        a_bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            a_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_bytes, self.b_bytes = pa.array(a_bytes, pa.large_binary()), pa.array(b_bytes, pa.large_binary())
        self.a_lens, self.b_lens = np.array([*map(len, a_bytes)]), np.array([*map(len, b_bytes)])
        self.blank = self.b.piece_to_id("▁")
        #: Pieces with a blank behind other characters would reach across cuts: then whole texts are the slices.
        self.cut = not any("▁" in p.lstrip("▁") for p in pieces)
        self.memory = slices.Memory()

    def make(self, keys: list[bytes]) -> list[tuple[int, int, int, int, bytes, bytes] | None]:
        """For each slice, which starts with a blank: A tokens, B tokens, groups, links, the groups as text, the linked pairs of
        ids as longs; None where the joined bytes of A or B differ from the slice."""
        texts = [k.decode() for k in keys]
        b_ids = [x if k != b" " else [self.blank] for k, x in zip(keys, self.b.encode([t[1:] for t in texts], num_threads=1), strict=True)]
        a, a_n = self._encoded(texts, keys)
        b, b_n = _flat(b_ids)
        whole = _same(self.a_bytes, a, a_n, keys) & _same(self.b_bytes, b, b_n, keys)
        if not whole.all():
            a, b, a_n, b_n = a[np.repeat(whole, a_n)], b[np.repeat(whole, b_n)], a_n[whole], b_n[whole]
        x, y = overlaps(self.a_lens[a], self.b_lens[b])
        root = components(len(a) + len(b), x, y + len(a))
        opens = root[: len(a)] == np.arange(len(a))  # a component's smallest node is its first A token
        group = np.cumsum(opens) - 1
        b_group = group[root[len(a) :]] if len(b) else group[:0]
        a_end, b_end = np.cumsum(a_n), np.cumsum(b_n)
        groups, links = group[a_end - 1] + 1, np.searchsorted(x, a_end)
        pairs = (a[x] << 32 | b[y]).tobytes()
        text, place = self._text(a, b, group, b_group, b_end)
        rows = zip(a_n.tolist(), b_n.tolist(), _steps(groups), _steps(links), _cut(text, place[a_end + b_end]), _cut(pairs, 8 * links), strict=True)
        if whole.all():
            return list(rows)
        out: list[tuple | None] = [None] * len(keys)
        for k in np.flatnonzero(whole).tolist():
            out[k] = next(rows)
        return out

    def _encoded(self, texts: list[str], keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """A's ids of all slices and their number in each. Slices that end in ink are encoded some hundred at a time, as their ends are cuts."""
        ink = np.array([bool(slices.INK[t[-1].encode()[0]]) for t in texts], bool)
        if self.cut and ink.all():
            flat, _ = _flat([x.ids for x in self.a.encode_batch_fast(["".join(texts[i : i + 500]) for i in range(0, len(texts), 500)], add_special_tokens=False)])
            ends, own = np.cumsum(self.a_lens[flat]), np.cumsum([*map(len, keys)])
            last = np.searchsorted(ends, own)
            if len(flat) and last[-1] < len(ends) and (ends[last] == own).all():
                return flat, np.diff(last, prepend=-1)
        elif self.cut and ink.any():
            flat, n = np.zeros(len(keys), object), np.zeros(len(keys), np.int64)
            for some in (np.flatnonzero(ink), np.flatnonzero(~ink)):
                ids, n[some] = self._encoded([texts[i] for i in some], [keys[i] for i in some])
                flat[some] = np.split(ids, np.cumsum(n[some])[:-1])
            return np.concatenate(list(flat)), n
        return _flat([x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)])

    def _text(self, a: np.ndarray, b: np.ndarray, group: np.ndarray, b_group: np.ndarray, b_end: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The groups of all slices as text, and where each token's number begins in it. Numbers stand with the mark that follows."""
        a_last = np.append(group[1:] != group[:-1], True)[: len(a)]
        b_last = np.append(b_group[1:] != b_group[:-1], True)[: len(b)]
        mark = np.where(b_last, 3, 2)
        mark[b_end - 1] = 4
        n = len(self.a_bytes)
        many = np.concatenate([a + n * a_last, 2 * n + b + len(self.b_bytes) * (mark - 2)])
        first_b, behind_a = np.searchsorted(b_group, group), np.searchsorted(group, b_group, side="right")
        order = np.empty(len(many), np.int64)
        order[np.arange(len(a)) + first_b] = np.arange(len(a))
        order[np.arange(len(b)) + behind_a] = np.arange(len(b)) + len(a)
        words = self.numbers.take(pa.array(many[order]))
        return (words.buffers()[2].to_pybytes() if len(words) else b""), np.frombuffer(words.buffers()[1], np.int64, len(words) + 1) if len(words) else np.zeros(1, np.int64)

    @functools.cached_property
    def numbers(self) -> pa.Array:
        """A's ids with a comma and with the bar, B's with a comma, with a semicolon and bare."""
        kinds = [(len(self.a_bytes), ","), (len(self.a_bytes), "|"), (len(self.b_bytes), ","), (len(self.b_bytes), ";"), (len(self.b_bytes), "")]
        return pa.array([f"{i}{mark}".encode() for n, mark in kinds for i in range(n)], pa.large_binary())

    def split(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the slices of texts that lie one after the other in buf."""
        return np.union1d(slices.cuts(buf), offsets[:-1]) if self.cut else np.unique(offsets[:-1])


class Block:
    """What a block's documents hold: its slices, numbered, and each document's slices."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.slices: dict[bytes, int] = {}
        self.counts: list[tuple[int, int, int, int]] = []
        self.texts: list[bytes] = []
        self.links: list[bytes] = []
        self.lost: set[int] = set()
        self.held: list[np.ndarray] = []

    def add(self, aligner: Aligner, texts: list[bytes]) -> list[tuple]:
        """(n_a, n_b, n_groups, n_links, groups, slices, times) of each text; texts that the tokens don't give back have none."""
        texts_in = [b" " + t for t in texts if t]
        offsets = np.concatenate([[0], np.cumsum([*map(len, texts_in)])]).astype(np.int64)
        buf = np.frombuffer(b"".join(texts_in), np.uint8)
        numbers, first = self._numbers(aligner, buf, offsets)
        used, local = np.unique(numbers, return_inverse=True)
        counts = np.array([self.counts[i] for i in used.tolist()], np.int64).reshape(-1, 4)[local]
        groups = self.texts
        out, k = [], 0
        for t in texts:
            begin, end = (first[k], first[k + 1]) if t else (0, 0)
            k += bool(t)
            own = numbers[begin:end]
            which, times = np.unique(own, return_counts=True)
            if self.lost and not self.lost.isdisjoint(which.tolist()):
                own, which, times, end = own[:0], which[:0], times[:0], begin
            self.held.append(which)
            out.append((*counts[begin:end].sum(0).tolist(), b";".join([groups[i] for i in own.tolist()]), which.astype(np.int32), times.astype(np.int32)))
        self.bytes += len(buf)
        return out

    def _numbers(self, aligner: Aligner, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all slices in order, and where each text's begin; one long text is worked on in parts."""
        long = len(offsets) == 2 and aligner.cut and len(buf) > arrays.CHUNK_BYTES
        numbers, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in slices.parts(buf) if long else [(0, len(buf))]:
            begin = aligner.split(buf[i:j], np.array([0, j - i]) if long else offsets)
            keys, inverse = slices.distinct(buf[i:j], begin, np.append(begin[1:], j - i))
            get, own = self.slices.get, []
            for key, fact in zip(keys, aligner.memory.fill(keys, aligner.make), strict=True):
                at = get(key)
                if at is None:
                    at = self.slices[key] = len(self.texts)
                    if fact is None:
                        self.lost.add(at)
                    self.counts.append(fact[:4] if fact else (0, 0, 0, 0))
                    self.texts.append(fact[4] if fact else b"")
                    self.links.append(fact[5] if fact else b"")
                own.append(at)
            numbers.append(np.array(own, np.int64)[inverse])
            starts.append(begin + i)
        return np.concatenate(numbers), np.searchsorted(np.concatenate(starts), offsets)

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Linked pairs, documents that hold each, and by slice where its links begin among the links' pair numbers."""
        first = np.concatenate([[0], np.cumsum([len(x) // 8 for x in self.links])]).astype(np.int64)
        pairs, member = np.unique(np.frombuffer(b"".join(self.links), np.int64), return_inverse=True)
        docs = np.zeros(len(pairs), np.int64)
        some, n = [], 0
        for k, which in enumerate(self.held):
            some.append(which)
            n += len(which)
            if n > 1 << 18 or k == len(self.held) - 1:
                which, row = np.concatenate(some), np.repeat(np.arange(len(some)), [*map(len, some)])
                size = first[which + 1] - first[which]
                at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - first[which], size)
                docs += np.bincount(np.unique(np.repeat(row, size) * len(pairs) + member[at]) % max(1, len(pairs)), minlength=len(pairs))
                some, n = [], 0
        return pairs, docs, first, member


def files(a_path: str | None = None, b_path: str | None = None) -> tuple[str, bytes]:
    """Contents of the two files, public ones where no path is given. Vocabularies are bounded, so they are broadcast."""
    if a_path is None or b_path is None:
        import public_tokenizers

        a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return json.dumps(json.load(a)), b.read()


@functools.lru_cache(maxsize=2)
def _aligner(a_file: str, b_file: bytes) -> Aligner:
    return Aligner(a_file, b_file)


def _list(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, pa.list_(kind))


def align(docs: DataFrame, text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """A row for each document (its columns but `text`, n_a, n_b, n_groups, n_links, groups as text, its distinct slices and how
    often each stands) and one for each block (pairs of ids as a << 32 | b, the block's documents that hold each, and by
    slice its links' pairs). Rows of both kinds carry `block`; a document has `n_a`, a block has `pairs`.

    Null and empty texts, and those whose tokens don't join to a blank and the text, have no tokens: zeros and ''. Repeated
    rows count as documents of their own. Columns of docs with the names of added ones are dropped. Block numbers are by
    partition, so write the result before it is used twice.
    """
    docs = docs.select([c for c in docs.columns if c == text or c.lower() not in ADDED])
    own = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in own] + [T.StructField(k, v) for k, v in ADDED.items()])
    held = docs.sparkSession.sparkContext.broadcast(files(a_path, b_path))
    i32, i64 = pa.int32(), pa.int64()

    def closed(block: Block, kinds: list[pa.DataType]) -> pa.RecordBatch:
        pairs, total, first, member = block.totals()
        values = [pa.nulls(1, k) for k in kinds] + [pa.array([block.number], i64), *[pa.nulls(1, i64)] * 4, pa.nulls(1, pa.string()), *[pa.nulls(1, pa.list_(i32))] * 2]
        return pa.RecordBatch.from_arrays(values + [_list([x], k) for x, k in ((pairs, i64), (total, i64), (first.astype(np.int32), i32), (member.astype(np.int32), i32))], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*held.value)
        base, kinds, block = TaskContext.get().partitionId() << 32, None, None
        for batch in batches:
            kinds = [batch.column(f.name).type for f in own]
            for i, n, buf, offsets in arrays.chunks(batch.column(text)):
                block = block or Block(base)
                raw, at = buf.tobytes(), offsets.tolist()
                rows = block.add(aligner, [raw[a:b] for a, b in zip(at, at[1:], strict=False)])
                values = [batch.column(f.name).slice(i, n) for f in own] + [pa.array([block.number] * n, i64)]
                values += [pa.array([r[k] for r in rows], i64) for k in range(4)] + [pa.array([r[4] for r in rows], pa.binary()).cast(pa.string())]
                values += [_list([r[k] for r in rows], i32) for k in (5, 6)] + [pa.nulls(n, pa.list_(i64))] * 2 + [pa.nulls(n, pa.list_(i32))] * 2
                yield pa.RecordBatch.from_arrays(values, schema.names)
                if block.bytes >= BLOCK_BYTES:
                    yield closed(block, kinds)
                    block, base = None, base + 1
        if block:
            yield closed(block, kinds)

    return docs.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, docs, best) of all linked pairs of ids of a written align(): in how many documents they are linked, and whether
    that is the highest number of their A id."""
    pairs = aligned.where("pairs IS NOT NULL").select(F.inline(F.arrays_zip("pairs", "docs"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("docs"))
    pairs = materialise(pairs, "token-pairs").withColumn("a", F.shiftright("pair", 32))
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))
    return pairs.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def link_scores(aligned: DataFrame) -> DataFrame:
    """Documents of a written align() with n_best, their links whose count is the highest of their A id, and count_sum over
    all links. Each block gets the counts of its own pairs."""
    own = [f for f in aligned.schema.fields if f.name not in ("pairs", "docs", "first", "member", "slice", "times")]
    out = T.StructType([*own, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    names = [f.name for f in own]
    asked = aligned.where("pairs IS NOT NULL").select(F.col("block").alias("of"), F.posexplode("pairs").alias("pos", "pair"))
    counts = asked.join(pair_counts(aligned), "pair").select("of", "pos", "docs", "best")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        pos = right.column("pos").to_numpy()
        values = np.zeros((2, len(pos)), np.int64)
        values[0, pos], values[1, pos] = right.column("docs").to_numpy(), right.column("best").to_numpy()
        blocks = left.filter(left.column("first").is_valid())
        left = left.filter(left.column("first").is_null())
        if not left.num_rows:
            return left.select(names).append_column("n_best", pa.array([], pa.int64())).append_column("count_sum", pa.array([], pa.int64()))
        first, member = (blocks.column(c).combine_chunks().flatten().to_numpy() for c in ("first", "member"))
        running = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(values[:, member], axis=1)], axis=1)
        of_slice = running[:, first[1:]] - running[:, first[:-1]]
        lists, times = (left.column(c).combine_chunks() for c in ("slice", "times"))
        weighed = of_slice[:, lists.flatten().to_numpy()] * times.flatten().to_numpy()
        running = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(weighed, axis=1)], axis=1)
        ends = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        total, best = running[:, ends[1:]] - running[:, ends[:-1]]
        return left.select(names).append_column("n_best", pa.array(best)).append_column("count_sum", pa.array(total))

    left = aligned.select(*names, "slice", "times", "first", "member")
    return left.groupBy("block").cogroup(counts.groupBy("of")).applyInArrow(score, out)


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the two public tokenizers' tokens in every document, scored by the whole corpus' counts."""
    docs = align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).when(F.col("n_a") == 0, "")
    aligned = materialise(docs.withColumn("groups", digest), "token-links")
    return link_scores(aligned).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))

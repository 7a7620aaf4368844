"""Byte-level BPE: encoding and decoding with the ranks of a public vocabulary.

A text becomes an array of codepoint classes. Each class is a transition function over the few states of the
pre-tokenizer; functions compose associatively, so that a blocked prefix scan gives the state before every character and
with it the places where slices start, without a regular expression. Equal slices of a batch are merged once, by a cache
of slices over a cache of pairs. Ends of tokens in bytes are kept, so that any run of tokens leads back to its text.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxquarry.llm import arrays, slices
from voxquarry.llm.common import table

#: Symbols: letter, number, other, apostrophe before s t m d, apostrophe before re ve ll, white space that more white space or
#: the end follows, last blank before ink, last other white space before ink. The same plus FIRST at the start of a text.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACES, BLANK, BREAK = range(8)
FIRST = 8
#: States: at a certain start, behind a blank that joins what follows, in a run of letters, numbers, others or white space,
#: behind an apostrophe that two letters or one letter belong to.
FRESH, JOIN, LETTERS, NUMBERS, OTHERS, WHITE, TWO, ONE = range(8)
#: The rank of a pair that never merges.
NONE = 1 << 40


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a slice starts at the symbol."""
    if symbol >= FIRST:
        state, symbol = FRESH, symbol - FIRST
    if symbol == LETTER:
        if state in (TWO, ONE):
            return (ONE if state == TWO else FRESH), False
        return LETTERS, state not in (LETTERS, JOIN)
    if symbol == NUMBER:
        return NUMBERS, state not in (NUMBERS, JOIN)
    if symbol in (OTHER, SHORT, LONG):
        if state in (OTHERS, JOIN):
            return OTHERS, False
        return {OTHER: OTHERS, SHORT: ONE, LONG: TWO}[symbol], True
    if symbol == SPACES:
        return WHITE, state != WHITE
    return (JOIN if symbol == BLANK else FRESH), True


@functools.cache
def automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the symbols' functions, the table of compositions, each function's value by state, starts by state and symbol."""
    symbols = [tuple(_step(s, x)[0] for s in range(8)) for x in range(16)]
    known = {tuple(range(8)): 0}
    for f in symbols:
        known.setdefault(f, len(known))
    queue = list(known)
    for f in queue:  # closed under composition with a symbol, and so under composition
        for g in symbols:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                queue.append(h)
    compose = np.array([[known[tuple(g[s] for s in f)] for g in queue] for f in queue], np.uint8)
    starts = np.array([[_step(s, x)[1] for x in range(16)] for s in range(8)])
    return np.array([known[f] for f in symbols], np.uint8), compose, np.array(queue, np.uint8), starts


def scan(symbols: np.ndarray) -> np.ndarray:
    """The state before each symbol: prefix products of the symbols' functions within lanes, then over the lanes' products."""
    number, compose, value, _ = automaton()
    n, m = len(symbols), len(compose)
    lanes = max(1, int(np.sqrt(n)))
    steps = -(-n // lanes)
    grid = np.zeros(lanes * steps, np.uint8)  # the identity behind the end
    grid[:n] = number[symbols]
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    flat, row = compose.ravel(), np.zeros(lanes, np.uint8)
    before = np.empty((steps, lanes), np.uint8)
    for t in range(steps):
        before[t] = row
        row = flat.take(row.astype(np.uint16) * np.uint16(m) + grid[t])
    entry, state = np.empty(lanes, np.uint8), FRESH
    for lane, f in enumerate(row.tolist()):
        entry[lane] = state
        state = int(value[f, state])
    return value[before, entry].T.ravel()[:n]


@functools.cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER, SPACES or BLANK of each codepoint, as the pattern engine of the tiktoken library has them."""
    import tiktoken

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    single = {bytes([i]): i for i in range(256)}
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACES, r"\s")):
        of = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={})  # drops what doesn't match
        out[np.frombuffer(bytes(of.encode_ordinary(every)).decode().encode("utf-32-le"), np.uint32)] = kind
    out[32] = BLANK
    return out


def split(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends in bytes of the slices of texts that lie one after the other in buf."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    byte = np.flatnonzero((buf & 0xC0) != 0x80)
    n = len(points)
    head = np.zeros(n + 3, bool)
    head[np.searchsorted(byte, offsets[:-1][np.diff(offsets) > 0])] = True
    symbol = classes()[points]
    white = symbol >= SPACES
    last = white & ~np.append(white[1:], True) & ~head[1 : n + 1]
    symbol[white] = SPACES
    symbol[last] = np.where(points[last] == 32, BLANK, BREAK)
    mark = np.flatnonzero(points == ord("'"))
    ahead = np.append(points, np.zeros(2, np.uint32))
    a, b = ahead[mark + 1], ahead[mark + 2]
    a = np.where(head[mark + 1], 0, a)
    b = np.where(head[mark + 2], 0, b)
    symbol[mark[np.isin(a, [*map(ord, "stmd")])]] = SHORT
    symbol[mark[(np.isin(a, [ord("r"), ord("v")]) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]] = LONG
    symbol += head[:n] * np.uint8(FIRST)
    starts = byte[automaton()[3][scan(symbol), symbol]]
    return starts, np.append(starts[1:], len(buf))


class Vocabulary:
    """Ranks of byte strings, which are their ids; from the text of a rank file."""

    def __init__(self, ranks: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        self.tokens: list[bytes | None] = [None] * (max(self.ranks.values(), default=-1) + 1)
        for k, v in self.ranks.items():
            self.tokens[v] = k
        self.memory = slices.Memory()
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([*map(pairs.get, self.keys.tolist()), NONE], np.int64)

    def together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours' bytes together, NONE if they are no token."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        found = self.keys.take(at, mode="clip") == key if len(self.keys) else np.zeros(len(at), bool)
        return np.where(found, self.merged[at], NONE)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids (int32, as bytes) of each slice: the pair of lowest rank merges first, the leftmost among equals.

        All slices take their next merge in the same round; very long ones go by a heap.
        """
        out: list[bytes] = [b""] * len(pieces)
        open_ = []
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = np.int32(whole).tobytes()
            elif len(piece) > 256:
                out[k] = np.array(self._merge_long(self.bytes[np.frombuffer(piece, np.uint8)].tolist()), np.int32).tobytes()
            else:
                open_.append(k)
        ids = self.bytes[np.frombuffer(b"".join(pieces[k] for k in open_), np.uint8)]
        size = np.array([len(pieces[k]) for k in open_], np.int64)
        of, which = np.repeat(np.arange(len(open_)), size), np.array(open_, np.int64)
        rank = np.full(len(ids), NONE)
        if len(ids):
            rank[:-1] = np.where(of[1:] == of[:-1], self.together(ids[:-1], ids[1:]), NONE)
        while len(ids):
            first = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, first)
            done = low == NONE
            if done.any():
                raw = ids.astype(np.int32).tobytes()
                for k, i, n in zip(which[done].tolist(), first[done].tolist(), size[done].tolist(), strict=True):
                    out[k] = raw[4 * i : 4 * (i + n)]
                keep = ~done[of]
                ids, rank, which, low, size = ids[keep], rank[keep], which[~done], low[~done], size[~done]
                of = np.repeat(np.arange(len(size)), size)
                if not len(ids):
                    break
            at = np.flatnonzero(rank == low[of])
            at = at[np.append(True, of[at][1:] != of[at][:-1])]
            ids[at] = low
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, rank, of = ids[keep], rank[keep], of[keep]
            size = size - 1
            at -= np.arange(len(at))
            changed = np.concatenate([at, at[at > 0] - 1])
            after = np.minimum(changed + 1, len(ids) - 1)
            rank[changed] = np.where((of[after] == of[changed]) & (after > changed), self.together(ids[changed], ids[after]), NONE)
        return out

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for one slice by a heap of (rank, place) and links, in n log n steps."""
        n, get = len(ids), self.pairs.get
        pair = lambda a, b: get(a << 32 | b, NONE)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := pair(ids[i], ids[i + 1])) < NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else -1
            if j < 0 or pair(ids[i], ids[j]) != r:  # one of the two has merged otherwise since
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := pair(ids[i], ids[k])) < NONE:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := pair(ids[k], ids[i])) < NONE:
                heapq.heappush(heap, (r, k))
        return [x for x in ids if x >= 0]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, their ends in bytes from each text's start, and where each text's ids begin."""
        starts, ends = split(buf, offsets)
        keys, number = slices.distinct(buf, starts, ends)
        made = self.memory.fill(keys, self.merge)
        lists = slices.ragged(made, np.int32).take(pa.array(number))
        ids = lists.flatten().to_numpy()
        per = np.diff(lists.offsets.to_numpy())
        first = np.concatenate([[0], np.cumsum(per)])[np.searchsorted(starts, offsets)]
        stop = np.cumsum(self.lengths[ids])
        return ids, stop - np.repeat(offsets[:-1], np.diff(first)), first

    @functools.cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(x or b"") for x in self.tokens], np.int64)

    @functools.cached_property
    def table(self) -> pa.Array:
        return pa.array(self.tokens, pa.large_binary())

    def decode(self, ids: pa.Array) -> pa.Array:
        """The bytes of each list of ids; null where the list is null or holds an id that is not in the vocabulary."""
        offsets, flat = ids.offsets.to_numpy(), ids.values
        known = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.tokens))), False).to_numpy(zero_copy_only=False)
        words = self.table.take(pa.array(np.where(known, pc.fill_null(flat, 0).to_numpy(), 0)))
        if len(known):
            known = known & words.is_valid().to_numpy(zero_copy_only=False)
        place = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1) if len(words) else np.zeros(1, np.int64)
        wrong = np.concatenate([[0], np.cumsum(~known)])[offsets]
        data = words.buffers()[2] if len(words) else pa.py_buffer(b"")
        out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(place[offsets])), data])
        return pc.if_else(pc.and_(ids.is_valid(), pa.array(np.diff(wrong) == 0)), out, None)


def vocabulary_bytes(path: str | None = None) -> bytes:
    """A rank file as it is; the public 50k one if no path is given. Vocabularies are bounded, so they are broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=4)
def _vocabulary(ranks: bytes) -> Vocabulary:
    return Vocabulary(ranks)


def _in_parts(vocabulary: Vocabulary, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """encode(), with one long text worked on in parts of bounded size."""
    if len(offsets) > 2 or len(buf) <= arrays.CHUNK_BYTES:
        return vocabulary.encode(buf, offsets)
    ids, ends = [], []
    for a, b in slices.parts(buf):
        i, e, _ = vocabulary.encode(buf[a:b], np.array([0, b - a]))
        ids.append(i)
        ends.append(e + a)
    ids = np.concatenate(ids)
    return ids, np.concatenate(ends), np.array([0, len(ids)])


def encode(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Adds ids array<int> and ends array<bigint>: token k of a text covers its UTF-8 bytes ends[k-1] (0 for the first) to ends[k].

    Null and empty texts have no tokens. Rows, repeated ones too, stay as they are; columns named ids or ends are replaced.
    Texts of any length are worked on in parts of about 1 MB that are cut where slices end.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("ids", "ends") and c != text])
    held = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(held.value)
        for batch in batches:
            if not len(batch):
                continue
            for i, n, buf, offsets in arrays.chunks(batch.column(text)):
                ids, ends, first = _in_parts(v, buf, offsets)
                first = pa.array(first.astype(np.int32))
                lists = [pa.ListArray.from_arrays(first, pa.array(x)) for x in (ids, ends)]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, n).columns, *lists], [*batch.schema.names, "ids", "ends"])

    out = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.LongType()))])
    return docs.mapInArrow(run, out)


def decode(tokens: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """Adds decoded binary, the bytes of each list of ids; null for a null list or one with an id that is not in the vocabulary.

    A column named decoded is replaced.
    """
    tokens = tokens.drop(*[c for c in tokens.columns if c.lower() == "decoded" and c != ids])
    held = tokens.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(held.value)
        for batch in batches:
            for i in range(0, len(batch), 256):
                some = batch.slice(i, 256)
                lists = pa.concat_arrays([some.column(ids)]).cast(pa.large_list(pa.int64()))
                lists = pa.LargeListArray.from_arrays(pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py()), lists.flatten(), mask=lists.is_null() if lists.null_count else None)
                yield pa.RecordBatch.from_arrays([*some.columns, v.decode(lists).cast(pa.binary())], [*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())]))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes that they decode to."""
    tokens = encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "ids")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    digests = tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), "ids")
    return decode(digests).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))

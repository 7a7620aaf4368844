"""Piece vocabularies as tables: pieces, scores and kinds from a model file, read wherever Spark can read it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Kinds of pieces and of models, by their numbers in model files.
KINDS = {1: "normal", 2: "unknown", 3: "control", 4: "own", 5: "unused", 6: "byte"}
MODELS = {1: "unigram", 2: "bpe"}


def _fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """Field numbers and values of one protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            value = varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            value = data[i : i + size]
            i += size
        yield key >> 3, value


def parse(model: bytes) -> tuple[str, list[tuple[int, str, float, str]]]:
    """The kind of model and (id, piece, score, kind) of each piece."""
    kind, rows = "unigram", []
    for field, value in _fields(memoryview(model)):
        if field == 1:
            own = dict(_fields(value))
            rows.append((len(rows), bytes(own.get(1, b"")).decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, KINDS.get(own.get(3, 1), "normal")))
        elif field == 2:
            kind = MODELS.get(dict(_fields(value)).get(3, 1), "other")
    return kind, rows


def read(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """The kind of model (`unigram` or `bpe`) and its table (id, piece, score, kind). A vocabulary is bounded by its file."""
    kind, rows = parse(bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"]))
    return kind, spark.createDataFrame(rows, "id int, piece string, score double, kind string")

"""WARC archives with a two-level capture index.

Records are written as one gzip member each, so that each can be read by a range read of its file. The capture index
has a line for each record, sorted by reversed-host URL key; lines go into compressed blocks of bounded size, and a
sparse directory keeps the first key and the place of each block. A lookup searches the directory by bisection, reads
one block (more only if a key's captures go on) and bisects its lines.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxquarry.llm.common import materialise, shared_path, table

CRLF = b"\r\n"
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
BLOCK_LINES = 1000
DATE = "2020-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Reversed host, port unless usual, `)`, path and query: `http://www.a.org/x?b` -> `org,a)/x?b`. Null: empty."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return ")" + url
    host = host.removeprefix("www.")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{key}){(parts.path or '/').lower()}" + (f"?{parts.query.lower()}" if parts.query else "")


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(3, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _one_line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, kind: str, refers_to: int | None) -> bytes:
    """A response record with its HTTP head and payload, or a revisit record with the head alone."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", b""])
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    head += [f"WARC-Target-URI: {_one_line(url)}"] if url is not None else []
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and the payload behind the HTTP head of one uncompressed record."""
    head, _, rest = data.partition(CRLF * 2)
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + 4:
        raise ValueError("a record's length differs from its Content-Length")
    return fields, block.partition(CRLF * 2)[2]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


INDEX = "key string, page_id long, kind string, digest string, file string, offset long, length long"


def _write(folder: str):
    """A WARC file per task attempt, put in place by renaming it when complete; the attempt that Spark keeps names its files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        name = f"{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        keep: list[tuple] = []
        for batch in batches:
            for row in batch.to_pylist():
                payload = row["payload"]
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}.part", compression=None)
                data = _gzip(record(row["page_id"], row["url"], payload, bytes.fromhex(row["digest"]), row["kind"], row["refers_to"]))
                out.write(data)
                keep.append((url_key(row["url"]), row["page_id"], row["kind"], row["digest"], name, at, len(data)))
                at += len(data)
                if len(keep) >= 5000:
                    yield _rows(keep)
                    keep = []
        if out is not None:
            out.close()
            fs.move(f"{base}/{name}.part", f"{base}/{name}")
            yield _rows(keep)

    return run


_FIELDS = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("kind", pa.string()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_FIELDS.names, x, strict=True)) for x in rows], schema=_FIELDS)


def classify(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, payload_bytes, kind, refers_to) of each row of pages (page_id, url, html)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload")
    )
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    groups = rows.where(F.col("payload_bytes") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("c"))
    groups = materialise(groups.where("c > 1").drop("c"), "warc-copies")
    # short payloads have no partner: their join key is spread
    key = F.when(F.col("payload_bytes") >= revisit_bytes, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("_k", key).join(groups.withColumnRenamed("digest", "_k"), "_k", "left").drop("_k")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("*", F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("refers_to")).drop("first")


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html) under `folder`; returns the unsorted capture lines.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of `revisit_bytes` and more, that with the largest
    page_id is a response and the others revisit it; rows that repeat that page_id are responses too, and so are all if
    every page_id is null. No rows: no file. Files of failed attempts stay unnamed by the index.
    """
    return materialise(classify(pages, revisit_bytes).mapInArrow(_write(folder), INDEX), "warc-lines")


def _blocks(folder: str):
    """Compressed blocks of a sorted partition, one file a task, and the directory's lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        name, out, at, lines, part = f"{uuid.uuid4().hex}.idx", None, 0, [], 0

        def flush():
            nonlocal out, at, lines
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}.part", compression=None)
            data = _gzip("\n".join(lines).encode())
            out.write(data)
            row = {"first": lines[0].split("\t", 1)[0], "last": lines[-1].split("\t", 1)[0], "file": name, "offset": at, "length": len(data), "lines": len(lines)}
            at, lines = at + len(data), []
            return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()})

        for batch in batches:
            for row in batch.to_pylist():
                key = row.pop("key").replace("\t", "%09").replace("\n", "%0A")
                lines.append(key + "\t" + json.dumps(row, separators=(",", ":")))
                if len(lines) == BLOCK_LINES:
                    yield flush()
        if lines:
            yield flush()
        if out is not None:
            out.close()
            fs.move(f"{base}/{name}.part", f"{base}/{name}")

    return run


def build_index(lines: DataFrame, folder: str) -> DataFrame:
    """Sorts capture lines by key into compressed blocks; returns the sparse directory, a row for each block.

    The sort is by ranges of (key, page_id, file, offset), so that no host and no URL has to fit in a task.
    """
    order = ["key", "page_id", "file", "offset"]
    made = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(made.mapInArrow(_blocks(folder), "first string, last string, file string, offset long, length long, lines long"), "warc-directory")


def _read(fs: pafs.FileSystem, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(offset)
        return zlib.decompress(f.read(length), 31)


def read_blocks(directory: DataFrame, folder: str) -> DataFrame:
    """All capture lines of an index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                lines = _read(fs, f"{base}/{row['file']}", row["offset"], row["length"]).decode().split("\n")
                held = [x.split("\t", 1) for x in lines]
                yield pa.RecordBatch.from_pylist([{"key": k} | json.loads(v) for k, v in held], schema=_FIELDS)

    return directory.mapInArrow(run, INDEX)


def read_records(lines: DataFrame, folder: str) -> DataFrame:
    """Range-reads the record of each capture line and parses it; a revisit has the digest and length of what it revisits."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        held, name = None, None
        for batch in batches:
            rows = []
            for line in batch.to_pylist():
                if line["file"] != name:
                    if held is not None:
                        held.close()
                    held, name = fs.open_input_file(f"{base}/{line['file']}"), line["file"]
                held.seek(line["offset"])
                fields, body = parse(zlib.decompress(held.read(line["length"]), 31))
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                kind = fields["WARC-Type"]
                if kind == "response" and (hashlib.sha1(body).hexdigest() != digest or len(body) != int(fields["X-Payload-Length"])):
                    raise ValueError(f"payload and digest differ in {line['file']} at {line['offset']}")
                number = lambda f: int(fields[f]) if f in fields else None
                rows.append((number("X-Page-ID"), fields.get("WARC-Target-URI"), int(fields["X-Payload-Length"]), digest, kind, number("X-Refers-To-Page"), body if kind == "response" else None))
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "body"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names)
        if held is not None:
            held.close()

    near = lines.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return near.mapInArrow(run, schema)


class Index:
    """Lookups by URL: the directory is searched by bisection, then one block, then the record's range is read."""

    def __init__(self, directory: DataFrame, index_folder: str, archive_folder: str):
        self.rows = [x.asDict() for x in directory.orderBy("first", "last", "file", "offset").collect()]  # sparse: a row for each block
        self.firsts = [x["first"] for x in self.rows]
        (self.fs, self.index), (_, self.archive) = _open(index_folder), _open(archive_folder)

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """(fields, payload) of every capture of a URL, in order of page_id."""
        key, found = url_key(url), []
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.rows) and self.firsts[k] <= key:
            lines = _read(self.fs, f"{self.index}/{self.rows[k]['file']}", self.rows[k]["offset"], self.rows[k]["length"]).decode().split("\n")
            i = bisect.bisect_left(lines, key + "\t")
            while i < len(lines) and lines[i].startswith(key + "\t"):
                found.append(json.loads(lines[i].split("\t", 1)[1]))
                i += 1
            k += 1
        found.sort(key=lambda x: (x["page_id"] is not None, x["page_id"]))
        return [parse(_read(self.fs, f"{self.archive}/{x['file']}", x["offset"], x["length"])) for x in found]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_path(spark, "warc")
    lines = write_archives(table(spark, sf_dir, "pages"), f"{root}/archive")
    directory = build_index(lines, f"{root}/index")
    records = read_records(read_blocks(directory, f"{root}/index"), f"{root}/archive")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest AS d, max(page_id) AS first FROM p WHERE octet_length(b) >= 1000 GROUP BY 1)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON d = payload_digest AND octet_length(b) >= 1000
"""

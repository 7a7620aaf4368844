"""Sources and sinks: tables written as files of each kind and read again, and streams run to their end."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxquarry.functions import text as X
from voxquarry.operators import grid as G
from voxquarry.operators import vocab as V
from voxquarry.plans.lm import grams_sql, model
from voxquarry.plans.manifest import SEG, segments
from voxquarry.plans.registry import query, table
from voxquarry.plans.scoring import CELLS, COUNTS, counts
from voxquarry.scratch import shared_path
from voxquarry.sources import audio, binary, manifests, stm, text
from voxquarry.streaming import pool as PO
from voxquarry.streaming import turns as S

# ---- text ------------------------------------------------------------------------------------------------------------


@query("lines_from_files", "SELECT p_name AS value, count(*)::BIGINT AS n FROM part GROUP BY p_name")
def lines_from_files(spark, d):
    """Lines of files that begin with a byte-order mark."""
    path = shared_path(spark, "lines")
    table(spark, d, "part").select(F.concat(F.lit("﻿"), "p_name").alias("value")).write.text(path)
    return text.read_lines(spark, path, "*.txt").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("whole_files", "SELECT n_regionkey::BIGINT AS region, count(*)::BIGINT AS lines, (sum(length(n_name)) + count(*) - 1)::BIGINT AS chars FROM nation GROUP BY n_regionkey")
def whole_files(spark, d):
    """Each file as one text: the names of a region."""
    path = shared_path(spark, "whole")
    t = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("value"))
    t.repartition("region").write.partitionBy("region").text(path)
    got = text.read_whole(spark, path, "*.txt").select(F.regexp_extract("path", r"region=(\d+)", 1).cast("long").alias("region"), "value")
    return got.select("region", F.size(F.split("value", "\n")).cast("long").alias("lines"), F.length("value").cast("long").alias("chars"))


@query("stm_files", f"SELECT 'r' || conv_id AS recording_id, floor(start)::DOUBLE AS start, floor(start + duration)::DOUBLE AS \"end\", role || ' ' || turn AS text FROM {SEG}")
def stm_files(spark, d):
    """Segment lines written to files, read and parsed."""
    path = shared_path(spark, "stm")
    t = segments(spark, d).select(F.concat(F.lit("r"), "conv_id").alias("recording_id"), F.floor("start").cast("double").alias("start"), F.floor(F.col("start") + F.col("duration")).cast("double").alias("end"), F.concat_ws(" ", "role", "turn").alias("text"))
    stm.write(t, path)
    return stm.parse(text.read_lines(spark, path, "*.txt")).select("recording_id", "start", "end", "text")


@query("manifest_files", f"""SELECT conv_id || '-' || row_number() OVER (PARTITION BY conv_id ORDER BY start, start + duration) AS id, conv_id::VARCHAR AS recording_id, start, round(duration, 3) AS duration, 0 AS channel, role AS text, 'ms' AS language, 's' || turn AS speaker FROM {SEG}""")
def manifest_files(spark, d):
    """Supervisions as gzipped JSON lines and back."""
    path = shared_path(spark, "manifest")
    t = segments(spark, d).select(F.col("conv_id").cast("string").alias("recording_id"), "start", (F.col("start") + F.col("duration")).alias("end"), F.col("role").alias("text"), F.concat(F.lit("s"), "turn").alias("speaker"))
    manifests.write(manifests.supervisions(t, "ms"), path)
    return manifests.read(spark, path).select("id", "recording_id", "start", "duration", "channel", "text", "language", "speaker")


@query("recording_files", f"SELECT conv_id::VARCHAR AS id, '/audio/' || conv_id || '.wav' AS source, 16000 AS sampling_rate, round(sum(duration) * 16000)::BIGINT AS num_samples FROM {SEG} GROUP BY conv_id")
def recording_files(spark, d):
    path = shared_path(spark, "recordings")
    t = segments(spark, d).groupBy(F.col("conv_id").cast("string").alias("recording_id")).agg(F.sum("duration").alias("duration"))
    manifests.write(manifests.recordings(t.withColumn("path", F.concat(F.lit("/audio/"), "recording_id", F.lit(".wav")))), path)
    return manifests.read(spark, path, manifests.RECORDING, strict=True).select("id", F.col("sources")[0]["source"].alias("source"), "sampling_rate", "num_samples")


@query("json_block_files", "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation")
def json_block_files(spark, d):
    """JSON objects over several lines with blank lines between them."""
    path = shared_path(spark, "blocks")
    one = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), {"pretty": "true"})
    table(spark, d, "nation").select(one.alias("value")).write.option("lineSep", "\n\n").text(path)
    return text.read_json_blocks(spark, path, "id long, name string")


@query("json_array_files", "SELECT r_regionkey::BIGINT AS id, r_name AS name FROM region")
def json_array_files(spark, d):
    """A file that holds one array of objects."""
    path = shared_path(spark, "array")
    t = table(spark, d, "region").agg(F.to_json(F.collect_list(F.struct(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))).alias("value"))
    t.write.text(path)
    return spark.read.schema("id long, name string").option("multiLine", True).json(path)


@query("json_document_files", f"SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, start, start + duration AS \"end\", text FROM {SEG} JOIN conversations USING (conv_id, turn)")
def json_document_files(spark, d):
    """One document of segments for each conversation, written and read back object by object."""
    path = shared_path(spark, "documents")
    t = segments(spark, d).join(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["conv_id", "turn"])
    one = F.struct("turn", "start", (F.col("start") + F.col("duration")).alias("end"), "text")
    docs = t.groupBy("conv_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(one)).alias("segments"))).alias("doc"))
    binary.write_files(docs.select(F.concat("conv_id", F.lit(".json")).alias("name"), F.encode("doc", "UTF-8").alias("content")), path).agg(F.sum("bytes")).first()
    read = text.read_json_documents(spark, path, "segments", "start: double, end: double, text: string")
    return read.select(F.regexp_extract("path", r"(\d+)\.json$", 1).cast("long").alias("conv_id"), "pos", "start", "end", "text")


@query("grid_files", f"WITH {COUNTS}, {CELLS} SELECT rt60 AS id, CASE WHEN snr = 'F' THEN 'inf'::DOUBLE ELSE 10 END AS snr, round(wer, 9) AS wer FROM cells")
def grid_files(spark, d):
    """Cells as a table with a header; `inf` is a number."""
    path = shared_path(spark, "grid")
    c = G.cells(counts(spark, d), ["rt60", "snr"])
    c.select(F.col("rt60").alias("id"), F.when(F.col("snr") == "F", "inf").otherwise("10").alias("snr"), F.round("wer", 9).alias("wer")).write.option("header", True).csv(path)
    return manifests.read_grid(spark, path)


@query("matrix_files", "SELECT n_regionkey::VARCHAR AS row, k AS \"column\", CASE WHEN k = 'n' THEN count(*) ELSE sum(n_nationkey) END::DOUBLE AS value FROM nation, (SELECT unnest(['n', 'total']) AS k) GROUP BY n_regionkey, k")
def matrix_files(spark, d):
    """A matrix with a header, tab-separated, written and read as (row, column, value)."""
    path = shared_path(spark, "matrix")
    t = table(spark, d, "nation").groupBy(F.col("n_regionkey").cast("string").alias("row")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_nationkey").alias("total"))
    manifests.write_matrix(t, path)
    return manifests.read_matrix(spark, path)


@query("lexicon_files", "SELECT replace(n_name, ' ', '_') AS word, array_to_string(string_split(replace(n_name, ' ', '_'), ''), ' ') AS tokens FROM nation")
def lexicon_files(spark, d):
    path = shared_path(spark, "lexicon")
    w = table(spark, d, "nation").select(F.replace("n_name", F.lit(" "), F.lit("_")).alias("word"))
    manifests.write_lexicon(w.withColumn("tokens", F.filter(F.split("word", ""), lambda c: c != "")), path)
    return manifests.read_lexicon(spark, path).select("word", F.array_join("tokens", " ").alias("tokens"))


@query("symbol_files", "SELECT symbol, (row_number() OVER (ORDER BY symbol) + 1)::BIGINT AS id FROM (SELECT DISTINCT p_brand AS symbol FROM part)")
def symbol_files(spark, d):
    """Symbol tables as lines of a symbol and its id."""
    path = shared_path(spark, "symbols")
    ids = V.dense_ids(table(spark, d, "part").select(F.col("p_brand").alias("symbol")).distinct(), "symbol", 2)
    ids.select(F.concat_ws(" ", "symbol", "id").alias("value")).write.text(path)
    return manifests.read_symbols(spark, path)


@query("transcript_files", "SELECT 'c' || conv_id || '_' || turn AS id, role AS kind, regexp_extract(text, '^\\S*') AS text FROM conversations")
def transcript_files(spark, d):
    """`id:<tab>kind=text` lines."""
    path = shared_path(spark, "transcripts")
    first = F.regexp_extract("text", r"^\S*", 0)
    table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("_"), "turn", F.lit(":\t"), "role", F.lit("="), first).alias("value")).write.text(path)
    return manifests.read_transcripts(spark, path)


@query("pair_files", "SELECT n_name AS a, n_nationkey || ',' || n_regionkey AS b FROM nation")
def pair_files(spark, d):
    """Allow-list lines, split at the first comma."""
    path = shared_path(spark, "pairs")
    table(spark, d, "nation").select(F.concat_ws(",", "n_name", "n_nationkey", "n_regionkey").alias("value")).write.text(path)
    return text.read_pairs(spark, path)


@query("arpa_files", f"WITH {grams_sql(2)} SELECT n, count(*)::BIGINT AS ngrams, count(CASE WHEN f > 0 THEN f END)::BIGINT AS close FROM lm GROUP BY n")
def arpa_files(spark, d):
    """A language model in its text form and back: probabilities that agree to six digits of their logarithm."""
    path = shared_path(spark, "arpa")
    m = model(spark, d, 2)
    manifests.write_arpa(m, path)
    back = manifests.read_arpa(spark, path).select("n", "hist", "word", F.col("f").alias("again"))
    t = m.join(back.hint("merge"), ["n", "hist", "word"])  # both sides grow
    return t.groupBy("n").agg(F.count(F.lit(1)).alias("ngrams"), F.count_if((F.col("f") > 0) & (F.abs(F.log10("f") - F.log10("again")) < 1e-6)).alias("close"))


@query("numbered_files", "SELECT name, row_number() OVER (ORDER BY try_cast(replace(name, '.txt', '') AS BIGINT) IS NULL, try_cast(replace(name, '.txt', '') AS BIGINT), name)::INT AS seq FROM (SELECT (n_nationkey * 7) || '.txt' AS name FROM nation UNION ALL SELECT n_name || '.txt' FROM nation)")
def numbered_files(spark, d):
    """Files in order of the numbers in their names, others behind by name."""
    n = table(spark, d, "nation")
    names = n.select(F.concat(F.col("n_nationkey") * 7, F.lit(".txt")).alias("path")).unionByName(n.select(F.concat("n_name", F.lit(".txt")).alias("path")))
    return text.in_numeric_order(names).select(F.col("path").alias("name"), "seq")


@query("resumable_sink", "SELECT o_orderkey, o_custkey FROM orders")
def resumable_sink(spark, d):
    """A run that was broken off goes on with the keys that the sink lacks."""
    path = shared_path(spark, "sink")
    t = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    text.write_new(t.where("o_orderkey % 3 = 0"), path, "o_orderkey")
    text.write_new(t, path, "o_orderkey")
    return spark.read.parquet(path)


# ---- audio and features -------------------------------------------------------------------------------------------------


def waves(spark, d):
    """(user_id, samples) of each user's events in order, as small whole numbers."""
    t = table(spark, d, "events").select("user_id", F.struct("ts", "event_id", F.floor("value").cast("int").alias("x")).alias("s"))
    return t.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["x"]).alias("samples"))


@F.pandas_udf(T.BinaryType())
def wav_bytes(samples: pd.Series) -> pd.Series:
    return samples.map(lambda x: audio.encode(np.clip(np.asarray(x), -16000, 16000)))


@F.pandas_udf(T.BinaryType())
def stereo_bytes(samples: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([audio.encode(np.stack([np.clip(np.asarray(x), -16000, 16000), np.zeros(len(x))], 1), int(r)) for x, r in zip(samples, rate, strict=True)])


@F.pandas_udf(T.LongType())
def pcm_sum(pcm: pd.Series) -> pd.Series:
    return pcm.map(lambda x: int(np.frombuffer(x, "<i2").astype(np.int64).sum()))


def wave_files(spark, d) -> str:
    path = shared_path(spark, "audio")
    binary.write_files(waves(spark, d).select(F.concat("user_id", F.lit(".wav")).alias("name"), wav_bytes("samples").alias("content")), path).agg(F.sum("bytes")).first()
    return path


USER = r"(\d+)\.wav$"


@query("audio_probe", "SELECT user_id::BIGINT AS user_id, count(*)::BIGINT AS samples, count(*) / 16000.0::DOUBLE AS duration FROM events GROUP BY user_id")
def audio_probe(spark, d):
    """Durations from file sizes alone."""
    t = audio.probe(spark, wave_files(spark, d))
    return t.select(F.regexp_extract("path", USER, 1).cast("long").alias("user_id"), "samples", "duration")


@query("audio_files", "SELECT user_id::BIGINT AS user_id, count(*) / 16000.0::DOUBLE AS duration, sum(floor(value))::BIGINT AS total FROM events GROUP BY user_id")
def audio_files(spark, d):
    """Decoded samples of written files."""
    t = audio.read_audio(spark, wave_files(spark, d))
    return t.select(F.regexp_extract("path", USER, 1).cast("long").alias("user_id"), "duration", pcm_sum("pcm").alias("total"))


@query("resampled_audio", """SELECT user_id::BIGINT AS user_id, rate, count(*)::BIGINT AS written, ceil(count(*) * (16000.0 / rate))::BIGINT AS samples, ceil(count(*) * (16000.0 / rate))::BIGINT / 16000.0::DOUBLE AS duration
FROM events, (SELECT unnest([8000, 44100]) AS rate) GROUP BY user_id, rate""")
def resampled_audio(spark, d):
    """Stereo files of 8 and 44.1 kHz, written and read as mono at 16 kHz."""
    path = shared_path(spark, "audio")
    t = waves(spark, d).select("user_id", "samples", F.explode(F.array(F.lit(8000), F.lit(44100))).alias("rate"))
    binary.write_files(t.select(F.concat_ws("-", "user_id", F.col("rate").cast("string")).alias("stem"), stereo_bytes("samples", "rate").alias("content")).select(F.concat("stem", F.lit(".wav")).alias("name"), "content"), path).agg(F.sum("bytes")).first()
    read = audio.read_audio(spark, path).select(F.regexp_extract("path", r"(\d+)-(\d+)\.wav$", 1).cast("long").alias("user_id"), F.regexp_extract("path", r"(\d+)-(\d+)\.wav$", 2).cast("int").alias("rate"), F.floor(F.octet_length("pcm") / 2).alias("samples"), "duration")
    return read.join(t.select("user_id", "rate", F.size("samples").cast("long").alias("written")), ["user_id", "rate"])


@query("audio_concatenation", "SELECT user_id % 5 AS part, count(*)::BIGINT AS samples, sum(floor(value))::BIGINT AS total FROM events GROUP BY 1")
def audio_concatenation(spark, d):
    """Files of a group laid one after the other."""
    t = audio.read_audio(spark, wave_files(spark, d)).withColumn("user_id", F.regexp_extract("path", USER, 1).cast("long"))
    both = audio.concatenate(t.withColumn("part", F.col("user_id") % 5), ["part"], "user_id")
    return both.select("part", F.floor(F.octet_length("pcm") / 2).alias("samples"), pcm_sum("pcm").alias("total"))


@query("scaled_waveforms", """
WITH x AS (SELECT user_id, event_id, floor(value) / greatest(max(abs(floor(value))) OVER (PARTITION BY user_id), 1e-9) AS x FROM events)
SELECT user_id, event_id, round(x / (stddev_pop(x) OVER (PARTITION BY user_id) + 1e-6), 6) AS x FROM x""")
def scaled_waveforms(spark, d):
    """Samples over their peak, then over their deviation."""
    t = table(spark, d, "events").select("user_id", "event_id", F.floor("value").cast("double").alias("x"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(x=np.round(audio.scale(pdf["x"].to_numpy()), 6))

    return t.groupBy("user_id").applyInPandas(run, t.schema)


@query("htk_files", "SELECT label::BIGINT AS label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS frame, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last FROM embeddings")
def htk_files(spark, d):
    """Feature files of each label's vectors, read as frames."""

    @F.pandas_udf(T.BinaryType())
    def content(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: audio.write_htk(np.array([list(x) for x in r], np.float32)))

    path = shared_path(spark, "htk")
    g = table(spark, d, "embeddings").groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("rows"))
    binary.write_files(g.select(F.concat("label", F.lit(".htk")).alias("name"), content("rows").alias("content")), path).agg(F.sum("bytes")).first()
    t = audio.read_features(spark, path)
    return t.select(F.regexp_extract("path", r"(\d+)\.htk$", 1).cast("long").alias("label"), "frame", F.col("features")[0].alias("first"), F.element_at("features", -1).alias("last"))


# ---- streams --------------------------------------------------------------------------------------------------------------


def stream_of(spark, df):
    """The rows of a table as a stream of its files."""
    path = shared_path(spark, "stream")
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def to_the_end(stream):
    """Runs a stream over all that is there; returns what it gave."""
    spark = stream.sparkSession
    path, mark = shared_path(spark, "streamed"), shared_path(spark, "marks")
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


NTH = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1"


@query("streamed_decoding", f"""
WITH f AS (SELECT user_id, event_id % 7 AS token, {NTH} AS seq FROM events), c AS (SELECT user_id, seq // 3 AS k, sum(token) AS t, count(*) AS n FROM f GROUP BY 1, 2)
SELECT user_id::VARCHAR AS utt, sum(n)::BIGINT AS frames, string_agg(t::BIGINT::VARCHAR, ' ' ORDER BY k) AS hyp FROM c GROUP BY user_id""")
def streamed_decoding(spark, d):
    """Per-user decode state: chunks of three frames, each scored by the sum of its tokens."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    t = table(spark, d, "events").select(F.col("user_id").cast("string").alias("utt"), (F.row_number().over(w) - 1).cast("long").alias("seq"), (F.col("event_id") % 7).alias("token"), (F.row_number().over(w) == n).alias("last"))
    return to_the_end(S.decode_streams(stream_of(spark, t), 3, lambda part: [int(part["token"].sum())]))


@query("streamed_pool", f"""
WITH f AS (SELECT user_id, event_id % 7 AS token, {NTH} AS seq FROM events), n AS (SELECT user_id, count(*) AS n FROM f GROUP BY user_id),
c AS (SELECT user_id, n, unnest(range(0, n + 5, 4)) AS a FROM n), x AS (SELECT c.user_id, c.n, a, coalesce(sum(token), 0) AS t FROM c LEFT JOIN f ON f.user_id = c.user_id AND seq >= a AND seq < a + 6 GROUP BY ALL)
SELECT user_id % 4 AS lane, user_id::VARCHAR AS utt, n::BIGINT AS frames, count(*)::BIGINT AS chunks, string_agg((t + a)::BIGINT::VARCHAR, ' ' ORDER BY a) AS hyp FROM x GROUP BY user_id, n""")
def streamed_pool(spark, d):
    """Users' series as utterances, decoded by four lanes of three active streams; a chunk's token is the sum of its frames that aren't
    padding and of the frames taken before, which is the stream's state."""

    def score(windows, states):
        return [[int(sum(x for x in w if x >= 0) + s[0])] for w, s in zip(windows, states, strict=True)], [[s[0] + 4] for s in states]

    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("e"))
    own = F.transform("e", lambda x: (x["event_id"] % 7).cast("double"))
    t = e.select((F.col("user_id") % 4).alias("lane"), F.col("user_id").alias("num"), F.col("user_id").cast("string").alias("utt"), own.alias("frames"))
    ends = spark.range(4).select(F.col("id").alias("lane"), F.lit(None).cast("long").alias("num"), F.lit(None).cast("string").alias("utt"), F.lit(None).cast("array<double>").alias("frames"))
    with PO.with_rocksdb(spark):
        return to_the_end(PO.decode_pool(stream_of(spark, t.unionByName(ends)), 3, 4, score, [0.0], overlap=2, tail=3)).select("lane", "utt", "frames", "chunks", "hyp")


@query("streamed_turns", f"""
WITH e AS (SELECT user_id, {NTH} AS seq, event_id::VARCHAR AS text, CASE event_type WHEN 'click' THEN 'interim' WHEN 'view' THEN 'final' WHEN 'purchase' THEN 'complete' ELSE 'start' END AS kind FROM events),
t AS (SELECT *, coalesce(sum((kind = 'complete')::INT) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn FROM e),
g AS (SELECT user_id, turn, string_agg(text, ' ' ORDER BY seq) FILTER (WHERE kind = 'final') AS said, arg_max(kind, seq) FILTER (WHERE kind <> 'complete') AS kind, arg_max(text, seq) FILTER (WHERE kind <> 'complete') AS last FROM t GROUP BY ALL HAVING bool_or(t.kind = 'complete'))
SELECT user_id::VARCHAR AS session, turn::BIGINT AS turn, concat_ws(' ', said, CASE WHEN kind = 'interim' THEN last END) AS text, coalesce(kind = 'interim', false) AS truncated FROM g""")
def streamed_turns(spark, d):
    """Turns put together from a stream of messages."""
    kind = F.when(F.col("event_type") == "click", "interim").when(F.col("event_type") == "view", "final").when(F.col("event_type") == "purchase", "complete").otherwise("start")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, d, "events").select(F.col("user_id").cast("string").alias("session"), (F.row_number().over(w) - 1).cast("long").alias("seq"), kind.alias("kind"), F.col("event_id").cast("string").alias("text"))
    return to_the_end(S.assemble_turns(stream_of(spark, t)))


@query("streamed_quarantine", "SELECT event_id, value < 5 AS bad FROM events")
def streamed_quarantine(spark, d):
    """Rows that fail a check go to a dead-letter sink."""
    good, bad, mark = (shared_path(spark, x) for x in ("good", "bad", "marks"))
    t = stream_of(spark, table(spark, d, "events").select("event_id", "value"))
    S.quarantine(t, good, bad, F.col("value") >= 5, mark).awaitTermination()
    one = lambda path, flag: spark.read.schema("event_id long").parquet(path).select("event_id", F.lit(flag).alias("bad"))
    return one(good, False).unionByName(one(bad, True))


# ---- functions -------------------------------------------------------------------------------------------------------------

ENGLISH = "p_partkey::VARCHAR"
for _i, _name in enumerate(X.ENGLISH):
    ENGLISH = f"replace({ENGLISH}, '{_i}', '{_name} ')"


@query("english_digits", f"SELECT p_partkey, trim({ENGLISH}) AS said FROM part")
def english_digits(spark, d):
    return table(spark, d, "part").select("p_partkey", X.digits_in_english(F.col("p_partkey").cast("string")).alias("said"))


@query("byte_numbers", """
WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text <> ''), b AS (SELECT doc_id, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM h)
SELECT doc_id, len(b)::BIGINT AS n, list_sum(b)::BIGINT AS total, list_max(b)::BIGINT AS most FROM b""")
def byte_numbers(spark, d):
    """Texts as numbers of their UTF-8 bytes, summed up."""
    t = table(spark, d, "documents").where("text <> ''").select("doc_id", X.byte_symbols(F.col("text")).alias("b"))
    total = F.aggregate("b", F.lit(0).cast("long"), lambda a, x: a + x)
    return t.select("doc_id", F.size("b").cast("long").alias("n"), total.alias("total"), F.array_max("b").cast("long").alias("most"))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@query("byte_recovery", f"""
WITH al AS (SELECT unnest(range(0, 256)) AS b, unnest(string_split({quoted(X.BYTE_ALPHABET)}, '')) AS c), hx AS MATERIALIZED (SELECT printf('%02X', b) AS h, c FROM al),
w AS (SELECT doc_id, regexp_extract_all(hex(encode(regexp_replace(text, {quoted(X.ANY_SPACE)}, ' ', 'g'))), '..') AS hs FROM documents),
u AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM w),
b AS (SELECT doc_id, count(*)::INT AS symbols, coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE i % 7 <> 0), '') AS broken FROM u JOIN hx USING (h) GROUP BY doc_id),
r AS (SELECT doc_id, string_split(array_to_string(regexp_extract_all(broken, {quoted(X.VALID_SYMBOLS)}), ''), '') AS good FROM b),
v AS (SELECT doc_id, unnest(good) AS c, generate_subscripts(good, 1) AS i FROM r), t AS (SELECT doc_id, decode(unhex(string_agg(h, '' ORDER BY i))) AS text FROM v JOIN hx USING (c) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(symbols, 0) END::INT AS symbols, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN t USING (doc_id)""")
def byte_recovery(spark, d):
    """Texts as byte symbols, every seventh of which is lost, and what can be recovered of them."""
    t = table(spark, d, "documents").select("doc_id", X.to_byte_symbols(F.col("text")).alias("whole"))
    broken = F.regexp_replace("whole", "(.{6}).", "$1")
    return t.select("doc_id", F.length("whole").alias("symbols"), X.from_byte_symbols(broken).alias("text"))


@query("cjk_splitting", "SELECT n_nationkey, array_to_string(regexp_extract_all(regexp_replace(n_name || '漢字かな ' || n_nationkey || 'テスト', '([\\x{1100}-\\x{11FF}\\x{2E80}-\\x{A4CF}])', ' \\1 ', 'g'), '\\S+'), '|') AS tokens FROM nation")
def cjk_splitting(spark, d):
    """CJK characters as words of their own."""
    s = F.concat("n_name", F.lit("漢字かな "), F.col("n_nationkey").cast("string"), F.lit("テスト"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(X.cjk_tokens(s), "|").alias("tokens"))


@query("padding_masks", "SELECT o_orderkey, array_to_string(list_transform(range(0, 7), lambda i: (i >= count(*))::INT::VARCHAR), '') AS mask FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def padding_masks(spark, d):
    t = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return t.select("o_orderkey", F.array_join(F.transform(X.padding_mask(F.col("n"), F.lit(7)), lambda x: x.cast("int").cast("string")), "").alias("mask"))

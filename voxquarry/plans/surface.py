"""Registered functions, the model hook, lookups and stores: small operators, each through the function that a user calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxquarry.functions import registry, text
from voxquarry.plans.alignment import SCORE
from voxquarry.plans.registry import query, table
from voxquarry.plans.scoring import TURN_PAIRS
from voxquarry.plans.text import MALAY
from voxquarry.scratch import shared_path
from voxquarry.sources import manifests


@query("registered_functions", f"WITH {MALAY} SELECT p_partkey, trim(w) AS said, levenshtein(p_name, p_name || 'x')::BIGINT AS edits FROM part JOIN w999 ON n = p_size + 100")
def registered_functions(spark, d):
    """SQL that calls the library's functions."""
    registry.register(spark)
    table(spark, d, "part").createOrReplaceTempView("voxquarry_part")
    return spark.sql("SELECT p_partkey, number_in_malay(p_size + 100) AS said, word_distance(split(p_name, ''), split(concat(p_name, 'x'), '')) AS edits FROM voxquarry_part")


@query("registered_alignment", f"WITH RECURSIVE {TURN_PAIRS}, {SCORE} SELECT conv_id, turn, pos::INT AS pos, ref, hyp FROM p")
def registered_alignment(spark, d):
    """The table function beside a table."""
    registry.register(spark)
    table(spark, d, "conversations").createOrReplaceTempView("voxquarry_turns")
    return spark.sql("""SELECT u.conv_id, u.turn, w.pos, w.ref, w.hyp FROM voxquarry_turns u JOIN voxquarry_turns a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1,
      LATERAL align_words(lower(u.text), lower(a.text)) w WHERE u.role = 'user' AND a.role = 'assistant'""")


@query("model_hook", "SELECT event_id, value * 2 + 1 AS score FROM events")
def model_hook(spark, d):
    """Any scorer, pandas in and pandas out."""
    return registry.apply_model(table(spark, d, "events").select("event_id", "value"), lambda p: p.assign(score=p["value"] * 2 + 1)[["event_id", "score"]], "event_id long, score double")


@query("alignment_store", "SELECT user_id, list(event_id % 11 ORDER BY ts, event_id) AS tokens FROM events WHERE user_id % 3 = 0 GROUP BY user_id")
def alignment_store(spark, d):
    """Token lists by id, written and looked up by a list of ids."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda x: x["event_id"] % 11)
    path = shared_path(spark, "alignments")
    table(spark, d, "events").groupBy("user_id").agg(ids.alias("tokens")).write.parquet(path)
    wanted = table(spark, d, "events").where("user_id % 3 = 0").select("user_id").distinct()
    return spark.read.schema("user_id long, tokens array<bigint>").parquet(path).join(wanted, "user_id", "left_semi")


@query("tolerant_compare", """
WITH l AS (SELECT user_id, event_id, value, lag(value) OVER w AS before, [event_type, lag(event_type) OVER w] AS a, [lag(event_type) OVER w, event_type] AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, abs(value - before) < 5 AS near, a = b AS same FROM l WHERE before IS NOT NULL""")
def tolerant_compare(spark, d):
    """Numbers within a tolerance, and lists that are equal."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = table(spark, d, "events").select("event_id", "value", F.lag("value").over(w).alias("before"), "event_type", F.lag("event_type").over(w).alias("last")).where("before IS NOT NULL")
    return t.select("event_id", text.nearly(F.col("value"), F.col("before"), 5.0).alias("near"), (F.array("event_type", "last") == F.array("last", "event_type")).alias("same"))


@query("manifests_by_name", "SELECT event_id, event_type FROM events WHERE event_type NOT LIKE '%ic%'")
def manifests_by_name(spark, d):
    """Rows of the files whose names lack a part."""
    path = shared_path(spark, "named")
    table(spark, d, "events").select("event_id", "event_type", F.col("event_type").alias("name")).write.partitionBy("name").parquet(path)
    return manifests.without_name(spark.read.parquet(path), "ic").select("event_id", "event_type")


@query("metadata_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def metadata_lookup(spark, d):
    """A small table of facts beside a large one; nations and regions are fixed tables of a few rows."""
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("r_regionkey") == F.col("n_regionkey"))
    return table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name", "r_name")


@query("manifest_json", """SELECT conv_id, turn, '{"id":"' || conv_id || '-' || turn || '","duration":' || (length(text) / 16.0::DOUBLE)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || '}' AS line FROM conversations""")
def manifest_json(spark, d):
    """Manifest lines as valid JSON: quotes and line ends in texts are escaped."""
    row = F.struct(F.concat("conv_id", F.lit("-"), "turn").alias("id"), (F.length("text") / 16).alias("duration"), "text")
    return table(spark, d, "conversations").select("conv_id", "turn", F.to_json(row).alias("line"))


@query("ascii_folding", "SELECT doc_id, regexp_replace(strip_accents(lower(text)), '[^\\x00-\\x7F]', '', 'g') AS folded FROM documents")
def ascii_folding(spark, d):
    """Names and texts lower-cased, decomposed and without what isn't ASCII."""
    return table(spark, d, "documents").select("doc_id", text.fold_ascii_text(F.col("text")).alias("folded"))


MONTHS = "[" + ", ".join(f"'{m}'" for m in text.MONTHS) + "]"


@query("normalised_lines", f"""
WITH {MALAY}, o AS (SELECT o_orderkey, day(o_orderdate) AS dd, month(o_orderdate) AS mm, year(o_orderdate) AS yy, o_custkey % 900 + 1 AS rm, (o_orderkey * 37 % 100)::BIGINT AS sen, o_orderkey % 40 + 2 AS kg, o_custkey % 30 + 1 AS a, o_custkey % 30 + 1 + o_orderkey % 60 AS b, o_orderkey % 900 + 100 AS low FROM orders),
s AS (SELECT o.*, w1.w AS wd, trim(CASE WHEN yy >= 2000 THEN 'dua ribu ' ELSE 'seribu ' END || w2.w) AS wy, w3.w AS wrm, w4.w AS wsen, w5.w AS wkg, w6.w AS wa, w7.w AS wb, w8.w AS wlow, w9.w AS wm,
        CASE WHEN sen < 10 THEN d[1] || ' ' || d[sen + 1] ELSE d[sen // 10 + 1] || ' ' || d[sen % 10 + 1] END AS digits
  FROM (SELECT *, {"[" + ", ".join(f"'{x}'" for x in text.DIGITS) + "]"} AS d FROM o) o JOIN w999 w1 ON w1.n = dd JOIN w999 w2 ON w2.n = yy % 1000 JOIN w999 w3 ON w3.n = rm JOIN w999 w4 ON w4.n = sen JOIN w999 w5 ON w5.n = kg JOIN w999 w6 ON w6.n = a JOIN w999 w7 ON w7.n = b JOIN w999 w8 ON w8.n = low JOIN w999 w9 ON w9.n = mm)
SELECT o_orderkey,
  'pada ' || wd || ' ' || {MONTHS}[mm] || ' ' || wy || ' harga ' || wrm || ' ringgit' || CASE WHEN sen = 0 THEN '' ELSE ' ' || wsen || ' sen' END || ' untuk ' || wkg || ' perpuluhan ' || digits || ' kilogram ' || wa || ' hingga ' || wb || ' unit seribu ' || wlow || ' kali' AS gold,
  'pada ' || wd || ' ' || wm || ' ' || wy || ' harga rm ' || wrm || ' ' || CASE WHEN sen = 0 THEN 'kosong' ELSE wsen END || ' untuk ' || wkg || ' ' || CASE WHEN sen = 0 THEN 'kosong' ELSE wsen END || ' kg ' || wa || ' ' || wb || ' unit seribu ' || wlow || ' kali' AS plain FROM s""")
def normalised_lines(spark, d):
    """Lines with dates, money, units, decimals, ranges and thousands, in both styles of normalisation, numbers in words."""
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    number = lambda x: x.cast("long").cast("string")
    sen = F.lpad(number(k * 37 % 100), 2, "0")
    line = F.concat(F.lit("Pada "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(", harga RM"), number(c % 900 + 1), F.lit("."), sen, F.lit(" untuk "), number(k % 40 + 2), F.lit("."), sen,
                    F.lit("kg; "), number(c % 30 + 1), F.lit("-"), number(c % 30 + 1 + k % 60), F.lit(" UNIT (1,"), number(k % 900 + 100), F.lit(" kali)!"))
    t = table(spark, d, "orders").select("o_orderkey", line.alias("line"))
    return t.select("o_orderkey", text.normalise_sentence_gold(F.col("line")).alias("gold"), text.normalise_text(F.col("line")).alias("plain"))

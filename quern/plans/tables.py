"""The operators' inputs bound to the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as resources."""
    o = read(spark, sf_dir, "orders")
    digit = F.substring("o_orderpriority", 1, 1)
    fmt = F.when(digit == "1", "png").when(digit == "2", "jpeg").when(digit == "3", "webp").otherwise("png")
    return o.select(
        F.col("o_orderkey").alias("resource"), F.floor("o_totalprice").cast("long").alias("bytes"), fmt.alias("format"), (F.col("o_custkey") % 10 == 3).alias("extension_mismatch"),
        F.when(F.col("o_orderstatus") != "P", "candidates_available").otherwise("inspected").alias("status"), F.when(F.col("o_custkey") % 50 == 0, "app_icon").alias("exclusion"),
        F.when(F.col("o_custkey") % 20 == 1, "android_launcher_icon").alias("format_lock"), F.when(F.col("o_custkey") % 7 == 0, "assets").alias("area"),
        F.when(F.col("o_orderkey") % 11 == 0, "applied").otherwise("original").alias("state"), (F.col("o_orderkey") % 13 == 0).alias("missing"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as candidates of the orders. Savings need the original's size, the one column that is joined in."""
    c = read(spark, sf_dir, "lineitem")
    size = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.floor("o_totalprice").cast("long").alias("original"))
    new = F.floor("l_extendedprice").cast("long")
    return c.join(size, "l_orderkey").select(
        F.col("l_orderkey").alias("resource"), F.col("l_linenumber").alias("candidate"), F.when(F.col("l_returnflag") == "A", "png").when(F.col("l_returnflag") == "N", "webp").otherwise("jpeg").alias("format"),
        (F.col("l_suppkey") % 2 == 0).alias("lossy"), new.alias("bytes"), F.greatest(F.col("original") - new, F.lit(0)).alias("savings_bytes"),
        F.when(F.col("l_partkey") % 17 != 0, F.col("l_quantity") * 2).alias("score"), F.col("l_tax").alias("alpha_error"), (F.col("l_partkey") % 9 == 0).alias("transparency_changed"),
    )


RESOURCES_SQL = """
res AS (
  SELECT o_orderkey AS resource, floor(o_totalprice)::BIGINT AS bytes,
    CASE left(o_orderpriority, 1) WHEN '1' THEN 'png' WHEN '2' THEN 'jpeg' WHEN '3' THEN 'webp' ELSE 'png' END AS format,
    o_custkey % 10 = 3 AS extension_mismatch, CASE WHEN o_orderstatus <> 'P' THEN 'candidates_available' ELSE 'inspected' END AS status,
    CASE WHEN o_custkey % 50 = 0 THEN 'app_icon' END AS exclusion, CASE WHEN o_custkey % 20 = 1 THEN 'android_launcher_icon' END AS format_lock,
    CASE WHEN o_custkey % 7 = 0 THEN 'assets' END AS area, CASE WHEN o_orderkey % 11 = 0 THEN 'applied' ELSE 'original' END AS state, o_orderkey % 13 = 0 AS missing
  FROM orders)"""
CANDIDATES_SQL = """
raw AS (
  SELECT l_orderkey AS resource, l_linenumber AS candidate, CASE l_returnflag WHEN 'A' THEN 'png' WHEN 'N' THEN 'webp' ELSE 'jpeg' END AS format,
    l_suppkey % 2 = 0 AS lossy, floor(l_extendedprice)::BIGINT AS bytes, greatest(floor(o_totalprice)::BIGINT - floor(l_extendedprice)::BIGINT, 0) AS savings_bytes,
    CASE WHEN l_partkey % 17 <> 0 THEN l_quantity * 2 END AS score, l_tax AS alpha_error, l_partkey % 9 = 0 AS transparency_changed
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
wrn AS (
  SELECT *, savings_bytes >= 1 AS smaller, CASE WHEN savings_bytes >= 1 THEN list_filter([
      CASE WHEN alpha_error > 0.06 THEN 'alpha_error_exceeds_policy' END, CASE WHEN transparency_changed THEN 'transparency_presence_changed' END,
      CASE WHEN lossy AND score < 30 THEN 'quality_below_policy' END], lambda w: w IS NOT NULL) ELSE [] END AS warnings FROM raw),
cand AS (
  SELECT *, CASE WHEN NOT smaller THEN 'not_smaller' ELSE warnings[1] END AS rejection, smaller AND len(warnings) = 0 AS valid, smaller AS artifact FROM wrn)"""

#: What localization texts begin with, by doc_id modulo 7.
VALUES = ["", "n %d ", "n %@ ", "%1$s of %2$d ", "%ld items ", "5% bonus ", "plain %f "]


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as localization entries: four neighbours share a key, so keys grow with the table, and the text is the document's own."""
    d = read(spark, sf_dir, "documents")
    start = F.get(F.array(*[F.lit(v) for v in VALUES]), (F.col("doc_id") % 7).cast("int"))
    value = F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(start, F.coalesce("text", F.lit(""))))
    return d.select(
        F.col("lang").alias("language"), F.concat(F.lit("k"), F.floor(F.col("doc_id") / 4).cast("string")).alias("key"),
        F.when(F.col("doc_id") % 31 == 0, "plural").when(F.col("doc_id") % 29 == 0, "empty").otherwise("singular").alias("value_kind"), value.alias("value"),
        F.when(F.col("doc_id") % 5 == 0, "needs_review").otherwise("translated").alias("status"), (F.col("doc_id") % 41 == 0).alias("stale"), (F.col("doc_id") % 97 != 0).alias("translatable"), F.col("doc_id").alias("seq"),
    )


_TOKENS = r"list_filter(regexp_extract_all(coalesce(value, ''), '%%|%(?:\d+\$)?[-+#0]*\d*(?:\.\d+)?(?:hh|h|ll|l|q|z|t|j|L)?[@diouxXeEfFgGaAcCsSp]'), lambda t: t <> '%%')"
_PLACED = "list_sort(list_transform(" + _TOKENS + r""", lambda t, i: {'place': coalesce(nullif(regexp_extract(t, '^%(\d+)\$', 1), '')::INT, i::INT), 'letter': CASE WHEN right(t, 1) = '@' THEN 's' ELSE right(t, 1) END}))"""
ENTRIES_SQL = f"""
ent0 AS (
  SELECT lang AS language, 'k' || (doc_id // 4)::VARCHAR AS key, CASE WHEN doc_id % 31 = 0 THEN 'plural' WHEN doc_id % 29 = 0 THEN 'empty' ELSE 'singular' END AS value_kind,
    CASE WHEN doc_id % 11 = 0 THEN '' ELSE {VALUES!r}[(doc_id % 7)::INT + 1] || coalesce(text, '') END AS value, CASE WHEN doc_id % 5 = 0 THEN 'needs_review' ELSE 'translated' END AS status, doc_id % 41 = 0 AS stale, doc_id % 97 <> 0 AS translatable, doc_id AS seq FROM documents),
ent AS (SELECT * FROM ent0 QUALIFY row_number() OVER (PARTITION BY language, key ORDER BY seq DESC) = 1),
src AS (SELECT * FROM ent WHERE language = 'en'),
bar AS (SELECT DISTINCT key FROM ent WHERE NOT translatable),
keys AS (SELECT DISTINCT key FROM src WHERE key NOT IN (SELECT key FROM bar)),
placed AS (SELECT *, {_PLACED} AS placed FROM ent),
sig AS (SELECT *, list_transform(placed, lambda a: '%' || a.place || '$' || a.letter) AS shown,
    list_transform(placed, lambda a: a.place::VARCHAR || CASE WHEN lower(a.letter) IN ('d','i','u','o','x') THEN 'd' WHEN lower(a.letter) IN ('f','e','g','a') THEN 'f' ELSE lower(a.letter) END) AS args FROM placed),
cell AS (
  SELECT l.language, k.key, e.value, e.args AS found, o.args AS expected, array_to_string(o.shown, ' ') AS shown_expected, array_to_string(e.shown, ' ') AS shown_found,
    CASE WHEN e.key IS NULL THEN 'missing' WHEN e.value_kind = 'singular' AND e.value = '' THEN 'empty' WHEN e.value_kind IN ('singular', 'plural') THEN 'translated' ELSE 'missing' END AS outcome,
    e.status IN ('needs_review', 'stale') AS review, e.value_kind = 'singular' AND l.language <> 'en' AND o.key IS NOT NULL AS compared
  FROM keys k CROSS JOIN (SELECT DISTINCT language FROM ent) l LEFT JOIN sig e ON e.language = l.language AND e.key = k.key
  LEFT JOIN sig o ON o.language = 'en' AND o.key = k.key AND o.value_kind = 'singular'),
chk AS (
  SELECT *, CASE WHEN outcome = 'empty' THEN 'empty_value' WHEN outcome = 'translated' AND compared AND expected <> found THEN
    CASE WHEN list_transform(expected, lambda x: regexp_replace(x, '[^0-9]', '', 'g')) = list_transform(found, lambda x: regexp_replace(x, '[^0-9]', '', 'g')) THEN 'placeholder_type' ELSE 'placeholder_count' END END AS issue FROM cell)"""

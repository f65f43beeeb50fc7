"""Queries on packages and archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import archive, diff
from quern.plans.tables import read

_DAY = "1998-01-01"


def _packages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("name"), "l_shipdate", F.col("l_quantity").cast("long").alias("q"))
    side = lambda test: items.where(test).groupBy("name").agg(F.sum("q").alias("compressed_bytes"))
    return side(F.col("l_shipdate") < F.lit(_DAY).cast("timestamp")), side(F.col("l_shipdate") >= F.lit(_DAY).cast("timestamp"))


_PACKAGES_SQL = f"""
WITH x AS (SELECT l_partkey::VARCHAR AS name, l_shipdate < TIMESTAMP '{_DAY}' AS old, sum(l_quantity::BIGINT)::BIGINT AS b FROM lineitem GROUP BY ALL),
d AS (SELECT coalesce(o.name, n.name) AS name, o.b AS before_bytes, n.b AS after_bytes, abs(coalesce(n.b, 0) - coalesce(o.b, 0)) AS delta
  FROM (SELECT * FROM x WHERE old) o FULL JOIN (SELECT * FROM x WHERE NOT old) n ON o.name = n.name WHERE o.b IS DISTINCT FROM n.b)
"""


def package_diff_entries(spark, sf_dir):
    return diff.largest_first(diff.package_diff(*_packages(spark, sf_dir)))


def package_diff_top(spark, sf_dir):
    return diff.largest_first(diff.package_diff(*_packages(spark, sf_dir)), 20)


def package_diff_totals(spark, sf_dir):
    return diff.package_totals(*_packages(spark, sf_dir))


def _entries(spark, sf_dir):
    """Lines as entries of their orders, a thousand bytes for each unit of price, so that some break a limit."""
    i = read(spark, sf_dir, "lineitem")
    return i.select(F.col("l_orderkey").alias("archive"), F.col("l_linenumber").cast("string").alias("name"), (F.floor("l_extendedprice") * 1000).cast("long").alias("bytes"), F.col("l_quantity").cast("long").alias("compressed"))


def archive_totals(spark, sf_dir):
    return archive.totals(_entries(spark, sf_dir))


def archive_top32(spark, sf_dir):
    byday = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("archive"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("name"), F.floor("l_extendedprice").cast("long").alias("bytes"))
    return archive.largest_entries(byday)


def prefix_conflicts(spark, sf_dir):
    """Archives by brand: some entries are files whose names are folders of others, in other letters."""
    word = F.get(F.split("p_name", " "), F.lit(0))
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper(word)).when(F.col("p_partkey") % 7 == 0, F.concat(word, F.lit("/"))).otherwise(F.concat(word, F.lit("/"), (F.col("p_partkey") % 4).cast("string")))
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("archive"), name.alias("name"))
    return archive.prefix_conflicts(p)


def entry_names(spark, sf_dir):
    """Safe, metadata and rewrite-blocking names among paths made of part names."""
    from quern.functions import classify

    p = read(spark, sf_dir, "part")
    name = F.concat(F.get(F.array(*map(F.lit, ["", "__MACOSX/", "META-INF/", "../", "x/META-INF/", "a_CodeSignature/"])), (F.col("p_partkey") % 6).cast("int")), F.replace(F.col("p_type"), F.lit(" "), F.lit("/")), F.get(F.array(*map(F.lit, ["", "/manifest.json", ".sig", "/._x"])), (F.col("p_partkey") % 4).cast("int")))
    p = p.select("p_partkey", name.alias("name"))
    return p.select("p_partkey", "name", classify.safe_entry_name(F.col("name")).alias("safe"), classify.is_archive_metadata(F.col("name")).alias("metadata"), classify.blocks_rewrite(F.col("name")).alias("blocks"))


QUERIES = {f.__name__: f for f in (package_diff_entries, package_diff_top, package_diff_totals, archive_totals, archive_top32, prefix_conflicts, entry_names)}
ORACLE_SQL = {
    "package_diff_entries": _PACKAGES_SQL + "SELECT * FROM d ORDER BY delta DESC, name",
    "package_diff_top": _PACKAGES_SQL + "SELECT * FROM d ORDER BY delta DESC, name LIMIT 20",
    "package_diff_totals": _PACKAGES_SQL + """SELECT count(*) FILTER (before_bytes IS NULL)::BIGINT AS added, count(*) FILTER (after_bytes IS NULL)::BIGINT AS removed,
      count(*) FILTER (before_bytes IS NOT NULL AND after_bytes IS NOT NULL)::BIGINT AS changed, (SELECT sum(b)::BIGINT FROM x WHERE old) AS before_compressed_bytes, (SELECT sum(b)::BIGINT FROM x WHERE NOT old) AS after_compressed_bytes FROM d""",
    "archive_totals": """SELECT l_orderkey AS archive, count(*)::BIGINT AS entries, sum(floor(l_extendedprice)::BIGINT * 1000)::BIGINT AS expanded_bytes, sum(l_quantity::BIGINT)::BIGINT AS compressed_bytes, max(floor(l_extendedprice)::BIGINT * 1000) AS largest,
      CASE WHEN count(*) > 10000 THEN 'too_many_entries' WHEN max(floor(l_extendedprice) * 1000) > 67108864 THEN 'entry_too_large' WHEN sum(floor(l_extendedprice) * 1000) > 268435456 THEN 'archive_too_large' END AS problem FROM lineitem GROUP BY 1""",
    "archive_top32": """SELECT * FROM (SELECT l_suppkey AS archive, l_orderkey || '-' || l_linenumber AS name, floor(l_extendedprice)::BIGINT AS bytes,
      row_number() OVER (PARTITION BY l_suppkey ORDER BY floor(l_extendedprice)::BIGINT DESC, l_orderkey || '-' || l_linenumber)::INTEGER AS rank FROM lineitem) WHERE rank <= 32""",
    "prefix_conflicts": """WITH n AS (SELECT DISTINCT p_brand AS archive, CASE WHEN p_partkey % 3 = 0 THEN upper(split_part(p_name, ' ', 1)) WHEN p_partkey % 7 = 0 THEN split_part(p_name, ' ', 1) || '/' ELSE split_part(p_name, ' ', 1) || '/' || (p_partkey % 4) END AS name FROM part)
      SELECT archive, name FROM n a WHERE NOT suffix(name, '/') AND EXISTS (SELECT 1 FROM n b WHERE b.archive = a.archive AND starts_with(lower(b.name), lower(a.name) || '/'))""",
    "entry_names": r"""WITH n AS (SELECT p_partkey, ['', '__MACOSX/', 'META-INF/', '../', 'x/META-INF/', 'a_CodeSignature/'][(p_partkey % 6)::INT + 1] || replace(p_type, ' ', '/') || ['', '/manifest.json', '.sig', '/._x'][(p_partkey % 4)::INT + 1] AS name FROM part)
      SELECT p_partkey, name, name <> '' AND strlen(name) <= 1024 AND NOT contains(name, ':') AND NOT contains(name, '\') AND len(list_filter(string_split(name, '/'), lambda p: p IN ('', '.', '..'))) = 0 AS safe,
      regexp_matches(name, '(^|/)(__MACOSX(/|$)|\.DS_Store$|\._[^/]*$)') AS metadata, list_contains(['manifest.json', 'pack-info.json', 'sniff.json'], split_part(lower(name), '/', -1)) OR starts_with(lower(name), 'meta-inf/') OR contains(lower(name), '_codesignature/') OR suffix(lower(name), '.sig') OR suffix(lower(name), '.signature') AS blocks FROM n""",
}

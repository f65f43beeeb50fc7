"""Queries on localization."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import localization as l10n
from quern.operators import usage
from quern.plans.tables import ENTRIES_SQL, entries, read

SOURCE = "en"


def _entries(spark, sf_dir):
    return l10n.last_wins(entries(spark, sf_dir))


def language_coverage(spark, sf_dir):
    return l10n.coverage(_entries(spark, sf_dir), SOURCE).orderBy(F.col("language") != SOURCE, "language")


def extra_keys(spark, sf_dir):
    return l10n.extra_keys(_entries(spark, sf_dir), SOURCE)


def missing_keys(spark, sf_dir):
    return l10n.cells(_entries(spark, sf_dir), SOURCE).where(F.col("outcome") == "missing").select("language", "key")


def issues_top500(spark, sf_dir):
    return l10n.issues(_entries(spark, sf_dir), SOURCE).orderBy("key", "language").limit(l10n.MAX_ISSUES)


def issue_counts(spark, sf_dir):
    return l10n.issues(_entries(spark, sf_dir), SOURCE).groupBy("kind").agg(F.count("*").alias("n"))


def stale_keys(spark, sf_dir):
    return l10n.stale_keys(_entries(spark, sf_dir), SOURCE)


def source_language(spark, sf_dir):
    return l10n.source_language(_entries(spark, sf_dir).where(F.col("language") != "en"))


def placeholder_mismatch(spark, sf_dir):
    texts = lambda n: F.get(F.array(*map(F.lit, ["%d of %s", "%1$d of %2$@", "%2$s at %1$ld", "100% done", "%f%%", "%u", "%.2f and %@"])), (F.col("p_partkey") % n).cast("int"))
    p = read(spark, sf_dir, "part").select("p_partkey", texts(7).alias("source"), texts(5).alias("translation"))
    expected, found = l10n.arguments(F.col("source")), l10n.arguments(F.col("translation"))
    return p.select("p_partkey", F.array_join(expected, " ").alias("expected"), F.array_join(found, " ").alias("found"), l10n.argument_mismatch(expected, found).alias("kind"))


def shared_language_labels(spark, sf_dir):
    n = read(spark, sf_dir, "nation").select(F.lit("t").alias("table"), F.substring("n_name", 1, 1).alias("language"), F.col("n_name").alias("folder"))
    return l10n.distinguish_shared(n)


def values_qualifiers(spark, sf_dir):
    names = ["values", "values-fr", "values-fr-rCA", "values-car", "values-b+sr+Latn-night", "values-night-v21", "values-en-land-rUS", "values-zh-rTW-hdpi"]
    p = read(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names)).cast("int")).alias("folder"))
    return p.select("p_partkey", l10n.non_locale_qualifiers(F.col("folder")).alias("qualifiers"))


def _names_and_files(spark, sf_dir):
    """Every part is a name, and a file that uses three names in its own way: XML, Kotlin, Java or something else."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    name = lambda k: F.concat(F.lit("n"), k.cast("string"))
    names = p.select(F.lit("string").alias("type"), name(F.col("k")).alias("name"))
    a, b, c = name(F.floor(F.col("k") / 2)), name(F.col("k") % 57), name(F.col("k") % 7)
    xml = F.concat(F.lit('<t a="@string/'), a, F.lit('" b="@+string/'), b, F.lit('" c="@android:string/'), c, F.lit('" d="@drawable/'), a, F.lit('"/>R.string.'), a)
    code = F.concat(F.lit("f(R.string."), a, F.lit(", R . string\n . "), b, F.lit(", xR.string."), c, F.lit(", R.string."), c, F.lit("_x) @string/"), a, F.when(F.col("k") % 100 < 4, " getIdentifier(x)").otherwise(""))
    kind = F.get(F.array(*map(F.lit, ["xml", "kt", "java", "md"])), (F.col("k") % 4).cast("int"))
    files = p.select(F.concat(F.lit("src/f"), F.lpad(F.col("k").cast("string"), 8, "0"), F.lit("."), kind).alias("path"), F.when(kind == "xml", xml).otherwise(code).alias("text"))
    return names, files


def usage_counts(spark, sf_dir):
    """Uses of all parts' names in files made of all parts."""
    out = usage.usage(*_names_and_files(spark, sf_dir))
    return out.select("type", "name", "xml_references", "code_references", F.array_join("files", ",").alias("files"), "dynamic_lookup_files")


def name_uniqueness(spark, sf_dir):
    """Uniqueness of file names and lookup names among paths made of parts."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    name = F.concat(F.when(F.col("k") % 2 == 0, "Icon").otherwise("icon"), F.floor(F.col("k") / 3).cast("string"), F.get(F.array(*map(F.lit, ["", "@2x", "@3x"])), (F.col("k") % 3).cast("int")), F.when(F.col("k") % 5 == 0, ".txt").otherwise(".png"))
    return usage.uniqueness(p.select(F.concat(F.lit("d"), (F.col("k") % 11).cast("string"), F.lit("/"), name).alias("path")).distinct())


QUERIES = {f.__name__: f for f in (language_coverage, extra_keys, missing_keys, issues_top500, issue_counts, stale_keys, source_language, placeholder_mismatch, shared_language_labels, values_qualifiers, usage_counts, name_uniqueness)}
_BASE = "WITH" + ENTRIES_SQL
_SIG = r"list_transform(list_sort(list_transform(list_filter(regexp_extract_all({0}, '%%|%(?:\d+\$)?[-+#0]*\d*(?:\.\d+)?(?:hh|h|ll|l|q|z|t|j|L)?[@diouxXeEfFgGaAcCsSp]'), lambda t: t <> '%%'), lambda t, i: {{'place': coalesce(nullif(regexp_extract(t, '^%(\d+)\$', 1), '')::INT, i::INT), 'kind': CASE WHEN lower(right(t, 1)) IN ('d','i','u','o','x') THEN 'd' WHEN lower(right(t, 1)) IN ('f','e','g','a') THEN 'f' WHEN lower(right(t, 1)) IN ('@','s') THEN 's' ELSE lower(right(t, 1)) END}})), lambda a: a.place::VARCHAR || a.kind)"
_ARRAY = "['%d of %s', '%1$d of %2$@', '%2$s at %1$ld', '100% done', '%f%%', '%u', '%.2f and %@']"
_EXTRA = "SELECT language, key FROM ent WHERE language <> 'en' AND key NOT IN (SELECT key FROM src) AND key NOT IN (SELECT key FROM bar)"
ORACLE_SQL = {
    "language_coverage": _BASE + f""", x AS ({_EXTRA}) SELECT language, count(*) FILTER (outcome = 'translated')::BIGINT AS translated, count(*) FILTER (outcome = 'missing')::BIGINT AS missing, count(*) FILTER (outcome = 'empty')::BIGINT AS empty,
      count(*) FILTER (outcome = 'translated' AND review)::BIGINT AS needs_review, count(issue)::BIGINT AS issues, (SELECT count(*)::BIGINT FROM x WHERE x.language = chk.language) AS extra FROM chk GROUP BY language""",
    "extra_keys": _BASE + " " + _EXTRA,
    "missing_keys": _BASE + " SELECT language, key FROM chk WHERE outcome = 'missing'",
    "issues_top500": _BASE + """ SELECT issue AS kind, key, language, CASE WHEN issue = 'empty_value' THEN '' ELSE shown_expected END AS expected, CASE WHEN issue = 'empty_value' THEN '' ELSE shown_found END AS found,
      CASE WHEN length(value) > 160 THEN left(value, 160) || '…' ELSE value END AS text FROM chk WHERE issue IS NOT NULL ORDER BY key, language LIMIT 500""",
    "issue_counts": _BASE + " SELECT issue AS kind, count(*)::BIGINT AS n FROM chk WHERE issue IS NOT NULL GROUP BY 1",
    "stale_keys": _BASE + " SELECT count(*)::BIGINT AS stale_keys FROM keys WHERE key IN (SELECT key FROM ent WHERE stale)",
    "source_language": _BASE + " SELECT language FROM ent WHERE language <> 'en' GROUP BY 1 ORDER BY count(*) DESC, language LIMIT 1",
    "placeholder_mismatch": f"""WITH t AS (SELECT p_partkey, {_SIG.format(_ARRAY + '[(p_partkey % 7)::INT + 1]')} AS a, {_SIG.format(_ARRAY + '[(p_partkey % 5)::INT + 1]')} AS b FROM part)
      SELECT p_partkey, array_to_string(a, ' ') AS expected, array_to_string(b, ' ') AS found, CASE WHEN a = b THEN NULL WHEN list_transform(a, lambda x: regexp_replace(x, '[^0-9]', '', 'g')) = list_transform(b, lambda x: regexp_replace(x, '[^0-9]', '', 'g')) THEN 'placeholder_type' ELSE 'placeholder_count' END AS kind FROM t""",
    "shared_language_labels": "SELECT 't' AS \"table\", n_name AS folder, CASE WHEN count(*) OVER (PARTITION BY left(n_name, 1)) > 1 THEN left(n_name, 1) || ' (' || n_name || ')' ELSE left(n_name, 1) END AS language FROM nation",
    "values_qualifiers": "SELECT p_partkey, ['', '', '', 'car', 'night', 'night-v21', 'land-rUS', 'hdpi'][(p_partkey % 8)::INT + 1] AS qualifiers FROM part",
    "usage_counts": """WITH p AS (SELECT p_partkey AS k, p_partkey % 4 AS t, 'src/f' || lpad(p_partkey::VARCHAR, 8, '0') || '.' || ['xml', 'kt', 'java', 'md'][(p_partkey % 4)::INT + 1] AS path FROM part),
      u AS (SELECT 'n' || (k // 2) AS name, path, t FROM p WHERE t < 3 UNION ALL SELECT 'n' || (k % 57), path, t FROM p WHERE t < 3 UNION ALL SELECT 'n' || (k % 7), path, t FROM p WHERE t = 0),
      g AS (SELECT name, count(*) FILTER (t = 0)::BIGINT AS x, count(*) FILTER (t > 0)::BIGINT AS c, array_to_string(list_sort(list(DISTINCT path))[1:20], ',') AS files FROM u GROUP BY 1)
      SELECT 'string' AS type, 'n' || k AS name, coalesce(x, 0)::BIGINT AS xml_references, coalesce(c, 0)::BIGINT AS code_references, coalesce(files, '') AS files, (SELECT count(*) FILTER (k % 100 < 4 AND t IN (1, 2))::BIGINT FROM p) AS dynamic_lookup_files FROM p LEFT JOIN g ON g.name = 'n' || k""",
    "name_uniqueness": """WITH p AS (SELECT DISTINCT 'd' || (p_partkey % 11) || '/' || CASE WHEN p_partkey % 2 = 0 THEN 'Icon' ELSE 'icon' END || (p_partkey // 3) || ['', '@2x', '@3x'][(p_partkey % 3)::INT + 1] || CASE WHEN p_partkey % 5 = 0 THEN '.txt' ELSE '.png' END AS path FROM part),
      n AS (SELECT path, lower(split_part(path, '/', 2)) AS base, regexp_replace(lower(split_part(split_part(path, '/', 2), '.', 1)), '@[23]x$', '') AS lookup, path LIKE '%.png' AS image FROM p)
      SELECT path, NOT EXISTS (SELECT 1 FROM n b WHERE b.base = a.base AND b.path <> a.path) AS basename_unique, NOT EXISTS (SELECT 1 FROM n b WHERE b.image AND b.lookup = a.lookup AND b.path <> a.path) AS lookup_unique FROM n a""",
}

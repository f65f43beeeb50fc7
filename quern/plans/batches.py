"""Queries on candidates and batch plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import candidates as c
from quern.plans.tables import CANDIDATES_SQL, RESOURCES_SQL, candidates, read, resources

OPTIONS = c.AnalysisOptions(max_alpha_error=0.06, min_score=30)
POLICY = c.BatchPolicy(lossy=True, cross_format=True, min_score=20, accept_warnings=("quality_below_policy",))
STRICT = c.BatchPolicy()


def _judged(spark, sf_dir):
    return c.verdicts(candidates(spark, sf_dir), OPTIONS)


def candidate_verdicts(spark, sf_dir):
    return _judged(spark, sf_dir).select("resource", "candidate", F.array_join("warnings", ",").alias("warnings"), "rejection", "valid", c.is_warning().alias("is_warning"))


def smallest_candidate(spark, sf_dir):
    return c.smallest_candidate(_judged(spark, sf_dir))


def batch_plan_items(spark, sf_dir):
    return c.batch_items(resources(spark, sf_dir), _judged(spark, sf_dir), POLICY).orderBy(F.desc("savings_bytes"), "resource")


def batch_plan_totals(spark, sf_dir):
    return c.batch_totals(c.batch_items(resources(spark, sf_dir), _judged(spark, sf_dir), POLICY))


def batch_exclusion_reasons(spark, sf_dir):
    res, cand = resources(spark, sf_dir), _judged(spark, sf_dir)
    return c.exclusion_reasons(res, cand, c.batch_items(res, cand, STRICT), STRICT)


def batch_plan_token(spark, sf_dir):
    return c.plan_token(c.batch_items(resources(spark, sf_dir), _judged(spark, sf_dir), POLICY), repr(POLICY))


def batch_status(spark, sf_dir):
    """Outcome of a batch: items of every ninth resource fail, of every tenth are cancelled."""
    items = c.batch_items(resources(spark, sf_dir), _judged(spark, sf_dir), POLICY)
    outcome = F.when(F.col("resource") % 9 == 0, "failed").when(F.col("resource") % 10 == 0, "cancelled").otherwise("applied")
    return c.batch_status(items.withColumn("outcome", outcome))


def recommended_savings(spark, sf_dir):
    return c.recommended(_judged(spark, sf_dir))


def preferred_candidates(spark, sf_dir):
    """The candidate to show first, in the warnings view; the third is the applied one."""
    res = resources(spark, sf_dir).select("resource", "state", F.lit(3).alias("applied_candidate"))
    return c.preferred(res, _judged(spark, sf_dir), warnings_view=True)


def legacy_plan_thresholds(spark, sf_dir):
    i = read(spark, sf_dir, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("path"), F.floor("l_extendedprice").cast("long").alias("bytes"), F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("long").alias("new_bytes"))
    return c.thresholds(i, 20_000, 1_024, 4.0)


def legacy_plan_savings(spark, sf_dir):
    t = legacy_plan_thresholds(spark, sf_dir)
    return t.groupBy("reason").agg(F.count("*").alias("n"), F.sum("savings").alias("savings"))


_TRIALS = [("png", False, None), ("png", True, 85), ("jpeg", True, 85), ("webp", False, None), ("webp", True, 85)]


def trial_matrix(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("resource"), (F.col("p_size") % 9 == 0).alias("locked"), (F.col("p_size") % 2 == 0).alias("alpha"), (F.col("p_size") % 5 == 0).alias("catalog"), (F.col("p_size") % 3 == 0).alias("android"), F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 25).alias("min_sdk"))
    q = spark.createDataFrame(_TRIALS, "format string, lossy boolean, quality int")
    return c.trials(p, q).select("resource", "format", "lossy", "reason")


def trial_lists(spark, sf_dir):
    """parts as resources: the encodings that are tried, in order, and why others are not."""
    p = read(spark, sf_dir, "part")
    z = F.col("p_size")
    rows = p.select(F.col("p_partkey").alias("resource"), F.when(z % 3 == 0, "png").when(z % 3 == 1, "jpeg").otherwise("webp").alias("format"), F.when(z % 11 == 0, "android_nine_patch").alias("lock"), (z % 2 == 0).alias("alpha"), (z % 5 == 0).alias("catalog"), (z % 7 < 3).alias("android"), F.when(z % 4 != 0, z % 25).alias("min_sdk"))
    t = c.trial_lists(rows, c.TrialOptions(qualities=(90, 70), lossy_png=True, near_lossless=True))
    shown = F.transform("trials", lambda t: F.concat(t["format"], F.coalesce(t["quality"].cast("string"), F.lit("-"))))
    return t.select("resource", F.array_join(shown, ",").alias("trials"), F.array_join("issues", ",").alias("issues"))


def skip_dominated_trials(spark, sf_dir):
    i = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("resource"), F.lit("webp").alias("format"), F.col("l_linenumber").alias("quality"), F.floor("l_extendedprice").cast("long").alias("bytes"), F.lit(50_000).cast("long").alias("limit"))
    return c.skip_dominated(i)


QUERIES = {f.__name__: f for f in (candidate_verdicts, smallest_candidate, batch_plan_items, batch_plan_totals, batch_exclusion_reasons, batch_plan_token, batch_status, recommended_savings, preferred_candidates, legacy_plan_thresholds, legacy_plan_savings, trial_matrix, trial_lists, skip_dominated_trials)}

_BASE = "WITH" + RESOURCES_SQL + "," + CANDIDATES_SQL
_WARN = "NOT valid AND lossy AND artifact AND rejection IN ('alpha_error_exceeds_policy', 'transparency_presence_changed', 'quality_below_policy')"
_JOINED = f""",
j AS (SELECT c.*, r.bytes AS original_bytes, r.format_lock, r.area, c.format <> r.format OR r.extension_mismatch AS crossing, {_WARN} AS is_warning
  FROM cand c JOIN res r USING (resource) WHERE NOT r.missing AND r.status = 'candidates_available' AND r.exclusion IS NULL AND r.state = 'original')"""
_ITEMS = _JOINED + """,
items AS (SELECT resource, candidate, format, lossy, CASE WHEN is_warning THEN rejection END AS warning, original_bytes, savings_bytes, crossing FROM j
  WHERE artifact AND (valid OR (is_warning AND len(list_filter(warnings, lambda w: w <> 'quality_below_policy')) = 0)) AND NOT (crossing AND (format_lock IS NOT NULL OR coalesce(area = 'assets', false)))
    AND (NOT lossy OR coalesce(score >= 20, false)) QUALIFY row_number() OVER (PARTITION BY resource ORDER BY bytes, candidate) = 1)"""
_STRICT = _JOINED + f""",
items AS (SELECT DISTINCT resource FROM j WHERE artifact AND valid AND NOT lossy AND NOT crossing),
why AS (SELECT c.resource, c.candidate, list_filter([CASE WHEN lossy THEN 'lossy' END, CASE WHEN c.format <> r.format OR r.extension_mismatch THEN 'cross_format' END, CASE WHEN {_WARN} THEN 'warnings' END], lambda x: x IS NOT NULL) AS rs
  FROM cand c JOIN res r USING (resource) WHERE artifact AND (valid OR coalesce({_WARN}, false)) AND NOT missing AND r.status = 'candidates_available' AND exclusion IS NULL AND state <> 'applied'),
best AS (SELECT resource, array_to_string(rs, ',') AS told FROM why QUALIFY row_number() OVER (PARTITION BY resource ORDER BY len(rs), candidate, rs) = 1)
SELECT resource, CASE WHEN NOT missing AND state = 'applied' THEN 'applied' WHEN coalesce(told, '') <> '' THEN told ELSE 'unavailable' END AS reasons
FROM res LEFT JOIN best USING (resource) WHERE resource NOT IN (SELECT resource FROM items)"""
_PLAN = """WITH t AS (SELECT l_orderkey || '/' || l_linenumber AS path, floor(l_extendedprice)::BIGINT AS bytes, floor(l_extendedprice * (1 - l_discount))::BIGINT AS new_bytes FROM lineitem),
s AS (SELECT *, greatest(bytes - new_bytes, 0) AS savings FROM t),
p AS (SELECT *, CASE WHEN bytes < 20000 THEN 'input_too_small' WHEN new_bytes >= bytes THEN 'not_smaller' WHEN savings < 1024 OR savings * 100.0::DOUBLE / bytes < 4 THEN 'savings_too_small' END AS reason FROM s)
"""
ORACLE_SQL = {
    "candidate_verdicts": _BASE + f" SELECT resource, candidate, array_to_string(warnings, ',') AS warnings, rejection, valid, coalesce({_WARN}, false) AS is_warning FROM cand",
    "smallest_candidate": _BASE + """ SELECT resource, s.candidate AS smallest, s.bytes AS smallest_bytes FROM (SELECT DISTINCT resource FROM cand) LEFT JOIN
      (SELECT * FROM cand WHERE valid QUALIFY row_number() OVER (PARTITION BY resource ORDER BY bytes, candidate) = 1) s USING (resource)""",
    "batch_plan_items": _BASE + _ITEMS + " SELECT * FROM items",
    "batch_plan_totals": _BASE + _ITEMS + " SELECT count(*)::BIGINT AS items, coalesce(sum(savings_bytes), 0)::BIGINT AS savings_bytes, count(*) FILTER (lossy)::BIGINT AS lossy_items, count(warning)::BIGINT AS warning_items, count(*) FILTER (crossing)::BIGINT AS cross_format_items FROM items",
    "batch_exclusion_reasons": _BASE + _STRICT,
    "batch_plan_token": _BASE + _ITEMS + f""", part AS (SELECT resource // 10000 AS part, sha256('[' || string_agg('{{"resource":' || resource || ',"candidate":' || candidate || '}}', ',' ORDER BY resource, candidate) || ']') AS h FROM items GROUP BY 1)
      SELECT sha256('{repr(POLICY).replace("'", "''")}' || string_agg(h, '' ORDER BY part)) AS token FROM part""",
    "batch_status": _BASE + _ITEMS + """, o AS (SELECT *, CASE WHEN resource % 9 = 0 THEN 'failed' WHEN resource % 10 = 0 THEN 'cancelled' ELSE 'applied' END AS o FROM items)
      SELECT count(*) FILTER (o = 'applied')::BIGINT AS applied, count(*) FILTER (o = 'failed')::BIGINT AS failed, count(*) FILTER (o = 'cancelled')::BIGINT AS cancelled, coalesce(sum(savings_bytes) FILTER (o = 'applied'), 0)::BIGINT AS savings_bytes FROM o""",
    "recommended_savings": _BASE + " SELECT resource, candidate, savings_bytes FROM cand WHERE valid QUALIFY row_number() OVER (PARTITION BY resource ORDER BY bytes, candidate) = 1",
    "preferred_candidates": _BASE + f""", m AS (SELECT *, coalesce({_WARN}, false) AS w FROM cand), g AS (SELECT resource, arg_min(candidate, (bytes, candidate)) FILTER (w) AS sw, arg_min(candidate, (bytes, candidate)) FILTER (valid) AS v, min(candidate) FILTER (w) AS fw, min(candidate) AS f FROM m GROUP BY 1)
      SELECT resource, CASE WHEN state = 'applied' THEN 3 ELSE coalesce(sw, v, fw, f) END::INTEGER AS candidate FROM res LEFT JOIN g USING (resource)""",
    "legacy_plan_thresholds": _PLAN + "SELECT * FROM p",
    "legacy_plan_savings": _PLAN + "SELECT reason, count(*)::BIGINT AS n, sum(savings)::BIGINT AS savings FROM p GROUP BY 1",
    "trial_lists": """WITH p AS (SELECT p_partkey AS resource, CASE p_size % 3 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' ELSE 'webp' END AS f, CASE WHEN p_size % 11 = 0 THEN 'android_nine_patch' END AS lock, p_size % 2 = 0 AS alpha, p_size % 5 = 0 AS cat, p_size % 7 < 3 AS droid, CASE WHEN p_size % 4 <> 0 THEN p_size % 25 END AS sdk FROM part),
      g AS (SELECT *, CASE WHEN NOT droid THEN NULL WHEN sdk IS NULL THEN 'android_min_sdk_unknown' WHEN sdk < CASE WHEN alpha THEN 18 ELSE 14 END THEN 'android_min_sdk_' || sdk || '_below_webp_requirement_' || CASE WHEN alpha THEN 18 ELSE 14 END END AS g1,
        CASE WHEN NOT droid THEN NULL WHEN sdk IS NULL THEN 'android_min_sdk_unknown' WHEN sdk < 18 THEN 'android_min_sdk_' || sdk || '_below_webp_requirement_18' END AS g2, lock IS NULL AND NOT cat AS w FROM p)
      SELECT resource, array_to_string(list_filter([CASE WHEN f = 'png' THEN 'png-' END, CASE WHEN lock IS NULL AND f = 'png' THEN 'png70,png90' END, CASE WHEN lock IS NULL AND ((droid AND f = 'jpeg') OR (NOT droid AND NOT alpha)) THEN 'jpeg70,jpeg90' END,
        CASE WHEN lock IS NULL AND NOT droid THEN 'heic70,heic90,heic100' END, CASE WHEN w AND g1 IS NULL THEN 'webp70,webp90' END, CASE WHEN w AND f = 'png' AND g2 IS NULL THEN 'webp-' END], lambda t: t IS NOT NULL), ',') AS trials,
        array_to_string(list_filter([lock, CASE WHEN w THEN g1 END, CASE WHEN w AND f = 'png' AND (g1 IS NULL OR g2 <> g1) THEN g2 END], lambda t: t IS NOT NULL), ',') AS issues FROM g""",
    "trial_matrix": """WITH p AS (SELECT p_partkey AS resource, p_size % 9 = 0 AS locked, p_size % 2 = 0 AS alpha, p_size % 5 = 0 AS catalog, p_size % 3 = 0 AS android, CASE WHEN p_size % 4 <> 0 THEN p_size % 25 END AS sdk FROM part),
      t(format, lossy) AS (VALUES ('png', false), ('png', true), ('jpeg', true), ('webp', false), ('webp', true))
      SELECT resource, format, lossy, CASE WHEN format = 'png' AND NOT lossy THEN NULL WHEN locked THEN 'format_locked' WHEN format = 'jpeg' AND alpha THEN 'jpeg_has_no_alpha' WHEN format = 'webp' THEN
        CASE WHEN catalog THEN 'catalog_has_no_webp' WHEN android THEN CASE WHEN sdk IS NULL THEN 'android_min_sdk_unknown' WHEN sdk < CASE WHEN NOT lossy OR alpha THEN 18 ELSE 14 END
          THEN 'android_min_sdk_' || sdk || '_below_webp_requirement_' || CASE WHEN NOT lossy OR alpha THEN '18' ELSE '14' END END END END AS reason FROM p CROSS JOIN t""",
    "skip_dominated_trials": """WITH t AS (SELECT l_orderkey AS resource, l_linenumber AS quality, floor(l_extendedprice)::BIGINT AS bytes FROM lineitem),
      f AS (SELECT resource, min(quality) AS q FROM t WHERE bytes > 50000 * 1.05::DOUBLE GROUP BY 1)
      SELECT resource, 'webp' AS format, quality, coalesce(q < quality, false) AS skipped, CASE WHEN q < quality THEN q END AS by_quality FROM t LEFT JOIN f USING (resource)""",
}

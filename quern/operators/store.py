"""Results kept between runs, and plans matched against what is there now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.naming import safe_template


def cache_keys(resources: DataFrame, options: str, backend: str) -> DataFrame:
    """resources (sha256, policy, ...) with `key`: a hash of content, policy, options and backend; null without content."""
    return resources.withColumn("key", F.when(F.col("sha256").isNotNull(), F.sha2(F.concat_ws("|", "sha256", "policy", F.lit(options), F.lit(backend)), 256)))


def cache_lookup(resources: DataFrame, entries: DataFrame, files: DataFrame) -> DataFrame:
    """resources (resource, key), entries (key, schema, result), files (key, template, sha256, content_sha256) -> (resource, key, result, verdict).

    verdict: `hit`, `miss` (no entry), or `stale` for an entry whose files are of another content than it says, or of a
    name that is none: its result is not used, and the entry is to go.
    """
    bad = files.where(~F.coalesce(F.col("sha256") == F.col("content_sha256"), F.lit(False)) | ~F.coalesce(safe_template(F.col("template")), F.lit(False)))
    known = entries.where("schema = 1").select("key", "result", F.lit(True).alias("there")).dropDuplicates(["key"])
    broken = bad.select("key").distinct().withColumn("broken", F.lit(True))
    out = resources.select("resource", "key").join(known, "key", "left").join(broken, "key", "left")
    hit = F.coalesce("there", F.lit(False)) & ~F.coalesce("broken", F.lit(False))
    return out.select("resource", "key", F.when(hit, F.col("result")).alias("result"), F.when(hit, "hit").when(F.col("there"), "stale").otherwise("miss").alias("verdict"))


def cache_append(entries: DataFrame, path: str, known: DataFrame | None = None) -> None:
    """entries (key, ...) whose key is new, once each, as rows of the cache table, by the first two digits of the key. Rows are written by Spark's commit, so a table never shows half an entry."""
    fresh = entries.dropDuplicates(["key"])
    fresh = fresh.join(known.select("key"), "key", "left_anti") if known is not None else fresh
    fresh.withColumn("prefix", F.substring("key", 1, 2)).write.partitionBy("prefix").mode("append").parquet(path)


def cache_without(entries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Entries less those that a lookup found stale."""
    return entries.join(verdicts.where("verdict = 'stale'").select("key").distinct(), "key", "left_anti")


def reused_rows(rows: DataFrame, results: DataFrame) -> DataFrame:
    """rows (resource, owner), results (resource, ...) of the owners -> the owners' results for every row; artifact names stay the owner's."""
    return rows.join(results.withColumnRenamed("resource", "owner"), "owner").select("resource", "owner", *[c for c in results.columns if c != "resource"])


def plan_mismatches(plan: DataFrame, assets: DataFrame) -> DataFrame:
    """plan (path, contents_path, contents_sha256), assets as renditions() -> (path, problem) of candidates that can't be applied; one is enough to stop a whole plan."""
    now = assets.select("path", F.lit(True).alias("there"), "eligible", F.col("contents_path").alias("now_path"), F.col("contents_sha256").alias("now_sha256"))
    both = plan.join(now, "path", "left")
    same = F.col("eligible") & (F.col("now_path") == F.col("contents_path")) & (F.col("now_sha256") == F.col("contents_sha256"))
    problem = F.when(F.col("there").isNull(), "no longer referenced by a supported catalog").when(~F.coalesce(same, F.lit(False)), "eligibility or Contents.json changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def missing_resources(resources: DataFrame, present: DataFrame, converted: DataFrame) -> DataFrame:
    """resources (resource, path), present (path), converted (resource, target) -> the resources whose file is gone, but for those converted to another file that is there."""
    done = converted.join(present.select(F.col("path").alias("target")), "target", "left_semi").join(resources.select("resource", "path"), "resource").where("target <> path")
    return resources.join(present.select("path"), "path", "left_anti").join(done.select("resource"), "resource", "left_anti").select("resource", "path")


def apply_report(outcomes: DataFrame) -> DataFrame:
    """outcomes (changed, already_current, saved) -> one row: changed, already_current and source_bytes_saved."""
    return outcomes.agg(F.count_if("changed").alias("changed"), F.count_if("already_current").alias("already_current"), F.coalesce(F.sum(F.when(F.col("changed"), F.col("saved"))), F.lit(0).cast("long")).alias("source_bytes_saved"))

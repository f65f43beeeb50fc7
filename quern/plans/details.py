"""Queries on single rules: reasons, warnings, filters, ranks, backdrops, opacities, selections and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import classify
from quern.operators import archive, localization, report, similarity
from quern.operators import candidates as c
from quern.plans.tables import CANDIDATES_SQL, ENTRIES_SQL, RESOURCES_SQL, candidates, entries, read, resources
from quern.sources import reports as files
from quern.streaming import live

OPTIONS = c.AnalysisOptions(min_savings_bytes=1, max_alpha_error=0.06, min_score=30.0)


def _judged(spark, sf_dir):
    return c.verdicts(candidates(spark, sf_dir), OPTIONS)


def blocked_reasons(spark, sf_dir):
    """Why each candidate can't be applied as it is: the view's short reason."""
    r = resources(spark, sf_dir).select("resource", "exclusion", "format_lock", F.col("format").alias("original"))
    j = _judged(spark, sf_dir).join(r, "resource")
    why = classify.blocked_reason(F.col("smaller"), F.col("artifact"), F.col("exclusion"), F.col("format_lock"), F.col("format") != F.col("original"))
    return j.select("resource", "candidate", why.alias("reason"))


def required_warnings(spark, sf_dir):
    """The warnings that a user has to accept for each candidate."""
    return _judged(spark, sf_dir).select("resource", "candidate", F.array_join(c.required_warnings(), ",").alias("required"))


def issues_with_words(spark, sf_dir):
    """Placeholder mismatches with two words anywhere in the issue."""
    rows = localization.issues(localization.last_wins(entries(spark, sf_dir)), "en")
    return localization.issue_filter(rows, "k1 %", "placeholder_count").select("kind", "key", "language")


def archive_entry_filter(spark, sf_dir):
    """Pages as entries of an archive: those with a word in the path, of one format."""
    p = read(spark, sf_dir, "pages").select(F.concat(F.lit("Res/"), "url").alias("path"), F.when(F.col("page_id") % 3 == 0, "png").otherwise("json").alias("format"))
    return archive.entry_filter(p, " rES/HTTP ", "png")


def member_ranks(spark, sf_dir):
    """Each member's rank among groups: customers of one nation by their account balances."""
    m = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") * 10 + F.col("c_custkey") % 10).alias("reference"), F.floor("c_acctbal").alias("b"))
    ranks = similarity.rank_groups(m.groupBy("reference").agg(F.sum("b").alias("redundant_bytes")))
    return report.group_ranks(m, ranks)


def group_view(spark, sf_dir):
    """The first 300 groups in the order of the lowest score; those without come first."""
    g = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("reference"), F.col("s_name").alias("path"), F.floor("s_acctbal").alias("redundant_bytes"), F.floor("s_acctbal").alias("bytes"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey").cast("double")).alias("low"), F.col("s_suppkey").alias("rank"))
    return report.group_view(g, "score").limit(300).select("reference", "low", "rank")


def worst_backdrops(spark, sf_dir):
    """Line items as scores of candidates on backdrops: the worst of each, null if one is missing."""
    s = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("resource"), (F.col("l_linenumber") % 2).alias("candidate"), F.col("l_linenumber").alias("backdrop"), F.when(F.col("l_partkey") % 19 != 0, F.col("l_quantity")).alias("score"))
    return similarity.worst_backdrop(s)


def alpha_ranges(spark, sf_dir):
    """The opacities that each palette entry stands for."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("image"), F.col("event_type").alias("entry"), (F.floor(F.abs("value")) % 256).alias("alpha"))
    return similarity.alpha_snap(e)


def selected_resources(spark, sf_dir):
    """A selection with repeats and unknown resources."""
    wanted = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") + F.col("l_linenumber") % 2 * 1_000_000_000).alias("resource"))
    return c.selection(resources(spark, sf_dir), wanted)


def lottie_texts(spark, sf_dir):
    """Documents wrapped as JSON: which look like animations."""
    k = F.col("doc_id")
    text = F.when(k % 4 == 0, F.concat(F.lit(' {"v":"5","fr":30,"op":'), k.cast("string"), F.lit("}"))).when(k % 4 == 1, F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}"))).when(k % 4 == 2, F.lit('["v","fr","op"]')).otherwise(F.substring("text", 1, 200))
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce(classify.looks_like_lottie(text), F.lit(False)).alias("lottie"))


def text_lines(spark, sf_dir):
    """Resources as tab-separated lines."""
    return files.rows_as_text(resources(spark, sf_dir).select("resource", "bytes", "format", "exclusion", "missing"))


def batch_progress(spark, sf_dir):
    """Line items as outcomes of their order's batch."""
    o = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), F.when(F.col("l_partkey") % 23 == 0, "cancelled").when(F.col("l_returnflag") == "A", "failed").otherwise("applied").alias("outcome"), F.floor("l_extendedprice").alias("savings_bytes"))
    plans = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch"), (F.col("o_orderkey") % 6 + 1).alias("total"))
    return live.batch_progress(o, plans)


QUERIES = {f.__name__: f for f in (blocked_reasons, required_warnings, issues_with_words, archive_entry_filter, member_ranks, group_view, worst_backdrops, alpha_ranges, selected_resources, lottie_texts, text_lines, batch_progress)}
ORACLE_SQL = {
    "blocked_reasons": f"""WITH {RESOURCES_SQL}, {CANDIDATES_SQL} SELECT c.resource, c.candidate, CASE WHEN NOT smaller THEN 'no_smaller_candidate' WHEN NOT artifact THEN 'failed_verification' WHEN exclusion IS NOT NULL THEN exclusion WHEN format_lock IS NOT NULL AND c.format <> r.format THEN format_lock ELSE '' END AS reason
      FROM cand c JOIN res r USING (resource)""",
    "required_warnings": f"WITH {CANDIDATES_SQL} SELECT resource, candidate, CASE WHEN NOT valid AND lossy AND artifact AND len(warnings) > 0 THEN array_to_string(warnings, ',') ELSE '' END AS required FROM cand",
    "issues_with_words": f"""WITH {ENTRIES_SQL}, i AS (SELECT key, language, lower(concat_ws(' ', key, language, CASE WHEN length(value) > 160 THEN left(value, 160) || '…' ELSE value END, shown_expected, shown_found)) AS t FROM chk WHERE issue = 'placeholder_count')
      SELECT 'placeholder_count' AS kind, key, language FROM i WHERE contains(t, 'k1') AND contains(t, '%')""",
    "archive_entry_filter": "SELECT 'Res/' || url AS path, 'png' AS format FROM pages WHERE page_id % 3 = 0 AND contains(lower('Res/' || url), 'res/http')",
    "member_ranks": """WITH m AS (SELECT c_custkey AS id, c_nationkey * 10 + c_custkey % 10 AS reference, floor(c_acctbal)::BIGINT AS b FROM customer), g AS (SELECT reference, row_number() OVER (ORDER BY sum(b) DESC, reference)::INTEGER AS rank FROM m GROUP BY 1)
      SELECT id, rank FROM m JOIN g USING (reference)""",
    "group_view": "SELECT s_suppkey AS reference, CASE WHEN s_suppkey % 3 <> 0 THEN s_nationkey::DOUBLE END AS low, s_suppkey AS rank FROM supplier ORDER BY coalesce(low, -1), s_suppkey LIMIT 300",
    "worst_backdrops": "SELECT l_orderkey AS resource, l_linenumber % 2 AS candidate, CASE WHEN count(*) FILTER (l_partkey % 19 = 0) = 0 THEN min(l_quantity) END AS score FROM lineitem GROUP BY 1, 2",
    "alpha_ranges": "SELECT user_id AS image, event_type AS entry, min(floor(abs(value))::BIGINT % 256) AS low, max(floor(abs(value))::BIGINT % 256) AS high FROM events GROUP BY 1, 2",
    "selected_resources": "WITH w AS (SELECT DISTINCT l_orderkey + l_linenumber % 2 * 1000000000 AS resource FROM lineitem) SELECT resource, resource IN (SELECT o_orderkey FROM orders) AS known FROM w",
    "lottie_texts": "SELECT doc_id, doc_id % 4 = 0 AS lottie FROM documents",
    "text_lines": f"WITH {RESOURCES_SQL} SELECT concat_ws(chr(9), resource::VARCHAR, bytes::VARCHAR, format, coalesce(exclusion, ''), missing::VARCHAR) AS line FROM res",
    "batch_progress": """WITH s AS (SELECT l_orderkey AS batch, count(*) AS done, count(*) FILTER (l_partkey % 23 <> 0 AND l_returnflag <> 'A') AS applied, count(*) FILTER (l_partkey % 23 <> 0 AND l_returnflag = 'A') AS failed, bool_or(l_partkey % 23 = 0) AS cancelled,
        coalesce(sum(floor(l_extendedprice)::BIGINT) FILTER (l_partkey % 23 <> 0 AND l_returnflag <> 'A'), 0)::BIGINT AS savings_bytes FROM lineitem GROUP BY 1)
      SELECT batch, batch % 6 + 1 AS total, done::BIGINT AS done, applied::BIGINT AS applied, failed::BIGINT AS failed, cancelled, savings_bytes, NOT cancelled AND done < batch % 6 + 1 AS running FROM s JOIN orders ON o_orderkey = batch""",
}

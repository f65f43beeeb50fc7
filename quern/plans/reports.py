"""Queries on reports, inventories and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import classify
from quern.operators import report
from quern.plans.tables import read


def status_counts(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.floor("o_totalprice").cast("long").alias("savings"))
    return report.status_counts(o)


def facet_counts(spark, sf_dir):
    i = read(spark, sf_dir, "lineitem")
    return report.facet_counts(i, {
        "candidates": F.col("l_discount") > 0.05, "warnings": F.col("l_tax") > 0.06, "duplicates": F.col("l_quantity") > 40, "applied": F.col("l_linestatus") == "F",
        "images": F.col("l_returnflag") == "A", "translations": F.col("l_returnflag") == "N", "unsupported": F.col("l_returnflag") == "R", "failed": F.col("l_extendedprice") < 2000, "all_rows": F.lit(True),
    })


def _view_rows(spark, sf_dir):
    """orders as rows of a report."""
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, F.floor("o_totalprice")).otherwise(0).cast("long").alias("savings"), (k % 4).alias("warnings"), (k % 6 == 0).alias("in_group"), F.when(k % 7 == 0, "applied").otherwise("original").alias("state"),
        F.when(k % 2 == 0, "image").otherwise("video").alias("kind"), F.when(k % 10 == 0, k % 100).alias("issues"), F.get(F.array(*map(F.lit, ["candidates_available", "inspected", "unsupported", "inventory_only", "failed"])), (k % 5).cast("int")).alias("status"),
        F.get(F.array(*map(F.lit, ["png", "webp", "jpeg"])), (k % 3).cast("int")).alias("format"), F.floor("o_totalprice").cast("long").alias("bytes"), (k % 50).alias("applied_savings"), F.concat_ws("/", F.lower("o_orderpriority"), F.concat(F.lit("F"), k.cast("string"))).alias("path"), F.when(k % 8 != 0, F.col("o_custkey") % 100).alias("lowest_score"),
    )


def report_summary(spark, sf_dir):
    s = report.summary(_view_rows(spark, sf_dir))
    return s.withColumn("formats", F.array_join("formats", ","))


def report_view(spark, sf_dir):
    """The images named high, lowest score first: a page of a view."""
    return report.view(_view_rows(spark, sf_dir), "images", "HIGH f1", sort="score").select("id").limit(80)


def translations_view(spark, sf_dir):
    return report.view(_view_rows(spark, sf_dir), "translations", fmt="webp").select("id", "issues").limit(60)


def search_all_words(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.where(report.all_words(F.concat_ws(" ", "p_name", "p_brand", "p_type"), "Brand#1 a")).select("p_partkey")


def search_groups(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return report.groups_with_match(p, "p_brand", F.col("p_size") == 1).groupBy("p_brand").agg(F.count("*").alias("n"))


def results_page(spark, sf_dir):
    return report.results_page(read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type"), 250)


def results_totals(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("completed"), F.count_if(F.col("event_type") == "purchase").alias("candidates"), F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.floor("value"))), F.lit(0)).cast("long").alias("savings"))


def list_page_sorted(spark, sf_dir):
    return report.page(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), [F.desc("p_size"), "p_name", "p_partkey"], 50, 2)


def missing_resources(spark, sf_dir):
    return report.missing(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id"), "doc_id")


def operation_state(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("resource"))
    i = read(spark, sf_dir, "lineitem").where("l_linenumber < 5").groupBy(F.col("l_orderkey").alias("resource")).agg(F.count_if(F.col("l_linestatus") == "F").alias("applied"), F.count("*").alias("total"))
    return report.operation_state(o, i)


def smallest_score(spark, sf_dir):
    """Lowest score of each resource, rows without one last."""
    i = read(spark, sf_dir, "lineitem")
    return i.groupBy(F.col("l_orderkey").alias("resource")).agg(F.min(F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity"))).alias("low"))


def kind_profile(spark, sf_dir):
    """Kinds of page addresses by extension, against what first bytes say: those of a page, or of another file for every fourth and fifth."""
    p = read(spark, sf_dir, "pages")
    ext = classify.extension_of(F.col("url"))
    fmt = classify.extension_format(ext)
    head = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("GIF89a").cast("binary"), F.substring("html", 1, 64).cast("binary"))).when(F.col("page_id") % 5 == 0, F.concat(F.lit("%PDF-1.7").cast("binary"), F.substring("html", 1, 64).cast("binary"))).otherwise(F.substring("html", 1, 64).cast("binary"))
    return p.select("page_id", fmt.alias("format"), classify.kind(fmt).alias("kind"), classify.actual_format(head).alias("actual"))


def byte_formats(spark, sf_dir):
    """Formats of headers made from a fixed list."""
    n = read(spark, sf_dir, "part").select("p_partkey")
    header = F.unhex(F.get(F.array(*map(F.lit, _HEADERS)), (F.col("p_partkey") % len(_HEADERS)).cast("int")))
    return n.select("p_partkey", classify.actual_format(header).alias("format"), classify.header_pixels(header).alias("pixels"))


_HEADERS = ["504147", "89504E470D0A1A0A0000000D49484452000000400000002008", "FFD8FFE0", "52494646000000005745425056503820", "52494646000000005745425056503858000000000000000027000009000000", "474946383961", "49492A00", "424D0000", "255044462D31", "00000018667479706176696600000000617669666D696631", "000000186674797068656963000000006D69663168656963", "00000018667479706D696631000000006D6966316D696631", "0000000866747970617669660000000061766966", "68656C6C6F"]
_FORMATS = ["pag", "png", "jpeg", "webp", "webp", "gif", "tiff", "bmp", "pdf", "avif", "heic", "heif", None, None]
_PATHS = ["app/src/main/res/drawable-xhdpi/ic_a.9.png", "app/src/main/assets/a/b.png", "lib/res/mipmap-ldrtl-v21/x.png", "a/Assets.xcassets/i.imageset/p@2x.png", "img/Logo@3x.PNG", "res/values/strings.xml", "src/x/assets", "a/b/res/unknown/x.png"]


def _paths(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, _PATHS)), (F.col("p_partkey") % len(_PATHS)).cast("int")).alias("path"))


def android_paths(spark, sf_dir):
    p = _paths(spark, sf_dir).withColumn("a", classify.android(F.col("path")))
    return p.select("p_partkey", "a.module", "a.source_set", "a.area", "a.res_type", F.array_join("a.qualifiers", "-").alias("qualifiers"), "a.density", F.coalesce("a.rtl", F.lit(False)).alias("rtl"), "a.api_level", "a.name", F.coalesce("a.nine_patch", F.lit(False)).alias("nine_patch"), classify.format_lock(F.col("a")).alias("format_lock"))


def variant_keys(spark, sf_dir):
    return _paths(spark, sf_dir).select("p_partkey", classify.variant_key(F.col("path")).alias("variant"), classify.lookup_name(F.col("path")).alias("lookup"))


def policy_keys(spark, sf_dir):
    p = _paths(spark, sf_dir).withColumn("a", classify.android(F.col("path")))
    return p.select("p_partkey", classify.policy_key(F.lit("png"), F.col("a"), F.lit("loose_file"), classify.format_lock(F.col("a")), F.lit(None).cast("string")).alias("policy"))


def webp_support(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    sdk = F.when(F.col("p_size") % 5 != 0, F.col("p_size") % 25)
    return p.select("p_partkey", classify.webp_compatibility(sdk, F.col("p_partkey") % 2 == 0, F.col("p_partkey") % 3 == 0).alias("reason"), classify.palette_size(F.col("p_size") * 2).alias("palette"), classify.score_label(F.col("p_size") * 2).alias("label"))


def project_kinds(spark, sf_dir):
    """Distinct kinds of each page's host, sorted, `directory` if there is none."""
    p = read(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("project"), F.when(F.col("page_id") % 3 == 0, "xcode").when(F.col("page_id") % 7 == 0, "android").alias("kind"))
    found = F.array_sort(F.collect_set("kind"))
    return p.groupBy("project").agg(F.when(F.size(found) > 0, F.array_join(found, ",")).otherwise("directory").alias("kinds"))


def sources_and_tooling(spark, sf_dir):
    names = ["View.swift", ".hidden", "LICENSE", "icon.png", "a.yml", "data.json", "Makefile", "x.tar.gz", "noext"]
    p = read(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names)).cast("int")).alias("name"))
    ext = classify.extension_of(F.col("name"))
    return p.select("p_partkey", ext.alias("extension"), classify.kind(classify.extension_format(ext)).alias("kind"), classify.is_source_or_tooling(F.col("name"), ext).alias("tooling"))


QUERIES = {f.__name__: f for f in (status_counts, facet_counts, report_summary, report_view, translations_view, search_all_words, search_groups, results_page, results_totals, list_page_sorted, missing_resources, operation_state, smallest_score, kind_profile, byte_formats, android_paths, variant_keys, policy_keys, webp_support, project_kinds, sources_and_tooling)}
_KIND = "CASE " + " ".join(f"WHEN {{0}} IN ({', '.join(map(repr, v))}) THEN {k!r}" for k, v in classify.KINDS.items()) + " ELSE 'unclassified' END"
_EXT = "CASE {0} " + " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in classify.EXTENSIONS.items()) + " ELSE {0} END"


def _list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) for v in values) + "]"


def _pick(values, key="p_partkey") -> str:
    return f"{_list(values)}[({key} % {len(values)})::INT + 1]"


_A = [
    ("app", "main", "res", "drawable", "xhdpi", "xhdpi", False, None, "ic_a", True, "android_nine_patch"), ("app", "main", "assets", None, "", None, False, None, None, False, None),
    ("lib", "", "res", "mipmap", "ldrtl-v21", None, True, 21, "x", False, "android_launcher_icon"), (None,) * 11, (None,) * 11,
    ("", "", "res", "values", "", None, False, None, "strings", False, None), (None,) * 11, (None,) * 11,
]
_A_NAMES = ["module", "source_set", "area", "res_type", "qualifiers", "density", "rtl", "api_level", "name", "nine_patch", "format_lock"]
_EXT_OF = r"lower(regexp_extract({0}, '[^/]\.([^./]*)$', 1))"
_VIEW = """WITH v AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice)::BIGINT ELSE 0 END AS savings, o_orderkey % 4 AS warnings, ['png', 'webp', 'jpeg'][(o_orderkey % 3)::INT + 1] AS format, floor(o_totalprice)::BIGINT AS bytes,
  lower(o_orderpriority) || '/F' || o_orderkey AS path, CASE WHEN o_orderkey % 8 <> 0 THEN o_custkey % 100 END AS lowest_score FROM orders)"""
ORACLE_SQL = {
    "status_counts": "SELECT o_orderstatus AS status, count(*)::BIGINT AS n, sum(floor(o_totalprice)::BIGINT)::BIGINT AS savings FROM orders GROUP BY 1",
    "facet_counts": """SELECT count(*) FILTER (l_discount > 0.05)::BIGINT AS candidates, count(*) FILTER (l_tax > 0.06)::BIGINT AS warnings, count(*) FILTER (l_quantity > 40)::BIGINT AS duplicates, count(*) FILTER (l_linestatus = 'F')::BIGINT AS applied,
      count(*) FILTER (l_returnflag = 'A')::BIGINT AS images, count(*) FILTER (l_returnflag = 'N')::BIGINT AS translations, count(*) FILTER (l_returnflag = 'R')::BIGINT AS unsupported, count(*) FILTER (l_extendedprice < 2000)::BIGINT AS failed, count(*)::BIGINT AS all_rows FROM lineitem""",
    "report_summary": _VIEW + """ SELECT count(*) FILTER (savings > 0)::BIGINT AS candidates, count(*) FILTER (warnings > 0)::BIGINT AS warnings, count(*) FILTER (k % 6 = 0)::BIGINT AS duplicates, count(*) FILTER (k % 7 = 0)::BIGINT AS applied, count(*) FILTER (k % 2 = 0)::BIGINT AS images,
      count(*) FILTER (k % 10 = 0)::BIGINT AS translations, count(*) FILTER (k % 5 IN (2, 3))::BIGINT AS unsupported, count(*) FILTER (k % 5 = 4)::BIGINT AS failed, count(*)::BIGINT AS all, sum(bytes)::BIGINT AS bytes, sum(savings)::BIGINT AS recommended_savings, sum(k % 50) FILTER (k % 7 = 0)::BIGINT AS applied_total,
      string_agg(DISTINCT format, ',' ORDER BY format) AS formats FROM v""",
    "report_view": _VIEW + " SELECT k AS id FROM v WHERE k % 2 = 0 AND contains(lower(path || ' ' || format || ' image'), 'high') AND contains(lower(path || ' ' || format || ' image'), 'f1') ORDER BY lowest_score NULLS LAST, lower(path), path LIMIT 80",
    "translations_view": _VIEW + " SELECT k AS id, k % 100 AS issues FROM v WHERE k % 10 = 0 AND format = 'webp' ORDER BY k % 100 DESC, lower(path), path LIMIT 60",
    "search_all_words": "SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1') AND contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'a')",
    "search_groups": "SELECT p_brand, count(*)::BIGINT AS n FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 1) GROUP BY 1",
    "results_page": "SELECT event_id AS seq, event_type FROM events WHERE event_id >= 250 ORDER BY event_id LIMIT 500",
    "results_totals": "SELECT count(*)::BIGINT AS completed, count(*) FILTER (event_type = 'purchase')::BIGINT AS candidates, coalesce(sum(floor(value)) FILTER (event_type = 'purchase'), 0)::BIGINT AS savings FROM events",
    "list_page_sorted": "SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_name, p_partkey LIMIT 50 OFFSET 100",
    "missing_resources": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "operation_state": """WITH j AS (SELECT l_orderkey AS resource, count(*) FILTER (l_linestatus = 'F') AS a, count(*) AS t FROM lineitem WHERE l_linenumber < 5 GROUP BY 1)
      SELECT o_orderkey AS resource, CASE WHEN a IS NULL OR a = 0 THEN 'original' WHEN a = t THEN 'applied' ELSE 'partial' END AS state FROM orders LEFT JOIN j ON resource = o_orderkey""",
    "smallest_score": "SELECT l_orderkey AS resource, min(l_quantity) FILTER (l_partkey % 3 <> 0) AS low FROM lineitem GROUP BY 1",
    "kind_profile": f"WITH e AS (SELECT page_id, {_EXT_OF.format('url')} AS x FROM pages), f AS (SELECT page_id, {_EXT.format('x')} AS format FROM e) SELECT page_id, format, {_KIND.format('format')} AS kind, CASE WHEN page_id % 4 = 0 THEN 'gif' WHEN page_id % 5 = 0 THEN 'pdf' END AS actual FROM f",
    "byte_formats": f"SELECT p_partkey, {_pick(_FORMATS)} AS format, CASE WHEN p_partkey % {len(_HEADERS)} = 1 THEN 64 * 32 WHEN p_partkey % {len(_HEADERS)} = 4 THEN 40 * 10 END::BIGINT AS pixels FROM part",
    "android_paths": "SELECT p_partkey, " + ", ".join(f"{_pick([a[i] or False if n in ('rtl', 'nine_patch') else a[i] for a in _A])} AS {n}" for i, n in enumerate(_A_NAMES)) + " FROM part",
    "variant_keys": f"SELECT p_partkey, {_pick(['app/main/drawable/ic_a', 'app/src/main/assets/a/b', 'lib/mipmap/x', 'a/Assets.xcassets/i.imageset', 'img/logo', 'values/strings', 'src/x/assets', 'a/b/res/unknown/x'])} AS variant, {_pick(['ic_a.9', 'b', 'x', 'p', 'logo', 'strings', 'assets', 'x'])} AS lookup FROM part",
    "policy_keys": f"SELECT p_partkey, {_pick(['png|android:res:drawable|android_nine_patch|-', 'png|android:assets:-|-|-', 'png|android:res:mipmap|android_launcher_icon|-', 'png|loose|-|-', 'png|loose|-|-', 'png|android:res:values|-|-', 'png|loose|-|-', 'png|loose|-|-'])} AS policy FROM part",
    "webp_support": """WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_size % 5 <> 0 THEN p_size % 25 END AS sdk, CASE WHEN p_partkey % 2 = 0 OR p_partkey % 3 = 0 THEN 18 ELSE 14 END AS need FROM part)
      SELECT p_partkey, CASE WHEN sdk IS NULL THEN 'android_min_sdk_unknown' WHEN sdk < need THEN 'android_min_sdk_' || sdk || '_below_webp_requirement_' || need END AS reason,
      CASE WHEN p_size * 2 >= 90 THEN 256 WHEN p_size * 2 >= 80 THEN 128 WHEN p_size * 2 >= 70 THEN 64 WHEN p_size * 2 >= 50 THEN 32 ELSE 16 END AS palette,
      CASE WHEN p_size * 2 >= 90 THEN 'excellent' WHEN p_size * 2 >= 70 THEN 'good' WHEN p_size * 2 >= 50 THEN 'fair' ELSE 'poor' END AS label FROM p""",
    "project_kinds": "SELECT page_id % 10 AS project, coalesce(string_agg(DISTINCT k, ',' ORDER BY k), 'directory') AS kinds FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'xcode' WHEN page_id % 7 = 0 THEN 'android' END AS k FROM pages) GROUP BY 1",
    "sources_and_tooling": f"SELECT p_partkey, {_pick(['swift', '', '', 'png', 'yml', 'json', '', 'gz', ''])} AS extension, {_pick(['unclassified', 'unclassified', 'unclassified', 'image', 'data', 'data', 'unclassified', 'archive', 'unclassified'])} AS kind, {_pick([True, True, True, False, True, False, True, False, False])} AS tooling FROM part",
}

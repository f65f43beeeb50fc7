"""Queries over projects made of the driver's tables: trees, builds, localization files, names, media and plans. A part is a file; sixteen neighbours are a module."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import naming
from quern.operators import inventory as inv
from quern.operators import localization as l10n
from quern.operators import report, store, usage
from quern.plans.tables import read
from quern.sources import l10n as readers
from quern.sources import media

_PNG = "89504E470D0A1A0A0000000D494844520000000300000005080600000000000000"[:58]
_WEBP = "524946461A000000574542505650384C0D0000002F0000000000"[:50]
#: Of each place in a module: path after the module's folder (or instead of it), and content as SQL text or as hex.
PLACES = [
    ("{m}/A.xcassets/s.imageset/Contents.json", """'{"images":[{"filename":"a.png"},{"filename":"b.jpg"},{"filename":"../o.png"},{"filename":"gone.png"},{"idiom":"' || m || '"}]}'"""),
    ("{m}/A.xcassets/s.imageset/a.png", _PNG), ("{m}/A.xcassets/s.imageset/b.jpg", "FFD8FFE0"),
    ("Pods/{m}/P.xcassets/t.imageset/Contents.json", """'{"images":[{"filename":"a.png"}]}'"""), ("Pods/{m}/P.xcassets/t.imageset/a.png", _PNG),
    ("{m}/B.xcassets/i.appiconset/Contents.json", """'{"images":[{"filename":"i.png"}]}'"""), ("{m}/B.xcassets/i.appiconset/i.png", _PNG), ("{m}/B.xcassets/link.bin", "00"),
    ("{m}/Resources/w.png", _WEBP), ("{m}/Resources/move.json", """CASE WHEN n % 2 = 1 THEN '{"v":"5","fr":30,"op":9}' ELSE '{"k":1}' END"""), ("{m}/Main.swift", "'let a = 1'"), ("{m}/src/main/res/drawable-hdpi/bg.9.png", _PNG),
    ("{m}/src/main/res/values/strings.xml", "'<resources/>'"), ("{m}/Resources/tune.mp3", "'ID3'"), ("{m}/C.xcassets/r.imageset/Contents.json", """'{"images":[{"filename":"a.png","resizing":{"mode":"9-part"}}]}'"""), ("{m}/C.xcassets/r.imageset/a.png", _PNG),
]
_MODULE = "(p_partkey div 16) AS n, p_partkey % 16 AS r, concat('m', p_partkey div 16) AS m"


def _tree(spark, sf_dir):
    """parts as files; in every fifth module a catalog holds a symlink."""
    rows = read(spark, sf_dir, "part").selectExpr("p_partkey AS k", *[c.strip() for c in _MODULE.split(", ", 2)])
    is_hex = lambda c: not c.startswith(("'", "CASE"))
    path, content = F.lit(None).cast("string"), F.lit(None).cast("binary")
    for i, (p, c) in enumerate(PLACES):
        before, after = p.split("{m}")
        path = F.when(F.col("r") == i, F.concat(F.lit(before), "m", F.lit(after))).otherwise(path)
        content = F.when(F.col("r") == i, F.unhex(F.lit(c)) if is_hex(c) else F.expr(c).cast("binary")).otherwise(content)
    entry = F.when((F.col("r") == 7) & (F.col("n") % 5 == 0), "symlink").otherwise("file")
    return rows.select(path.alias("path"), entry.alias("entry"), content.alias("content")).select("path", "entry", F.when(F.col("entry") == "file", F.octet_length("content").cast("long")).alias("bytes"), F.substring("content", 1, 512).alias("header"), "content")


def _inventory(spark, sf_dir):
    return inv.route(inv.inventory(_tree(spark, sf_dir)))


def tree_inventory(spark, sf_dir):
    return _inventory(spark, sf_dir).select("path", "bytes", "kind", "format", "extension_mismatch", "origin", "exclusion", "format_lock", "support", "route")


def catalog_renditions(spark, sf_dir):
    return inv.renditions(_tree(spark, sf_dir)).select("path", "eligible", "reason", "contents_path", "contents_sha256")


def catalog_scan(spark, sf_dir):
    """Catalogs with the number of their entries; those with symlinks are refused, those of dependencies are not there."""
    return inv.catalogs(_tree(spark, sf_dir))


def catalog_problems(spark, sf_dir):
    return inv.catalog_diagnostics(_tree(spark, sf_dir))


def unsafe_renditions(spark, sf_dir):
    return inv.unsafe_renditions(_tree(spark, sf_dir))


def settled_rows(spark, sf_dir):
    return inv.settled_rows(_inventory(spark, sf_dir)).select("path", "status", F.array_join("issues", ",").alias("issues"))


def work_order(spark, sf_dir):
    """The first 500 resources in the order of work: settled ones by path, then the largest."""
    return inv.work_order(_inventory(spark, sf_dir).where("route <> 'settled'")).limit(500).select("path", "route", "bytes")


def cancelled_rows(spark, sf_dir):
    """An analysis that was stopped when half of the modules were done: every resource has a row."""
    rows = _inventory(spark, sf_dir).select("path")
    done = rows.where(F.length("path") % 2 == 0).withColumn("status", F.lit("done"))
    return inv.mark_cancelled(done, rows)


def tree_summary(spark, sf_dir):
    files = _tree(spark, sf_dir)
    kinds = inv.project_kinds(files, inv.inventory(files))
    return inv.skipped(files).crossJoin(kinds.select(F.array_join("project_kinds", ",").alias("project_kinds")))  # one row each


def _builds(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    k, level = F.col("k"), (F.col("k") % 7 + 21).cast("string")
    path = F.when(k % 6 == 0, F.concat(F.lit("app"), k, F.lit("/build.gradle.kts"))).when(k % 6 == 5, F.concat(F.lit("g"), k, F.lit("/libs.versions.toml"))).otherwise(F.concat(F.lit("app"), k, F.lit("/build.gradle")))
    text = F.when(k % 6 == 0, F.concat(F.lit("android {\n  minSdk = "), level, F.lit("\n  // minSdk = 5\n}"))).when(k % 6 == 1, F.concat(F.lit("minSdkVersion("), (k % 7 + 24).cast("string"), F.lit(")\ncompileSdk 34"))).when(k % 6 == 2, "minSdk libs.versions.wear.min.get().toInteger()")
    text = text.when(k % 6 == 3, "compileSdk 34").when(k % 6 == 4, "minSdk 1000").otherwise(F.concat(F.lit('[versions]\nwear-min = "'), (k % 30 + 10).cast("string"), F.lit('" # watches\nother = "9.1"\n')))
    return p.select(path.alias("path"), text.alias("text"))


def min_sdk(spark, sf_dir):
    return usage.min_sdk(_builds(spark, sf_dir))


def build_settings(spark, sf_dir):
    return usage.build_settings(_builds(spark, sf_dir).where("path not like '%.toml'"))


def _translations(spark, sf_dir):
    """Two neighbouring parts as the files of one table, in English and German."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")).withColumn("m", F.floor(F.col("k") / 2))
    m = F.col("m")
    a = F.when(m % 3 == 0, "eins").when(m % 3 == 1, "eins %@").otherwise("")
    german = F.concat(F.lit('"a" = "'), a, F.lit('";'), F.when(m % 2 == 0, ' "b" = "zwei";').otherwise(""), F.when(m % 5 == 0, ' "z" = "mehr";').otherwise(""))
    text = F.when(F.col("k") % 2 == 0, '"a" = "one %@"; "b" = "two"; "c" = "three";').otherwise(german)
    path = F.concat(F.lit("B"), m, F.when(F.col("k") % 2 == 0, "/en.lproj/T.strings").otherwise("/de.lproj/T.strings"))
    return p.select(path.alias("path"), F.octet_length(text).cast("long").alias("bytes"), text.cast("binary").alias("content")).repartition("path")  # keys are few bytes, parsing their files is not


def _tables(spark, sf_dir):
    return l10n.tables(readers.localization_entries(_translations(spark, sf_dir)))


def localization_tables(spark, sf_dir):
    """Translations from files to coverage."""
    c = l10n.table_coverage(_tables(spark, sf_dir))
    return c.select("table", "source", "language", "keys", "translated", "missing", "empty", "needs_review", "extra", "issues", F.round("share", 4).alias("share"))


def localization_issues(spark, sf_dir):
    c = l10n.table_cells(_tables(spark, sf_dir)).where("issue is not null")
    wrong = F.col("issue") != "empty_value"
    shown = lambda v, name: F.when(wrong, F.array_join(l10n.display(F.col(v)), " ")).otherwise("").alias(name)
    return c.select("table", "language", "key", F.col("issue").alias("kind"), shown("original", "expected"), shown("value", "found"))


def issue_totals(spark, sf_dir):
    """Issues that each file answers for."""
    rows = _tables(spark, sf_dir)
    cover = l10n.table_coverage(rows)
    files = rows.select("group", "path", F.col("label").alias("language")).distinct().join(l10n.table_sources(rows), "group").where("path not like '%.xcstrings'").select(F.col("group").alias("table"), "path", "language", F.col("source").alias("source_language"))
    return report.issue_totals(files, cover.select(F.col("group").alias("table"), "language", "issues")).select("path", "issues")


def _by_case(rows, name, *texts):
    """Each row's text by its number modulo the texts given, with {} for the number."""
    n, out = len(texts), None
    for i, t in enumerate(texts):
        made = F.concat(*[x for j, part in enumerate(t.split("{}")) for x in ([F.lit(part)] if j == 0 else [F.col("k").cast("string"), F.lit(part)])])
        out = F.when(F.col("k") % n == i, made) if out is None else out.when(F.col("k") % n == i, made)
    return rows.select("k", out.alias(name))


def _parts(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))


NORMAL = ["a{}/./b/../c.png", "../x{}", "/abs{}", "a//b{}", "a/../../{}", "p/q/{}/.."]
ROUTES = ["/analysis.json", "/previews/{}-a.png", "/candidates/x{}.png", "/originals/0..{}.png", "/other/{}.png", "previews/{}.png", "/originals/{}" + "0" * 92, "/previews/{}/x"]
URLS = ["previews/a b{}.png", "originals/ü&{}.png", "candidates/../{}", "other/{}", "previews", "candidates\\{}-~(x)'!.png", "previews/a:{}", "previews//{}"]


def normal_paths(spark, sf_dir):
    return _by_case(_parts(spark, sf_dir), "path", *NORMAL).select("path", naming.normal_path(F.col("path")).alias("normal"))


def artifact_paths(spark, sf_dir):
    return _by_case(_parts(spark, sf_dir), "route", *ROUTES).select("route", naming.artifact_path(F.col("route")).alias("path"))


def asset_urls(spark, sf_dir):
    return _by_case(_parts(spark, sf_dir), "path", *URLS).select("path", naming.asset_url(F.col("path")).alias("url"))


def templates(spark, sf_dir):
    """Names of artifacts of a row as templates, and whether those are safe."""
    rows = _by_case(_parts(spark, sf_dir), "path", "candidates/{}-a.png", "previews/{}-b..png", "candidates/0{}-a.png", "originals/{}-c.png")
    t = naming.template_of(F.col("path"), F.col("k"))
    return rows.select("path", t.alias("template"), naming.safe_template(t).alias("safe"))


def size_texts(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select((F.floor(F.col("o_totalprice")) * F.pow(F.lit(10), F.col("o_orderkey") % 9).cast("long") - 1000).alias("bytes"))
    return o.select("bytes", naming.size_text(F.col("bytes")).alias("text"), naming.percent_text(F.col("bytes") / 1024).alias("percent"))


def export_names(spark, sf_dir):
    rows = _by_case(_parts(spark, sf_dir), "path", "a/Icon.png", "b/icon.jpg", "c/ICON.webp", "d/a b!.gif", ".png", "x/own{}.png")
    return naming.export_names(rows.select(F.col("k").alias("seq"), "path")).select("seq", "name")


def locale_texts(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), "c_name")
    wanted = F.when(F.col("n") % 4 == 0, F.array(F.lit("de-CH"), F.lit("fr"))).when(F.col("n") % 4 == 1, F.array(F.lit("xx"))).when(F.col("n") % 4 == 2, F.array(F.lit("PT-br"), F.lit("en"))).otherwise(F.array(F.lit("zz"), F.lit("fr-CA")))
    text = F.when(F.col("n") % 3 == 0, "{0} of {1}").when(F.col("n") % 3 == 1, "{1}{1}{2}").otherwise("none")
    return c.select("c_custkey", naming.pick_locale(wanted, ["en", "fr", "de", "pt-BR"]).alias("locale"), naming.fill_text(text, F.array("c_name", F.col("n").cast("string"))).alias("text"))


def frame_sizes(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice") / 10 - 95).alias("rate"), (F.col("p_size") * 13).alias("w"), (F.col("p_partkey") % 900 + 1).cast("int").alias("h"))
    return p.select("k", naming.frame_rate(F.col("rate")).alias("rate"), naming.output_size(F.col("w"), F.col("h"), F.lit(256)).alias("s")).select("k", "rate", "s.width", "s.height")


def png_metadata(spark, sf_dir):
    """Metadata chunks that a conversion of a PNG drops, each once, in file order."""
    names = F.array(*[F.when(F.col("k") % m != 0, n).otherwise("IDAT") for m, n in ((2, "tEXt"), (3, "gAMA"), (5, "tEXt"), (7, "IHDR"), (2, "eXIf"))])
    return _parts(spark, sf_dir).select("k", F.array_join(naming.dropped_metadata(names), ",").alias("dropped"))


def _media(spark, sf_dir):
    """parts as MP4s with a description, and PAG files, some of them wrong."""
    k = F.col("k")
    doc = F.format_string('{"info":{"v":%d,"w":4,"h":%d,"f":%d,"fps":%d,"videoW":8,"videoH":4,"rgbFrame":[0,0,4,4],"aFrame":[%d,0,4,4]}}', F.when(k % 11 == 0, 1).otherwise(2), k % 50, k + 1, k % 150, F.when(k % 13 == 0, 5).otherwise(4))
    hex8 = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    text = lambda t: F.lit(t).cast("binary")
    box = F.concat(hex8(F.octet_length(doc) + 8), text("vapc"), doc.cast("binary"))
    start = F.concat(hex8(F.lit(12)), text("ftypisom"))
    film = F.when(k % 7 == 0, F.concat(start, box, box)).when(k % 7 == 1, F.concat(start, hex8(F.lit(8)), text("moov"))).when(k % 7 == 2, box).otherwise(F.concat(start, box))
    body = F.concat(F.when(k % 5 == 0, text("Z")).otherwise(text("U")), F.unhex(F.lpad(F.hex(k), 16, "0")))
    size = F.unhex(F.when(k % 9 == 0, "07000000").otherwise("08000000"))
    pag = F.concat(text("PAG"), F.unhex(F.when(k % 4 == 0, "02").otherwise("01")), size, body)
    return _parts(spark, sf_dir).select(F.when(k % 3 == 0, F.concat(k, F.lit(".pag"))).otherwise(F.concat(k, F.lit(".mp4"))).alias("path"), F.when(k % 3 == 0, pag).otherwise(film).alias("content"))


def media_descriptions(spark, sf_dir):
    return media.descriptions(_media(spark, sf_dir)).select("path", "kind", "width", "height", "frames", "error")


def plan_problems(spark, sf_dir):
    """orders as candidates of a plan: digests that are none, sizes that can't be, paths that are there twice."""
    from quern.sources import reports

    k = F.col("o_orderkey")
    digest = F.sha2(k.cast("string"), 256)
    o = read(spark, sf_dir, "orders").select(
        F.concat(F.lit("p"), F.when(k % 50 == 0, k + 1).otherwise(k)).alias("path"), F.when(k % 29 != 0, digest).alias("original_sha256"), F.when(k % 31 == 0, F.upper(digest)).otherwise(digest).alias("optimized_sha256"),
        F.when(k % 37 == 0, F.lit(1 << 40)).otherwise(F.floor("o_totalprice")).alias("original_bytes"), F.when(k % 41 == 0, F.floor("o_totalprice")).otherwise(k % 9).alias("optimized_bytes"), F.lit("c").alias("contents_path"), digest.alias("contents_sha256"),
    )
    return reports.plan_problems(o)


def plan_mismatches(spark, sf_dir):
    """A plan of all renditions made before some sets changed and some images went."""
    assets = inv.renditions(_tree(spark, sf_dir))
    plan = assets.select("path", "contents_path", F.when(F.col("contents_path").like("m%1/%"), "0").otherwise(F.col("contents_sha256")).alias("contents_sha256"))
    gone = _parts(spark, sf_dir).where("k % 100 = 0").select(F.concat(F.lit("gone"), "k").alias("path"), F.lit("c").alias("contents_path"), F.lit("d").alias("contents_sha256"))
    return store.plan_mismatches(plan.union(gone), assets)


def cache_lookup(spark, sf_dir):
    """orders as resources, looked up in a cache kept for parts."""
    res = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("resource"), F.when(F.col("o_custkey") % 11 != 0, F.concat(F.lit("k"), F.col("o_custkey"))).alias("key"))
    k = F.col("k")
    entries = _parts(spark, sf_dir).where("k % 3 <> 0").select(F.concat(F.lit("k"), k).alias("key"), F.when(k % 7 == 0, 2).otherwise(1).alias("schema"), F.concat(F.lit("r"), k).alias("result"))
    files = _by_case(_parts(spark, sf_dir), "template", "candidates/{i}-a.png", "previews/{i}-b.png", "candidates/{i}-..a", "candidates/{i}-c.png", "candidates/{i}-d.png")
    files = files.select(F.concat(F.lit("k"), k).alias("key"), "template", F.lit("h").alias("sha256"), F.when(k % 4 == 0, "x").otherwise("h").alias("content_sha256"))
    return store.cache_lookup(res, entries, files).select("resource", "result", "verdict")


def reused_results(spark, sf_dir):
    """Results of documents that others share their text with, for all of them."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("resource"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"), "n_chars")
    owner = d.groupBy("h").agg(F.min("resource").alias("owner"))
    rows = d.join(owner, "h").select("resource", "owner")
    return store.reused_rows(rows, d.join(owner, F.col("resource") == F.col("owner"), "left_semi").select("resource", F.col("n_chars").alias("bytes")))


def missing_files(spark, sf_dir):
    """parts whose file is gone, but for those converted to another that is there."""
    k = F.col("k")
    res = _parts(spark, sf_dir).select(k.alias("resource"), F.concat(F.lit("f"), k, F.lit(".png")).alias("path"))
    present = _parts(spark, sf_dir).where("k % 3 <> 0").select(F.when(k % 5 == 0, F.concat(F.lit("f"), k, F.lit(".webp"))).otherwise(F.concat(F.lit("f"), k, F.lit(".png"))).alias("path"))
    done = _parts(spark, sf_dir).where("k % 10 in (0, 3)").select(k.alias("resource"), F.concat(F.lit("f"), k, F.when(k % 2 == 0, ".webp").otherwise(".png")).alias("target"))
    return store.missing_resources(res, present, done)


def apply_report(spark, sf_dir):
    """line items as outcomes of an older plan."""
    o = read(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("changed"), (F.col("l_returnflag") == "A").alias("already_current"), F.floor("l_extendedprice").alias("saved"))
    return store.apply_report(o)


QUERIES = {
    f.__name__: f
    for f in (
        tree_inventory, catalog_renditions, catalog_scan, catalog_problems, unsafe_renditions, settled_rows, work_order, cancelled_rows, tree_summary, min_sdk, build_settings, localization_tables, localization_issues, issue_totals, normal_paths, artifact_paths,
        asset_urls, templates, size_texts, export_names, locale_texts, frame_sizes, png_metadata, media_descriptions, plan_problems, plan_mismatches, cache_lookup, reused_results, missing_files, apply_report,
    )
}


def _case(column: str, texts: list[str], number: str = "k") -> str:
    quote = lambda t: "'" + t.replace("'", "''").replace("{}", f"' || {number} || '") + "'"
    return "CASE " + " ".join(f"WHEN {number} % {len(texts)} = {i} THEN {quote(t)}" for i, t in enumerate(texts)) + f" END AS {column}"


def _sql_tree() -> str:
    """f: the files, with module, place and content; b: content of the places that are text."""
    quote = lambda t: "'" + t.replace("{m}", "' || m || '") + "'"
    path = " ".join(f"WHEN {i} THEN {quote(p)}" for i, (p, _) in enumerate(PLACES))
    text = " ".join(f"WHEN {i} THEN {c}" for i, (_, c) in enumerate(PLACES) if c.startswith(("'", "CASE")))
    size = " ".join(f"WHEN {i} THEN {len(c) // 2}" for i, (_, c) in enumerate(PLACES) if not c.startswith(("'", "CASE")))
    return f"""t AS (SELECT p_partkey AS k, p_partkey // 16 AS n, p_partkey % 16 AS r, 'm' || (p_partkey // 16) AS m FROM part),
f AS (SELECT *, CASE r {path} END AS path, CASE r {text} END AS text, NOT (r = 7 AND n % 5 = 0) AS file FROM t),
s AS (SELECT f.*, coalesce(strlen(text), CASE r {size} END)::BIGINT AS bytes,
  CASE WHEN r IN (1, 2) THEN 'A.xcassets/s.imageset' WHEN r = 6 THEN 'B.xcassets/i.appiconset' WHEN r = 15 THEN 'C.xcassets/r.imageset' END AS folder,
  CASE WHEN r IN (1, 2) THEN n * 16 WHEN r = 6 AND NOT (n % 5 = 0 AND n * 16 + 7 <= (SELECT max(k) FROM t)) THEN n * 16 + 5 WHEN r = 15 THEN n * 16 + 14 END AS set_k FROM f),
rend AS (SELECT s.*, c.text AS contents, CASE s.r WHEN 2 THEN 'unsupported_format' WHEN 6 THEN 'app_icon' WHEN 15 THEN 'resizing' END AS reason, s.m || '/' || folder || '/Contents.json' AS contents_path FROM s JOIN f c ON c.k = s.set_k),
inv AS (
  SELECT s.path, bytes, CASE WHEN r IN (1, 2, 4, 6, 8, 11, 15) THEN 'image' WHEN r = 9 THEN 'animation' WHEN r = 13 THEN 'audio' ELSE 'data' END AS kind,
    CASE WHEN r = 2 THEN 'jpeg' WHEN r = 8 THEN 'webp' WHEN r = 7 THEN 'bin' WHEN r = 9 THEN 'lottie' WHEN r = 12 THEN 'xml' WHEN r = 13 THEN 'mp3' ELSE 'png' END AS format, r = 8 AS extension_mismatch,
    CASE WHEN s.path IN (SELECT path FROM rend) THEN 'catalog_rendition' WHEN s.path LIKE '%.xcassets/%' THEN 'catalog_file' ELSE 'loose_file' END AS origin,
    CASE WHEN r = 6 THEN 'app_icon' WHEN r = 15 AND s.path IN (SELECT path FROM rend) THEN 'resizing' END AS exclusion, CASE WHEN r = 11 THEN 'android_nine_patch' END AS format_lock, r
  FROM s WHERE file AND r NOT IN (0, 3, 5, 10, 14) AND NOT (r = 9 AND n % 2 = 0)),
i AS (SELECT *, CASE WHEN exclusion IS NOT NULL THEN 'excluded' WHEN kind = 'image' AND format <> 'jpeg' THEN 'optimizable' ELSE 'unsupported' END AS support FROM inv),
j AS (SELECT *, CASE WHEN r = 12 THEN 'localization' WHEN support = 'optimizable' THEN 'work' ELSE 'settled' END AS route FROM i)"""


_TREE = "WITH " + _sql_tree()
_ODD = """u AS (SELECT n, m || '/A.xcassets/s.imageset' AS folder, unnest(['a.png', 'b.jpg', '../o.png', 'gone.png']) AS filename FROM f WHERE r = 0
  UNION ALL SELECT n, m || '/B.xcassets/i.appiconset', 'i.png' FROM f WHERE r = 5 AND NOT (n % 5 = 0 AND n * 16 + 7 <= (SELECT max(k) FROM t)) UNION ALL SELECT n, m || '/C.xcassets/r.imageset', 'a.png' FROM f WHERE r = 14),
odd AS (SELECT *, folder || '/' || filename AS path FROM u WHERE folder || '/' || filename NOT IN (SELECT path FROM f))"""
_GERMAN = """WITH t AS (SELECT DISTINCT p_partkey // 2 AS m FROM part), g AS (SELECT *, (m % 3 <> 2)::INT + (m % 2 = 0)::INT AS done, (m % 3 = 2)::INT AS empty, (m % 3 <> 1)::INT AS issues FROM t)
"""
_K = "(SELECT p_partkey AS k FROM part)"
ORACLE_SQL = {
    "tree_inventory": _TREE + " SELECT path, bytes, kind, format, extension_mismatch, origin, exclusion, format_lock, support, route FROM j",
    "catalog_renditions": _TREE + " SELECT path, reason IS NULL AS eligible, reason, contents_path, sha256(contents) AS contents_sha256 FROM rend",
    "catalog_scan": _TREE + " SELECT regexp_extract(path, '^([^/]*/[^/]*\\.xcassets)/', 1) AS catalog, count(*)::BIGINT AS entries, bool_or(NOT file) AS refused FROM f WHERE path LIKE '%.xcassets/%' AND path NOT LIKE 'Pods/%' GROUP BY 1",
    "catalog_problems": _TREE + ", " + _ODD + """ SELECT DISTINCT m || '/B.xcassets' AS path, 'symlinks_or_unreadable_entries' AS problem FROM f WHERE NOT file
      UNION ALL SELECT path, CASE WHEN filename LIKE '../%' THEN 'unsafe_rendition_filename' ELSE 'rendition_not_found' END FROM odd""",
    "unsafe_renditions": _TREE + ", " + _ODD + " SELECT folder || '/Contents.json' AS contents_path, filename FROM odd",
    "settled_rows": _TREE + """ SELECT path, CASE WHEN exclusion IS NOT NULL THEN 'excluded' ELSE 'unsupported' END AS status, CASE WHEN exclusion IS NOT NULL THEN exclusion WHEN kind = 'image' THEN format || '_decoding_requires_macos_imageio'
      ELSE CASE WHEN kind = 'audio' THEN 'ffprobe_not_installed,' ELSE '' END || kind || '_optimization_backend_not_implemented' END AS issues FROM j WHERE route = 'settled'""",
    "work_order": _TREE + " SELECT path, route, bytes FROM j WHERE route <> 'settled' ORDER BY route = 'localization', CASE WHEN route = 'work' THEN -bytes END, string_split(path, '/') LIMIT 500",
    "cancelled_rows": _TREE + " SELECT path, CASE WHEN length(path) % 2 = 0 THEN 'done' ELSE 'not_analyzed' END AS status FROM j",
    "tree_summary": _TREE + " SELECT count(*) FILTER (r IN (0, 3, 5, 10, 14) OR (r = 9 AND n % 2 = 0))::BIGINT AS skipped_source_or_tooling_files, 'android,xcode' AS project_kinds FROM f WHERE file",
    "min_sdk": f"""WITH c AS (SELECT 'g' || k || '/libs.versions.toml' AS source, (k % 30 + 10)::INTEGER AS level FROM {_K} WHERE k % 6 = 5), w AS (SELECT arg_max(level, string_split(source, '/')) AS level, max_by(source, string_split(source, '/')) AS source FROM c),
      l AS (SELECT (k % 7 + 21)::INTEGER AS level, 'app' || k || '/build.gradle.kts' AS source FROM {_K} WHERE k % 6 = 0 UNION ALL SELECT (k % 7 + 24)::INTEGER, 'app' || k || '/build.gradle' FROM {_K} WHERE k % 6 = 1 UNION ALL SELECT level, source FROM w)
      SELECT level, source FROM l ORDER BY level, source LIMIT 1""",
    "build_settings": f"""SELECT 'app' || k || '/build.gradle.kts' AS source, (k % 7 + 21)::INTEGER AS level, NULL::VARCHAR AS key FROM {_K} WHERE k % 6 = 0 UNION ALL SELECT 'app' || k || '/build.gradle', (k % 7 + 24)::INTEGER, NULL FROM {_K} WHERE k % 6 = 1
      UNION ALL SELECT 'app' || k || '/build.gradle', NULL, 'wearmin' FROM {_K} WHERE k % 6 = 2""",
    "localization_tables": _GERMAN + """SELECT 'T' AS "table", 'en' AS source, 'en' AS language, 3::BIGINT AS keys, 3::BIGINT AS translated, 0::BIGINT AS missing, 0::BIGINT AS empty, 0::BIGINT AS needs_review, 0::BIGINT AS extra, 0::BIGINT AS issues, 1.0::DOUBLE AS share FROM t
      UNION ALL SELECT 'T', 'en', 'de', 3, done, 3 - done - empty, empty, 0, (m % 5 = 0)::INT, issues, round(done / 3.0::DOUBLE, 4) FROM g""",
    "localization_issues": _GERMAN + """SELECT 'T' AS "table", 'de' AS language, 'a' AS key, CASE WHEN m % 3 = 0 THEN 'placeholder_count' ELSE 'empty_value' END AS kind, CASE WHEN m % 3 = 0 THEN '%1$s' ELSE '' END AS expected, '' AS found FROM g WHERE issues > 0""",
    "issue_totals": _GERMAN + "SELECT 'B' || m || '/' || l || '.lproj/T.strings' AS path, issues::BIGINT AS issues FROM g, (VALUES ('en'), ('de')) v(l)",
    "normal_paths": f"WITH p AS (SELECT k, {_case('path', NORMAL)} FROM {_K}) SELECT path, CASE k % 6 WHEN 0 THEN 'a' || k || '/c.png' WHEN 3 THEN 'a/b' || k WHEN 5 THEN 'p/q' END AS normal FROM p",
    "artifact_paths": f"""WITH p AS (SELECT k, {_case('route', ROUTES)} FROM {_K}) SELECT route, CASE WHEN route = '/analysis.json' THEN 'analysis.json' WHEN regexp_full_match(route, '/(previews|candidates|originals)/[0-9][A-Za-z0-9.-]{{0,95}}') AND NOT contains(route, '..') THEN substr(route, 2) END AS path FROM p""",
    "asset_urls": f"""WITH p AS (SELECT {_case('path', URLS)} FROM {_K}), q AS (SELECT path, string_split(replace(path, chr(92), '/'), '/') AS parts FROM p)
      SELECT path, CASE WHEN parts[1] IN ('previews', 'candidates', 'originals') AND len(parts) > 1 AND len(list_filter(parts, lambda x: x IN ('', '.', '..') OR contains(x, ':'))) = 0 THEN
        array_to_string(list_transform(parts, lambda x: replace(replace(replace(replace(replace(url_encode(x), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*')), '/') END AS url FROM q""",
    "templates": f"""WITH p AS (SELECT k, {_case('path', ["candidates/{}-a.png", "previews/{}-b..png", "candidates/0{}-a.png", "originals/{}-c.png"])} FROM {_K}),
      q AS (SELECT path, CASE k % 4 WHEN 0 THEN 'candidates/{{i}}-a.png' WHEN 1 THEN 'previews/{{i}}-b..png' WHEN 3 THEN 'originals/{{i}}-c.png' END AS template, k FROM p) SELECT path, template, CASE WHEN template IS NOT NULL THEN k % 4 = 0 END AS safe FROM q""",
    "size_texts": """WITH b AS (SELECT floor(o_totalprice)::BIGINT * (10 ** (o_orderkey % 9))::BIGINT - 1000 AS b FROM orders), s AS (SELECT b, CASE WHEN b < 1024 ** 2 THEN 1 WHEN b < 1024 ** 3 THEN 2 WHEN b < 1024 ** 4 THEN 3 WHEN b < 1024 ** 5 THEN 4 ELSE 5 END AS p FROM b)
      SELECT b AS bytes, CASE WHEN b < 0 THEN '—' WHEN b < 1024 THEN b || ' B' ELSE regexp_replace(printf('%.2f', b / (1024 ** p)), '0$', '') || ' ' || ['KiB', 'MiB', 'GiB', 'TiB', 'PiB'][p] END AS text, printf('%.1f', b / 1024 * 100) || '%' AS percent FROM s""",
    "export_names": f"""WITH p AS (SELECT k, CASE k % 6 WHEN 0 THEN 'Icon.png' WHEN 1 THEN 'icon.png' WHEN 2 THEN 'ICON.png' WHEN 3 THEN 'a-b-.png' WHEN 4 THEN 'image.png' ELSE 'own' || k || '.png' END AS base FROM {_K}),
      n AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY k) AS n FROM p) SELECT k AS seq, CASE WHEN n = 1 THEN base ELSE n || '-' || base END AS name FROM n""",
    "locale_texts": """SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'de' WHEN 1 THEN 'en' WHEN 2 THEN 'pt-BR' ELSE 'fr' END AS locale,
      CASE c_nationkey % 3 WHEN 0 THEN c_name || ' of ' || c_nationkey WHEN 1 THEN c_nationkey::VARCHAR || c_nationkey || '{2}' ELSE 'none' END AS text FROM customer""",
    "frame_sizes": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_size % 7 <> 0 THEN p_retailprice / 10 - 95 END AS rate, p_size * 13 AS w, p_partkey % 900 + 1 AS h FROM part), s AS (SELECT *, least(1.0::DOUBLE, 256::DOUBLE / greatest(w, h)) AS z FROM p)
      SELECT k, CASE WHEN rate IS NULL OR rate <= 0 THEN 20 ELSE least(rate, 120) END::DOUBLE AS rate, greatest(floor(w * z + 0.5)::INTEGER, 1) AS width, greatest(floor(h * z + 0.5)::INTEGER, 1) AS height FROM s""",
    "png_metadata": f"""SELECT k, array_to_string(list_filter([CASE WHEN k % 2 <> 0 THEN 'tEXt' END, CASE WHEN k % 3 <> 0 THEN 'gAMA' END, CASE WHEN k % 2 = 0 AND k % 5 <> 0 THEN 'tEXt' END, CASE WHEN k % 2 <> 0 THEN 'eXIf' END], lambda x: x IS NOT NULL), ',') AS dropped FROM {_K}""",
    "media_descriptions": f"""WITH m AS (SELECT k, k % 3 = 0 AS pag, CASE WHEN k % 11 = 0 OR k % 50 = 0 OR k + 1 > 1000000 OR k % 150 < 1 OR k % 150 > 120 THEN 'canvas or timing out of range' WHEN k % 13 = 0 THEN 'region out of bounds' END AS wrong FROM {_K}),
      v AS (SELECT *, CASE WHEN pag THEN CASE WHEN k % 4 = 0 OR k % 5 = 0 THEN 'unsupported version or compression' WHEN k % 9 = 0 THEN 'body length differs from header' END WHEN k % 7 IN (1, 2) THEN NULL WHEN wrong IS NOT NULL THEN wrong WHEN k % 7 = 0 THEN 'more than one description' END AS error FROM m)
      SELECT k || CASE WHEN pag THEN '.pag' ELSE '.mp4' END AS path, CASE WHEN pag THEN 'pag' WHEN k % 7 IN (1, 2) THEN 'mp4' ELSE 'vap' END AS kind, CASE WHEN NOT pag AND k % 7 > 2 AND error IS NULL THEN 4 END AS width,
        CASE WHEN NOT pag AND k % 7 > 2 AND error IS NULL THEN (k % 50)::INTEGER END AS height, CASE WHEN NOT pag AND k % 7 > 2 AND error IS NULL THEN (k + 1)::INTEGER END AS frames, error FROM v""",
    "plan_problems": """WITH o AS (SELECT o_orderkey AS k, 'p' || CASE WHEN o_orderkey % 50 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS path, floor(o_totalprice) AS price FROM orders)
      SELECT path, 'duplicate candidate path' AS problem FROM o GROUP BY 1 HAVING count(*) > 1
      UNION ALL SELECT path, CASE WHEN k % 29 = 0 OR (k % 31 = 0 AND regexp_matches(sha256(k::VARCHAR), '[a-f]')) THEN 'invalid SHA-256 digest' ELSE 'invalid candidate sizes' END FROM o
      WHERE k % 29 = 0 OR (k % 31 = 0 AND regexp_matches(sha256(k::VARCHAR), '[a-f]')) OR k % 37 = 0 OR k % 41 = 0 OR k % 9 >= price""",
    "plan_mismatches": _TREE + f""" SELECT path, 'eligibility or Contents.json changed' AS problem FROM rend WHERE reason IS NOT NULL OR contents_path LIKE 'm%1/%' UNION ALL SELECT 'gone' || k, 'no longer referenced by a supported catalog' FROM {_K} WHERE k % 100 = 0""",
    "cache_lookup": f"""WITH e AS (SELECT k, 'r' || k AS result, k % 4 = 0 OR k % 5 = 2 AS broken FROM {_K} WHERE k % 3 <> 0 AND k % 7 <> 0)
      SELECT o_orderkey AS resource, CASE WHEN NOT broken THEN result END AS result, CASE WHEN e.k IS NULL THEN 'miss' WHEN broken THEN 'stale' ELSE 'hit' END AS verdict FROM orders LEFT JOIN e ON o_custkey % 11 <> 0 AND e.k = o_custkey""",
    "reused_results": "WITH o AS (SELECT doc_id AS resource, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS owner FROM documents) SELECT resource, owner, n_chars AS bytes FROM o JOIN documents ON doc_id = owner",
    "missing_files": f"SELECT k AS resource, 'f' || k || '.png' AS path FROM {_K} WHERE (k % 3 = 0 OR k % 5 = 0) AND NOT (k % 3 <> 0 AND k % 10 = 0)",
    "apply_report": "SELECT count(*) FILTER (l_returnflag = 'R')::BIGINT AS changed, count(*) FILTER (l_returnflag = 'A')::BIGINT AS already_current, coalesce(sum(floor(l_extendedprice)::BIGINT) FILTER (l_returnflag = 'R'), 0)::BIGINT AS source_bytes_saved FROM lineitem",
}

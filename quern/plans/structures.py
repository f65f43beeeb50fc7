"""Queries on archives, animations and references, bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import archive, references, sprites
from quern.plans.tables import read


def _entries(spark, sf_dir):
    """sale lines as entries of archives (sales); a line that occurs twice is a place taken twice."""
    s = read(spark, sf_dir, "sale_lines")
    i, v = F.coalesce("item_id", F.lit(0)), F.coalesce("vendor_id", F.lit(0))
    return s.select(
        F.col("sale_id").alias("archive"), F.col("line_no").alias("position"), F.lit("").alias("comment"), F.concat_ws("|", i.cast("string"), "flag").alias("meta"),
        F.sha2(F.concat_ws("|", i.cast("string"), F.col("quantity").cast("string")), 256).alias("sha256"), (i % 2 == 0).alias("png"), (v % 7 == 0).alias("metadata"), (i % 41 == 1).alias("integrity"), (F.col("sale_id") * 7 + F.col("line_no")).alias("k"),
    )


def archive_comparison(spark, sf_dir):
    """Sales as archives before and after a rewrite that drops some entries and changes others: what is wrong with each."""
    a = _entries(spark, sf_dir)
    b = a.where("k % 53 <> 0 or k is null")
    meta = F.when(F.col("k") % 59 == 0, F.concat("meta", F.lit("x"))).otherwise(F.col("meta")).alias("meta")
    sha = F.when(F.col("k") % 13 == 0, F.sha2(F.concat("sha256", F.lit("x")), 256)).otherwise(F.col("sha256")).alias("sha256")
    b = b.select("archive", "position", "comment", meta, sha, "png", "metadata", "integrity")
    pairs = archive.changed_pictures(a, b)
    pictures = pairs.withColumn("same", F.col("sha256").rlike("^[0-9]"))  # stands for decoding: contents whose hash begins with a digit
    contracts = a.where("archive % 97 = 0").select("archive")
    return archive.compare_archives(a, b, contracts, pictures)


def _sprites(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.concat("event_type", (F.col("event_id") % 4).cast("string"))
    return e.select(
        F.col("user_id").alias("movie"), F.col("event_id").alias("sprite"), F.when(F.col("event_id") % 5 == 0, F.concat(kind, F.lit(".matte"))).when(F.col("event_id") % 11 != 0, kind).alias("image_key"),
        F.when(F.col("event_id") % 3 == 0, F.concat(kind, F.lit(".matte"))).alias("matte_key"), kind.alias("kind"),
    )


def sprite_roles(spark, sf_dir):
    """Events as sprites of their user's movie: image, role and matte of each."""
    s = _sprites(spark, sf_dir)
    images = s.where("sprite % 2 = 0").select("movie", F.col("kind").alias("key"), (~F.col("kind").endswith("3")).alias("drawable"))
    return sprites.resolve(s.drop("kind"), images)


def sprite_frame_shapes(spark, sf_dir):
    """Orders' dates as frames, line items' as shapes set: the shape that holds at each order of a customer (an as-of join)."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("movie"), F.datediff("o_orderdate", F.lit("1990-01-01")).alias("frame"))
    shapes = o.where("k % 3 = 0").select("movie", F.lit(0).alias("sprite"), "frame", F.col("k").alias("seq"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("shape"))
    frames = o.select("movie", F.lit(0).alias("sprite"), "frame").distinct()
    return sprites.frame_shapes(frames, shapes).select("movie", "frame", "shape")


def _web(spark, sf_dir):
    """pages as texts with one reference each, in all the forms there are."""
    p = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), (F.col("page_id") % 40).alias("n"), (F.col("page_id") % 9).alias("r"))
    n, own = F.col("n").cast("string"), F.concat(F.lit("docs/p"), (F.col("id") % 3).cast("string"))
    name = F.concat(F.lit("i"), n, F.lit(".png"))
    value = F.when(F.col("r") == 0, F.concat(F.lit("img/"), name)).when(F.col("r") == 1, F.concat(F.lit("./img/../img/"), name, F.lit("?v=1"))).when(F.col("r") == 2, F.concat(own, F.lit("/img/"), name)).when(F.col("r") == 3, name)
    value = value.when(F.col("r") == 4, F.concat(F.lit("https://x.org/"), name)).when(F.col("r") == 5, F.concat(F.lit("/img/"), name)).when(F.col("r") == 6, F.concat(F.lit("img\\"), name)).when(F.col("r") == 7, F.concat(F.lit("../../"), own, F.lit("/img/"), name))
    value = value.otherwise(F.concat(F.lit("none/"), name))
    return p.select(F.concat(own, F.lit("/page"), F.col("id").cast("string"), F.lit(".html")).alias("path"), F.concat(F.lit('<p class="x"><img src="'), value, F.lit('"> say "hello"')).alias("text"))


def reference_resolution(spark, sf_dir):
    """References of pages to images whose paths are made of parts: which image each means, and how surely."""
    k = F.col("p_partkey")
    paths = read(spark, sf_dir, "part").where(k % 5 != 0).select(F.concat(F.lit("docs/p"), (k % 4).cast("string"), F.lit("/img/i"), F.floor(k / 7).cast("string"), F.lit(".png")).alias("path"))
    return references.resolve(references.literals(_web(spark, sf_dir)), paths)


QUERIES = {f.__name__: f for f in (archive_comparison, sprite_roles, sprite_frame_shapes, reference_resolution)}

_KIND = "event_type || (event_id % 4)::VARCHAR"
ORACLE_SQL = {
    "archive_comparison": """WITH a AS (
  SELECT sale_id AS archive, line_no AS position, coalesce(item_id, 0)::VARCHAR || coalesce('|' || flag, '') AS meta, sha256(coalesce(item_id, 0)::VARCHAR || coalesce('|' || quantity::VARCHAR, '')) AS sha,
    coalesce(item_id, 0) % 2 = 0 AS png, coalesce(vendor_id, 0) % 7 = 0 AS md, coalesce(item_id, 0) % 41 = 1 AS integ, sale_id * 7 + line_no AS k FROM sale_lines WHERE sale_id IS NOT NULL),
t AS (SELECT archive, position, count(*) AS n, count(*) FILTER (k % 53 <> 0 OR k IS NULL) AS m FROM a GROUP BY ALL),
torn AS (SELECT DISTINCT archive FROM t WHERE n <> 1 OR m <> 1),
f AS (SELECT archive, position, CASE WHEN k % 59 = 0 THEN 'archive_entry_metadata_changed' WHEN integ AND NOT md THEN 'archive_integrity_contract_requires_publisher' WHEN k % 13 = 0 AND NOT (png AND NOT md) THEN 'archive_non_image_payload_changed'
    WHEN k % 13 = 0 AND sha[1] NOT BETWEEN '0' AND '9' THEN 'archive_image_pixels_changed' END AS fault FROM a),
g AS (SELECT archive, min(position) AS position, arg_min(fault, position) AS fault FROM f WHERE fault IS NOT NULL GROUP BY 1),
w AS (SELECT DISTINCT archive, CASE WHEN archive % 97 = 0 THEN 'archive_integrity_contract_requires_publisher' WHEN archive IN (SELECT archive FROM torn) THEN 'archive_structure_changed' END AS whole FROM a)
SELECT w.archive, coalesce(whole, fault) AS verdict, CASE WHEN whole IS NULL THEN position END AS position FROM w LEFT JOIN g USING (archive)""",
    "sprite_roles": f"""WITH s AS (
  SELECT user_id AS movie, event_id AS sprite, {_KIND} AS kind, CASE WHEN event_id % 5 = 0 THEN {_KIND} || '.matte' WHEN event_id % 11 <> 0 THEN {_KIND} ELSE '' END AS image_key,
    CASE WHEN event_id % 3 = 0 THEN {_KIND} || '.matte' ELSE '' END AS matte_key FROM events),
m AS (SELECT movie, image_key, max(sprite) AS matte FROM s WHERE suffix(image_key, '.matte') GROUP BY 1, 2),
u AS (SELECT movie, replace(image_key, '.matte', '') AS name, min(sprite) AS first FROM s WHERE image_key <> '' GROUP BY 1, 2),
i AS (SELECT movie, name, (row_number() OVER (PARTITION BY movie ORDER BY first) - 1)::INTEGER AS image FROM u WHERE NOT suffix(name, '3') AND (movie, name) IN (SELECT (movie, kind) FROM s WHERE sprite % 2 = 0))
SELECT s.movie, s.sprite, CASE WHEN suffix(s.image_key, '.matte') THEN 'matte' WHEN m.matte IS NOT NULL THEN 'masked' ELSE 'plain' END AS role, CASE WHEN NOT suffix(s.image_key, '.matte') THEN m.matte END AS matte, i.image
FROM s LEFT JOIN m ON m.movie = s.movie AND m.image_key = s.matte_key LEFT JOIN i ON i.movie = s.movie AND i.name = replace(s.image_key, '.matte', '')""",
    "sprite_frame_shapes": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS movie, date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::INTEGER AS frame FROM orders),
f AS (SELECT DISTINCT movie, frame FROM o), s AS (SELECT movie, frame, max(k) AS k FROM o WHERE k % 3 = 0 GROUP BY 1, 2)
SELECT f.movie, f.frame, 's' || s.k AS shape FROM f ASOF LEFT JOIN s ON s.movie = f.movie AND s.frame <= f.frame""",
    "reference_resolution": r"""WITH q AS (SELECT DISTINCT 'docs/p' || (p_partkey % 4) || '/img/i' || (p_partkey // 7) || '.png' AS source, p_partkey // 7 AS n FROM part WHERE p_partkey % 5 <> 0),
u AS (SELECT n, count(*) AS same FROM q GROUP BY 1),
w AS (SELECT page_id, page_id % 9 AS r, page_id % 40 AS n, 'docs/p' || (page_id % 3) AS own, 'i' || (page_id % 40) || '.png' AS name FROM pages),
v AS (SELECT *, own || '/page' || page_id || '.html' AS path, CASE r WHEN 0 THEN 'img/' || name WHEN 1 THEN './img/../img/' || name || '?v=1' WHEN 2 THEN own || '/img/' || name WHEN 3 THEN name WHEN 4 THEN 'https://x.org/' || name
    WHEN 5 THEN '/img/' || name WHEN 6 THEN 'img\' || name WHEN 7 THEN '../../' || own || '/img/' || name ELSE 'none/' || name END AS value FROM w),
l AS (SELECT path, value, source, 'local' AS how FROM v JOIN q ON source = own || '/img/' || name WHERE r IN (0, 1, 7)),
x AS (SELECT path, value, source, 'exact' AS how FROM v JOIN q ON source = value WHERE r = 2),
s AS (SELECT path, value, source, CASE WHEN same = 1 THEN 'suffix' ELSE 'ambiguous' END AS how FROM v JOIN q ON q.n = v.n JOIN u ON u.n = v.n WHERE r IN (0, 3) AND (path, value) NOT IN (SELECT (path, value) FROM l)),
f AS (SELECT * FROM l UNION ALL SELECT * FROM x UNION ALL SELECT * FROM s)
SELECT * FROM f UNION ALL SELECT path, value, NULL, CASE WHEN r IN (4, 5) THEN 'outside' WHEN r = 6 THEN 'escaped' ELSE 'missing' END FROM v WHERE (path, value) NOT IN (SELECT (path, value) FROM f)""",
}

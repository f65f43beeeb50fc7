"""Queries on identical and similar groups, image measures and reuse."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import palettes as palette
from quern.operators import reuse, sequence, similarity
from quern.plans.tables import read

LIMIT = 0.118


def _texts(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.col("doc_id").cast("string").alias("variant"))


def identical_groups(spark, sf_dir):
    """Groups of equal documents by their first (longest, then smallest id): members and redundant bytes, without any pair."""
    t = _texts(spark, sf_dir)
    return t.groupBy("sha256").agg(F.count("*").alias("members"), F.min_by("id", F.struct((-F.col("bytes")).alias("k"), "id")).alias("reference"), (F.sum("bytes") - F.max("bytes")).alias("redundant_bytes")).where("members > 1").select("reference", "members", "redundant_bytes")


def identical_pairs(spark, sf_dir):
    return similarity.identical_pairs(_texts(spark, sf_dir))


def _vectors(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.lit(1).alias("bytes"), F.col("label").alias("part"), "embedding", F.col("embedding").alias("vector"))


def similar_pairs(spark, sf_dir):
    return similarity.near_pairs(_vectors(spark, sf_dir), LIMIT).select("a", "b", F.round("difference", 6).alias("difference"))


def _groups(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return similarity.fixed_reference_groups(v, similarity.near_pairs(v, LIMIT))


def similar_groups(spark, sf_dir):
    return _groups(spark, sf_dir)


def group_score_range(spark, sf_dir):
    """Score range, redundant bytes and rank of each group (bytes of a vector: 100 + id % 7)."""
    v = _vectors(spark, sf_dir).select("id", "vector")
    m = _groups(spark, sf_dir).join(v, "id").join(v.select(F.col("id").alias("reference"), F.col("vector").alias("other")), "reference")
    m = m.withColumn("score", similarity.score(F.lit(False), similarity.mean_abs_difference(F.col("vector"), F.col("other")))).withColumn("bytes", 100 + F.col("id") % 7)
    rest = F.col("id") != F.col("reference")
    g = m.groupBy("reference").agg(F.count("*").alias("members"), F.round(F.min(F.when(rest, F.col("score"))), 6).alias("low"), F.round(F.max(F.when(rest, F.col("score"))), 6).alias("high"), F.sum(F.when(rest, F.col("bytes"))).alias("redundant_bytes"))
    return similarity.rank_groups(g)


def _measured(spark, sf_dir):
    """Sizes and hashes of vectors, made of ids."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"))
    return e.select("id", (100 + F.col("id") % 7).alias("bytes"), F.when(F.col("id") % 2 == 0, "x").otherwise(F.col("id").cast("string")).alias("sha256"), (F.col("id") % 3).alias("width"), F.lit(1).alias("height"))


def similar_groups_without_missing(spark, sf_dir):
    """Groups after every fifth id vanished: what is left, judged anew; groups of one go."""
    m = _measured(spark, sf_dir)
    return similarity.without_missing(_groups(spark, sf_dir), m, m.where("id % 5 = 0").select("id"))


def ordered_groups(spark, sf_dir):
    g = similarity.ordered_groups(_groups(spark, sf_dir), _measured(spark, sf_dir))
    return g.select("reference", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "redundant_bytes")


def _images(spark, sf_dir):
    """parts as images of 2 x 2 cells, so that each rule of likeness decides somewhere: colours, aspect, brightness, opacity, one cell, frames and variants."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    luma = F.array(*[(0.5 + (k * m % 5) * w).cast("double") for m, w in ((3, 0.01), (7, 0.012), (11, 0.008), (13, 0.05))])
    alpha = F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0), (1 - (k % 3) * 0.07).cast("double"))
    return p.select(
        k.alias("id"), (1000 + k % 13).alias("bytes"), F.floor(k / 2).cast("string").alias("variant"), F.when(k % 29 == 0, 2).otherwise(1).alias("frames"), (100 + k % 7).cast("int").alias("width"), F.lit(100).alias("height"), luma.alias("luma"), alpha.alias("alpha"),
        (k % 50 * 5).cast("int").alias("red"), (k % 9 * 4).cast("int").alias("green"), F.lit(7).alias("blue"), (k % 17 != 0).alias("detailed"), F.when(k % 31 == 0, "same").otherwise(F.concat(F.lit("h"), k.cast("string"))).alias("sha256"),
    )


def similar_images(spark, sf_dir):
    return similarity.similar_images(_images(spark, sf_dir))


def _copied(spark, sf_dir):
    """parts as copies of pictures: six neighbours share a picture, two of them a variant; neighbouring pictures share variants, some have no hash."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    q = F.floor(F.col("id") / 6)
    p = p.withColumn("q", q).withColumn("variant", F.concat(F.lit("v"), (F.floor(q / 4) * 10 + F.floor(F.col("id") % 6 / 2) + q % 3).cast("string")))
    luma = F.array(*[(0.5 + (F.col("q") * m % 3) * w).cast("double") for m, w in ((1, 0.02), (1, 0.02), (2, 0.01), (1, 0.03))])
    return p.select(
        "id", (1000 + F.col("q") % 5).alias("bytes"), "variant", F.lit(1).alias("frames"), F.lit(100).alias("width"), F.lit(100).alias("height"), luma.alias("luma"), F.array_repeat(F.lit(1.0), 4).alias("alpha"),
        (F.floor(F.col("q") / 7) % 50 * 5).cast("int").alias("red"), (F.floor(F.col("q") / 350) * 16 % 240).cast("int").alias("green"), F.lit(7).alias("blue"), (F.col("q") % 17 != 0).alias("detailed"), F.when(F.col("q") % 23 != 0, F.concat(F.lit("h"), F.col("q").cast("string"))).alias("sha256"),
    )


def image_groups(spark, sf_dir):
    """Groups of identical and similar pictures over all copies and variants."""
    return similarity.image_groups(_copied(spark, sf_dir))


def image_comparisons(spark, sf_dir):
    """Each image against the first of its hundred."""
    e = _images(spark, sf_dir)
    g = e.select("id", F.greatest(F.floor(F.col("id") / 100) * 100, F.lit(1)).cast("long").alias("reference"))
    c = similarity.comparisons(g, e)
    return c.select("reference", "id", "identical", *[F.round(x, 6).alias(x) for x in ("brightness", "opacity", "color", "peak", "score")])


def group_kinds(spark, sf_dir):
    """Kinds of the groups, with sizes and hashes made of ids."""
    m = _groups(spark, sf_dir).select("id", "reference", (100 + F.col("id") % 7).alias("bytes"), F.lit("x").alias("s"), (F.col("id") % 2).alias("width"), F.lit(1).alias("height"), (F.col("id") % 3 * 0.01).alias("luma"))
    m = m.withColumn("sha256", F.when(F.col("reference") % 4 == 0, F.col("s")).otherwise(F.col("id").cast("string")))
    return similarity.group_measures(m)


def fingerprint_grid(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("cells"))
    return similarity.fingerprint_grid(e, 8, 4).select("id", "gy", "gx", F.round("mean", 6).alias("mean"))


def vector_difference(spark, sf_dir):
    """Each vector against the one before it by id."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    d = pairs.select("vec_id", similarity.vector_difference(F.col("other"), F.col("embedding")).alias("d"))
    return d.select("vec_id", F.round("d.mae_255", 5).alias("mae_255"), F.round("d.psnr_db", 5).alias("psnr_db"), F.round("d.max_error", 5).alias("max_error"))


def color_histogram(spark, sf_dir):
    c = read(spark, sf_dir, "events").select(F.floor(F.col("value") * 10).cast("long").alias("color"))
    return similarity.color_histogram(c, 60)


def palettes(spark, sf_dir):
    """Events as pixels, one image for each type and remainder of the user: the palette of six colours of each, all images at once."""
    e, v = read(spark, sf_dir, "events"), F.floor(F.abs("value"))
    image = F.concat("event_type", (F.col("user_id") % 3).cast("string"))
    c = e.select(image.alias("image"), (v % 256).alias("red"), (F.col("user_id") * 7 % 256).alias("green"), (F.col("event_id") * 11 % 64).alias("blue"), F.when(F.col("event_id") % 9 == 0, 0).otherwise(255).alias("alpha"))
    return palette.palettes(palette.histograms(c), 6, 2)


def fingerprints(spark, sf_dir):
    """Embeddings as images of 8 x 2 pixels, in a grid of 4 x 4 cells: smaller than the grid one way, larger the other."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.least(F.abs(x).cast("double") * 4, F.lit(1.0))).alias("rgba"))
    return similarity.fingerprint(e.select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), F.lit(2).alias("height"), "rgba"), 4)


def reuse_keys(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("|", F.sha2(F.col("text").cast("binary"), 256), "source"), 256).alias("key"))
    return reuse.reuse(d, "key", "doc_id").select("doc_id", "owner", "reused")


def reuse_totals(spark, sf_dir):
    return reuse_keys(spark, sf_dir).agg(F.count("*").alias("rows"), F.count_if("reused").alias("reused"))


def cache_prune(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").alias("mtime"), F.floor(F.abs("value")).cast("long").alias("bytes"), F.col("event_id").alias("path"), F.to_date("ts").alias("day"))
    return reuse.prune(e, 200_000).select("event_id", "bytes")


def dedup_exclusion_wins(spark, sf_dir):
    i = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("path"), (F.col("l_discount") < 0.09).alias("eligible"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return reuse.exclusion_wins(i, "path", "eligible", "seq")


def phase_seconds(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("phase"), F.col("value").alias("seconds"))
    return reuse.phase_seconds(e).select("phase", F.round("seconds", 4).alias("seconds"))


def _frames(spark, sf_dir):
    return read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


def carry_forward(spark, sf_dir):
    e = _frames(spark, sf_dir).withColumn("shape", F.when(F.col("event_type") != "view", F.col("event_type")))
    return sequence.carry_forward(e, "user_id", ["ts", "event_id"], "shape").select("event_id", "carried")


def run_groups(spark, sf_dir):
    return sequence.runs(_frames(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")


def poster_argmax(spark, sf_dir):
    e = _frames(spark, sf_dir).withColumn("sprites", F.length("event_type")).withColumn("ink", F.floor("value"))
    return sequence.poster(e, "user_id", "event_id", "sprites", "ink")


QUERIES = {f.__name__: f for f in (identical_groups, identical_pairs, similar_pairs, similar_groups, group_score_range, similar_groups_without_missing, ordered_groups, similar_images, image_groups, image_comparisons, group_kinds, fingerprint_grid, vector_difference, color_histogram, palettes, fingerprints, reuse_keys, reuse_totals, cache_prune, dedup_exclusion_wins, phase_seconds, carry_forward, run_groups, poster_argmax)}

_DIFF = "list_sum(list_transform(range(1, 65), lambda i: abs(x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE))) / 64"
_PAIRS = f"""p AS (SELECT x.vec_id AS a, y.vec_id AS b, {_DIFF} AS d FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id WHERE {_DIFF} <= {LIMIT})"""
_GROUPS = f"""WITH RECURSIVE {_PAIRS},
n AS (SELECT a AS id FROM p UNION SELECT b FROM p),
o AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM n),
w AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS refs UNION ALL
  SELECT o.k, CASE WHEN len(list_intersect(w.refs, coalesce((SELECT list(a) FROM p WHERE b = o.id), []))) > 0 THEN w.refs ELSE list_append(w.refs, o.id) END FROM w JOIN o ON o.k = w.k + 1),
refs AS (SELECT unnest(refs) AS id FROM (SELECT refs FROM w ORDER BY k DESC LIMIT 1)),
m AS (SELECT b AS id, min(a) AS reference FROM p WHERE a IN (SELECT id FROM refs) AND b NOT IN (SELECT id FROM refs) GROUP BY 1),
g AS (SELECT id, reference FROM m UNION SELECT reference, reference FROM m)
"""
_IMAGES = """WITH i AS (SELECT p_partkey AS id, 1000 + p_partkey % 13 AS bytes, p_partkey // 2 AS variant, CASE WHEN p_partkey % 29 = 0 THEN 2 ELSE 1 END AS frames, (100 + p_partkey % 7) / 100.0::DOUBLE AS aspect,
  0.5::DOUBLE + (p_partkey * 3 % 5) * 0.01::DOUBLE AS l1, 0.5::DOUBLE + (p_partkey * 7 % 5) * 0.012::DOUBLE AS l2, 0.5::DOUBLE + (p_partkey * 11 % 5) * 0.008::DOUBLE AS l3, 0.5::DOUBLE + (p_partkey * 13 % 5) * 0.05::DOUBLE AS l4, 1 - (p_partkey % 3) * 0.07::DOUBLE AS a4,
  p_partkey % 50 * 5 AS red, p_partkey % 9 * 4 AS green, p_partkey % 17 <> 0 AS detailed, CASE WHEN p_partkey % 31 = 0 THEN 'same' ELSE 'h' || p_partkey END AS sha FROM part)
"""
_GAPS = "(abs(x.l1 - y.l1) + abs(x.l2 - y.l2) + abs(x.l3 - y.l3) + abs(x.l4 - y.l4)) / 4 {0} AND abs(x.a4 - y.a4) / 4 {1} AND greatest(abs(x.l1 - y.l1), abs(x.l2 - y.l2), abs(x.l3 - y.l3), abs(x.l4 - y.l4), abs(x.a4 - y.a4)) {2}"
_COPIED = """WITH RECURSIVE i AS (SELECT p_partkey AS id, p_partkey // 6 AS q FROM part),
e AS (SELECT id, q, 1000 + q % 5 AS bytes, q // 4 * 10 + id % 6 // 2 + q % 3 AS variant, 0.5::DOUBLE + (q % 3) * 0.02::DOUBLE AS l1, 0.5::DOUBLE + (q * 2 % 3) * 0.01::DOUBLE AS l3, 0.5::DOUBLE + (q % 3) * 0.03::DOUBLE AS l4,
  q // 7 % 50 * 5 AS red, q // 350 * 16 % 240 AS green, q % 17 <> 0 AS detailed, CASE WHEN q % 23 <> 0 THEN q END AS sha FROM i),
o AS (SELECT *, row_number() OVER (ORDER BY bytes DESC, id) AS k FROM e),
p AS MATERIALIZED (SELECT x.k AS a, y.k AS b FROM o x JOIN o y ON x.k < y.k AND x.variant <> y.variant AND (x.sha = y.sha OR (x.detailed AND y.detailed AND abs(x.red - y.red) <= 14 AND abs(x.green - y.green) <= 14
  AND (2 * abs(x.l1 - y.l1) + abs(x.l3 - y.l3) + abs(x.l4 - y.l4)) / 4 <= 0.022::DOUBLE))),
w AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS refs UNION ALL
  SELECT o.k, CASE WHEN len(list_intersect(w.refs, coalesce((SELECT list(a) FROM p WHERE b = o.k), []))) > 0 THEN w.refs ELSE list_append(w.refs, o.k) END FROM w JOIN o ON o.k = w.k + 1),
refs AS (SELECT unnest(refs) AS k FROM (SELECT refs FROM w ORDER BY k DESC LIMIT 1)),
m AS (SELECT b AS k, min(a) AS r FROM p WHERE a IN (SELECT k FROM refs) AND b NOT IN (SELECT k FROM refs) GROUP BY 1),
g AS (SELECT k, r FROM m UNION SELECT r, r FROM m)
"""
_LUMA = "(0.2126::DOUBLE * p[k * 4 + 1] + 0.7152::DOUBLE * p[k * 4 + 2] + 0.0722::DOUBLE * p[k * 4 + 3] + (1 - p[k * 4 + 4]) * 0.5::DOUBLE)"


def _palettes_sql(most: int, rounds: int) -> str:
    """One cut after another, each with its own views; then the centres move."""
    axes = range(4)
    views = ["""p0 AS MATERIALIZED (SELECT image, c, [c.red * a, c.green * a, c.blue * a, c.alpha * 2.0::DOUBLE] AS p, w, 'r' AS box FROM (
  SELECT image, c, c.alpha / 255.0::DOUBLE AS a, count(*)::DOUBLE AS w FROM (SELECT event_type || (user_id % 3)::VARCHAR AS image, {'red': floor(abs(value))::BIGINT % 256, 'green': user_id * 7 % 256, 'blue': event_id * 11 % 64, 'alpha': CASE WHEN event_id % 9 = 0 THEN 0 ELSE 255 END} AS c FROM events) GROUP BY ALL))"""]
    for k in range(most - 1):
        error = ", ".join(f"{{'e': CASE WHEN min(p[{i + 1}]) < max(p[{i + 1}]) THEN greatest(sum(p[{i + 1}] * p[{i + 1}] * w) - sum(p[{i + 1}] * w) * sum(p[{i + 1}] * w) / sum(w), 0) ELSE 0 END, 'i': {-i}, 'cut': sum(p[{i + 1}] * w) / sum(w)}}" for i in axes)
        views.append(f"s{k} AS (SELECT image, box, list_max([{error}]) AS b FROM p{k} GROUP BY ALL)")
        views.append(f"t{k} AS (SELECT image, box, b FROM s{k} WHERE b.e > 0 QUALIFY row_number() OVER (PARTITION BY image ORDER BY b.e DESC, length(box), box) = 1)")
        views.append(f"p{k + 1} AS MATERIALIZED (SELECT p.image, p.c, p.p, p.w, p.box || CASE WHEN t.box IS NULL THEN '' WHEN p.p[1 - t.b.i] <= t.b.cut THEN '0' ELSE '1' END AS box FROM p{k} p LEFT JOIN t{k} t ON t.image = p.image AND t.box = p.box)")
    mean = "[" + ", ".join(f"sum(p[{i + 1}] * w) / sum(w)" for i in axes) + "]"
    views.append(f"c0 AS MATERIALIZED (SELECT image, row_number() OVER (PARTITION BY image ORDER BY box) AS i, c FROM (SELECT image, box, {mean} AS c FROM p{most - 1} GROUP BY ALL))")
    gap = " + ".join(f"(p[{i + 1}] - c[{i + 1}]) * (p[{i + 1}] - c[{i + 1}])" for i in axes)
    for k in range(rounds):
        views.append(f"n{k} AS MATERIALIZED (SELECT x.image, x.p, x.w, min({{'g': {gap}, 'i': i}}).i AS i FROM p0 x JOIN c{k} y ON y.image = x.image GROUP BY x.image, x.p, x.w, x.c)".replace("p[", "x.p[").replace("c[", "y.c["))
        views.append(f"c{k + 1} AS MATERIALIZED (SELECT image, i, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN (SELECT image, i, {mean} AS c FROM n{k} GROUP BY ALL) m USING (image, i))")
    level = lambda i: f"CASE WHEN a > 0 THEN floor(least(greatest(c[{i}] / (a / 255), 0), 255) + 0.5)::INTEGER ELSE 0 END"
    return f"WITH {', '.join(views)} SELECT DISTINCT image, {level(1)} AS red, {level(2)} AS green, {level(3)} AS blue, floor(a + 0.5)::INTEGER AS alpha FROM (SELECT *, least(greatest(c[4] / 2, 0), 255) AS a FROM c{rounds})"


_SHA = "sha256(text)"
ORACLE_SQL = {
    "identical_groups": f"SELECT arg_min(doc_id, (-n_chars, doc_id)) AS reference, count(*)::BIGINT AS members, (sum(n_chars) - max(n_chars))::BIGINT AS redundant_bytes FROM documents GROUP BY {_SHA} HAVING count(*) > 1",
    "identical_pairs": "WITH f AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text ORDER BY n_chars DESC, doc_id) AS a FROM documents WHERE text IS NOT NULL) SELECT a, doc_id AS b FROM f WHERE a <> doc_id",
    "similar_pairs": f"WITH {_PAIRS} SELECT a, b, round(d, 6) AS difference FROM p",
    "similar_groups": _GROUPS + "SELECT * FROM g",
    "group_score_range": _GROUPS + f""", s AS (SELECT g.id, reference, least(greatest(100 * (1 - {_DIFF}), 0), 99.9::DOUBLE) AS score, 100 + g.id % 7 AS bytes FROM g JOIN embeddings x ON x.vec_id = g.id JOIN embeddings y ON y.vec_id = reference),
      t AS (SELECT reference, count(*)::BIGINT AS members, round(min(score) FILTER (id <> reference), 6) AS low, round(max(score) FILTER (id <> reference), 6) AS high, (sum(bytes) FILTER (id <> reference))::BIGINT AS redundant_bytes FROM s GROUP BY 1)
      SELECT *, row_number() OVER (ORDER BY redundant_bytes DESC, reference)::INTEGER AS rank FROM t""",
    "similar_groups_without_missing": _GROUPS + """, q AS (SELECT id, reference, 100 + id % 7 AS bytes, CASE WHEN id % 2 = 0 THEN 'x' ELSE id::VARCHAR END AS sha, id % 3 AS w FROM g WHERE id % 5 <> 0),
      l AS (SELECT *, first_value(id) OVER o AS f, first_value(sha) OVER o AS fs, first_value(w) OVER o AS fw, first_value(bytes) OVER o AS fb FROM q WINDOW o AS (PARTITION BY reference ORDER BY bytes DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
      SELECT reference, any_value(f) AS "first", count(*)::BIGINT AS members, CASE WHEN count(*) < (SELECT count(*) FROM g WHERE g.reference = l.reference) THEN CASE WHEN bool_and(sha = fs) THEN 'identical' WHEN bool_or(w <> fw) THEN 'resized' ELSE 'similar' END END AS kind,
      (sum(bytes) - any_value(fb))::BIGINT AS redundant_bytes, any_value(f) = reference AS scored FROM l GROUP BY reference HAVING count(*) > 1""",
    "ordered_groups": _GROUPS + "SELECT reference, string_agg(id::VARCHAR, ',' ORDER BY id % 7 DESC, id) AS members, coalesce(sum(100 + id % 7) FILTER (id <> reference), 0)::BIGINT AS redundant_bytes FROM g GROUP BY 1",
    "similar_images": _IMAGES + """SELECT x.id AS a, y.id AS b FROM i x JOIN i y ON (x.bytes > y.bytes OR (x.bytes = y.bytes AND x.id < y.id)) AND x.variant <> y.variant AND abs(x.red - y.red) <= 14 AND abs(x.green - y.green) <= 14
      AND abs(x.aspect - y.aspect) <= 0.03::DOUBLE * greatest(x.aspect, y.aspect) WHERE x.frames = 1 AND y.frames = 1 AND x.detailed AND y.detailed AND """ + _GAPS.format("<= 0.022::DOUBLE", "<= 0.03::DOUBLE", "<= 0.16::DOUBLE"),
    "image_groups": _COPIED + "SELECT x.id, y.id AS reference FROM g JOIN o x ON x.k = g.k JOIN o y ON y.k = g.r",
    "image_comparisons": _IMAGES + """, c AS (SELECT r.id AS reference, x.id, x.sha = r.sha AS identical, (abs(x.l1 - r.l1) + abs(x.l2 - r.l2) + abs(x.l3 - r.l3) + abs(x.l4 - r.l4)) / 4 AS brightness, abs(x.a4 - r.a4) / 4 AS opacity,
      greatest(abs(x.red - r.red), abs(x.green - r.green)) / 255.0::DOUBLE AS color, greatest(abs(x.l1 - r.l1), abs(x.l2 - r.l2), abs(x.l3 - r.l3), abs(x.l4 - r.l4), abs(x.a4 - r.a4)) AS peak FROM i x JOIN i r ON r.id = greatest(x.id // 100 * 100, 1))
      SELECT reference, id, identical, round(brightness, 6) AS brightness, round(opacity, 6) AS opacity, round(color, 6) AS color, round(peak, 6) AS peak, round(CASE WHEN identical THEN 100 ELSE least(greatest(100 * (1 - greatest(brightness, opacity, color)), 0), 99.9::DOUBLE) END, 6) AS score FROM c""",
    "group_kinds": _GROUPS + """SELECT reference, CASE WHEN reference % 4 = 0 THEN 'identical' WHEN bool_or(id % 2 <> reference % 2) AND bool_and(id % 3 * 0.01::DOUBLE <= 0.012::DOUBLE) THEN 'resized' ELSE 'similar' END AS kind,
      count(*)::BIGINT AS members, coalesce(sum(100 + id % 7) FILTER (id <> reference), 0)::BIGINT AS redundant_bytes FROM g GROUP BY 1""",
    "fingerprint_grid": "SELECT id, (pos // 8 * 4 // 8)::INTEGER AS gy, (pos % 8 * 4 // 8)::INTEGER AS gx, round(avg(v::DOUBLE), 6) AS mean FROM (SELECT vec_id AS id, unnest(embedding) AS v, unnest(range(0, 64)) AS pos FROM embeddings) GROUP BY ALL",
    "vector_difference": f"""SELECT y.vec_id, round({_DIFF} * 255, 5) AS mae_255, round(CASE WHEN sq > 0 THEN -10 * log10(sq) END, 5) AS psnr_db, round(list_max(list_transform(range(1, 65), lambda i: abs(x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE))), 5) AS max_error
      FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1, LATERAL (SELECT list_sum(list_transform(range(1, 65), lambda i: (x.embedding[i]::DOUBLE - y.embedding[i]::DOUBLE) ** 2)) / 64 AS sq)""",
    "color_histogram": """WITH e AS (SELECT floor(value * 10)::BIGINT AS c FROM events), b AS (SELECT min(k) AS bits FROM range(0, 40) t(k) WHERE (SELECT count(DISTINCT c >> k) FROM e) <= 60)
      SELECT c >> bits AS color, count(*)::BIGINT AS n, bits::INTEGER AS bits FROM e, b GROUP BY ALL""",
    "palettes": _palettes_sql(6, 2),
    "fingerprints": f"""WITH e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: least(abs(x)::DOUBLE * 4, 1)) AS p FROM embeddings),
      g AS (SELECT id, p, gy, gx, CASE WHEN gy < 2 THEN 0 ELSE 1 END AS y FROM e, range(4) a(gy), range(4) b(gx)),
      c AS (SELECT id, gy, gx, avg({_LUMA}) AS luma, avg(p[k * 4 + 4]) AS alpha FROM (SELECT *, y * 8 + gx * 2 + d AS k FROM g, range(2) t(d) WHERE d = 0 OR gy % 2 = 0) GROUP BY ALL),
      h AS (SELECT id, string_agg(printf('%02x', floor(least(greatest(luma, 0), 1) * 255 + 0.5)::INTEGER), '' ORDER BY gy, gx) AS luma, string_agg(printf('%02x', floor(least(greatest(alpha, 0), 1) * 255 + 0.5)::INTEGER), '' ORDER BY gy, gx) AS alpha, var_pop(luma) >= {similarity.FLAT} AS detailed, bool_and(alpha >= 0.999) AS opaque FROM c GROUP BY 1),
      m AS (SELECT id, list_sum(list_transform(range(16), lambda k: p[k * 4 + 1])) AS r, list_sum(list_transform(range(16), lambda k: p[k * 4 + 2])) AS g, list_sum(list_transform(range(16), lambda k: p[k * 4 + 3])) AS b, list_sum(list_transform(range(16), lambda k: p[k * 4 + 4])) AS a FROM e)
      SELECT id, luma, CASE WHEN opaque THEN '' ELSE alpha END AS alpha, CASE WHEN a > 0 THEN least(floor(r / a * 255 + 0.5), 255)::INTEGER ELSE 0 END AS red, CASE WHEN a > 0 THEN least(floor(g / a * 255 + 0.5), 255)::INTEGER ELSE 0 END AS green,
      CASE WHEN a > 0 THEN least(floor(b / a * 255 + 0.5), 255)::INTEGER ELSE 0 END AS blue, detailed FROM h JOIN m USING (id)""",
    "reuse_keys": "WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, source) AS owner FROM documents) SELECT doc_id, owner, owner <> doc_id AS reused FROM k",
    "reuse_totals": "WITH k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text, source) AS owner FROM documents) SELECT count(*)::BIGINT AS rows, count(*) FILTER (owner <> doc_id)::BIGINT AS reused FROM k",
    "cache_prune": "SELECT event_id, b AS bytes FROM (SELECT event_id, floor(abs(value))::BIGINT AS b, sum(floor(abs(value))::BIGINT) OVER (ORDER BY ts DESC, floor(abs(value))::BIGINT DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s <= 200000",
    "dedup_exclusion_wins": """WITH t AS (SELECT l_partkey AS path, l_discount < 0.09 AS eligible, l_orderkey * 100 + l_linenumber AS seq FROM lineitem)
      SELECT path, bool_and(eligible) AS eligible, coalesce(min(seq) FILTER (NOT eligible), max(seq)) AS seq FROM t GROUP BY 1""",
    "phase_seconds": "SELECT event_type AS phase, round(sum(value), 4) AS seconds FROM events GROUP BY 1 HAVING sum(value) > 0",
    "carry_forward": "SELECT event_id, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events",
    "run_groups": """WITH m AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM m) SELECT user_id, run, any_value(event_type) AS event_type, count(*)::BIGINT AS n FROM r GROUP BY 1, 2""",
    "poster_argmax": "SELECT user_id, arg_max(event_id, (length(event_type), floor(value), -event_id)) AS poster FROM events GROUP BY 1",
}

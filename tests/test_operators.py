"""Small literals for the operators' rules."""

import struct
import zlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import classify
from quern.operators import archive, candidates, diff, localization, reuse, sequence, similarity, usage


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_package_diff(spark):
    before = spark.createDataFrame([("lib/x.so", 700), ("img/p.webp", 31), ("same.bin", 5), ("gone.txt", 12)], "name string, compressed_bytes long")
    after = spark.createDataFrame([("lib/x.so", 655), ("img/p.webp", 90), ("same.bin", 5), ("new.txt", 12)], "name string, compressed_bytes long")
    changes = diff.largest_first(diff.package_diff(before, after)).collect()
    assert [c["name"] for c in changes] == ["img/p.webp", "lib/x.so", "gone.txt", "new.txt"]
    total = diff.package_totals(before, after).first()
    assert (total["added"], total["removed"], total["changed"], total["before_compressed_bytes"] - total["after_compressed_bytes"]) == (1, 1, 2, -14)


def png_header(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h) + b"\x08\x06\0\0\0"


@pytest.mark.parametrize(
    "header,expected",
    [(b"PAG\1", "pag"), (png_header(3, 4), "png"), (b"\xff\xd8\xff\xe0", "jpeg"), (b"RIFF\0\0\0\0WEBPVP8 ", "webp"), (b"GIF89a", "gif"), (b"%PDF-1.4", "pdf"), (b"\0\0\0\x18ftypmif1\0\0\0\0mif1heic", "heic"), (b"\0\0\0\x08ftypavif\0\0\0\0", None), (b"", None), (b"plain", None)],
)
def test_actual_format(spark, header, expected):
    df = spark.createDataFrame([(bytearray(header),)], "h binary")
    assert df.select(classify.actual_format(F.col("h"))).first()[0] == expected


def test_android_paths(spark):
    df = spark.createDataFrame([("app/src/main/res/drawable-ldrtl-xhdpi-v21/ic.9.png",), ("feature/res/values/strings.xml",), ("app/src/debug/assets/img/a.png",), ("app/src/main/assets",), ("res/unknown/a.png",), ("a/res/raw/deep/x.png",)], "p string")
    got = [r[0] for r in df.select(classify.android(F.col("p"))).collect()]
    assert (got[0]["module"], got[0]["source_set"], got[0]["res_type"], got[0]["density"], got[0]["rtl"], got[0]["api_level"], got[0]["name"], got[0]["nine_patch"]) == ("app", "main", "drawable", "xhdpi", True, 21, "ic", True)
    assert (got[1]["module"], got[1]["source_set"], got[1]["name"]) == ("feature", "", "strings")
    assert (got[2]["area"], got[2]["source_set"]) == ("assets", "debug")
    assert got[3:] == [None, None, None]


def test_placeholders(spark):
    pairs = [("%d files", "%ld fichiers", None), ("%d files", "%@ fichiers", "placeholder_type"), ("%s has %d", "%2$d de %1$s", None), ("%d", "rien", "placeholder_count"), ("5% bonus", "bonus 5%", None), ("100%%", "100 %%", None)]
    df = spark.createDataFrame(pairs, "a string, b string, want string")
    for r in df.withColumn("got", localization.argument_mismatch(localization.arguments(F.col("a")), localization.arguments(F.col("b")))).collect():
        assert r["got"] == r["want"], r


def test_coverage(spark):
    e = [("en", "a", "singular", "A", "translated", False, True, 1), ("en", "b", "singular", "%d B", "translated", False, True, 2), ("en", "c", "singular", "C", "translated", True, True, 3), ("fr", "a", "singular", "", "translated", False, True, 4), ("fr", "b", "singular", "%d b", "needs_review", False, True, 5), ("fr", "x", "singular", "X", "translated", False, True, 6), ("en", "n", "singular", "N", "translated", False, False, 7)]
    df = spark.createDataFrame(e, "language string, key string, value_kind string, value string, status string, stale boolean, translatable boolean, seq long")
    got = {r["language"]: r for r in localization.coverage(localization.last_wins(df), "en").collect()}
    fr = got["fr"]
    assert (fr["translated"], fr["missing"], fr["empty"], fr["needs_review"], fr["extra"], fr["issues"]) == (1, 1, 1, 1, 1, 1)
    assert got["en"]["translated"] == 3
    assert localization.stale_keys(df, "en").first()[0] == 1


def greedy(n, pairs):
    near, used, out = set(pairs), set(), {}
    for a in range(n):
        if a in used:
            continue
        mine = [b for b in range(a + 1, n) if b not in used and (a, b) in near]
        if mine:
            used |= {a, *mine}
            out |= {a: a} | {b: a for b in mine}
    return out


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=16))
def test_fixed_reference_groups(spark, raw):
    pairs = sorted({(min(p), max(p)) for p in raw if p[0] != p[1]})
    nodes = spark.createDataFrame([(i, 1) for i in range(10)], "id long, bytes long")
    links = spark.createDataFrame(pairs, "a long, b long")
    assert dict(similarity.fixed_reference_groups(nodes, links).select("id", "reference").collect()) == greedy(10, pairs)


def test_near_pairs_equal_all_pairs(spark):
    import random

    rng = random.Random(3)
    data = [(i, 1, 0, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(60)]
    got = rows(similarity.near_pairs(spark.createDataFrame(data, "id long, bytes long, part long, vector array<double>"), 0.15), "a", "b")
    want = sorted((x[0], y[0]) for x in data for y in data if x[0] < y[0] and sum(abs(p - q) for p, q in zip(x[3], y[3], strict=True)) / 6 <= 0.15)
    assert got == want and want


def test_policies():
    with pytest.raises(ValueError):
        candidates.BatchPolicy(lossless=False)
    with pytest.raises(ValueError):
        candidates.BatchPolicy(accept_warnings=("anything",))
    with pytest.raises(ValueError):
        candidates.AnalysisOptions(qualities=(80, 80))


def test_skip_dominated(spark):
    t = [(1, "heic", 75, 100, 100), (1, "heic", 85, 110, 100), (1, "heic", 95, 500, 100), (1, "heic", 100, 900, 100), (2, "heic", 85, 130, 100), (2, "heic", 100, 10, 100)]
    got = rows(candidates.skip_dominated(spark.createDataFrame(t, "resource int, format string, quality int, bytes long, limit long")), "resource", "quality", "skipped")
    assert got == [(1, 75, False), (1, 85, False), (1, 95, True), (1, 100, False), (2, 85, False), (2, 100, True)]


def test_prefix_conflicts_and_names(spark):
    e = spark.createDataFrame([("z", "A"), ("z", "a/b"), ("z", "ab"), ("y", "a/b"), ("z", "c/"), ("z", "c/d")], "archive string, name string")
    assert rows(archive.prefix_conflicts(e), "archive", "name") == [("z", "A")]


def test_min_sdk(spark):
    files = [("app/build.gradle.kts", "android {\n  minSdk = 23\n}"), ("lib/build.gradle", "minSdkVersion libs.versions.min.sdk.get()\n minSdk libs.versions.min.sdk.get()"), ("gradle/libs.versions.toml", 'min-sdk = "21" # floor\nother = "1.2"')]
    make = lambda f: spark.createDataFrame(f, "path string, text string")
    assert tuple(usage.min_sdk(make(files)).first()) == (21, "gradle/libs.versions.toml")
    assert tuple(usage.min_sdk(make(files[:1])).first()) == (23, "app/build.gradle.kts")
    assert usage.min_sdk(make([("build.gradle", "none")])).first() is None
    assert usage.min_sdk(make([("libs.versions.toml", 'minSdk = "24"')])).first()["level"] == 24


def test_sequences_and_reuse(spark):
    s = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b"), (1, 4, "b")], "k int, t int, v string")
    assert [r["carried"] for r in sequence.carry_forward(s, "k", ["t"], "v").orderBy("t").collect()] == ["a", "a", "b", "b"]
    assert [(r["run"], r["n"]) for r in sequence.runs(s, "k", ["t"], "v").orderBy("run").collect()] == [(1, 1), (2, 1), (3, 2)]
    d = spark.createDataFrame([("x", 2), ("x", 1), (None, 3), (None, 4)], "key string, id int")
    assert rows(reuse.reuse(d, "key", "id"), "id", "owner", "reused") == [(1, 1, False), (2, 1, True), (3, 3, False), (4, 4, False)]
    assert zlib.crc32(b"x")


def test_usage(spark):
    files = [("app/res/layout/a.xml", '<i a="@drawable/hero"/><i a="@+drawable/hero"/><i a="@android:drawable/hero"/><i a="@drawable/hero_dark"/>R.drawable.hero'), ("app/Main.kt", "x(R.drawable.hero, R . drawable . hero, R.mipmap.hero, xR.drawable.hero)"), ("app/Find.java", 'getIdentifier("he" + x)'), ("doc.md", "@drawable/hero getIdentifier(")]
    names = spark.createDataFrame([("drawable", "hero"), ("drawable", "none")], "type string, name string")
    got = {r["name"]: r for r in usage.usage(names, spark.createDataFrame(files, "path string, text string")).collect()}
    assert (got["hero"]["xml_references"], got["hero"]["code_references"], got["hero"]["files"], got["hero"]["dynamic_lookup_files"]) == (3, 2, ["app/Main.kt", "app/res/layout/a.xml"], 1)
    assert (got["none"]["xml_references"], got["none"]["code_references"], got["none"]["files"], got["none"]["dynamic_lookup_files"]) == (0, 0, [], 1)
    many = [(f"f{i:02}.xml", "@drawable/hero") for i in range(30)]
    assert usage.usage(names, spark.createDataFrame(many, "path string, text string")).where("name = 'hero'").first()["files"] == [f"f{i:02}.xml" for i in range(20)]


def test_identical_pairs_grow_with_copies(spark):
    e = spark.createDataFrame([(i, 10, "h", str(i)) for i in range(50)] + [(60, 10, None, "x"), (61, 10, None, "y"), (62, 10, "g", "v"), (63, 10, "g", "v")], "id long, bytes long, sha256 string, variant string")
    assert rows(similarity.identical_pairs(e), "a", "b") == [(0, i) for i in range(1, 50)]


def images(spark, changes):
    base = {"bytes": 10, "variant": "", "frames": 1, "width": 100, "height": 100, "luma": [0.5] * 4, "alpha": [1.0] * 4, "red": 50, "green": 50, "blue": 50, "detailed": True, "sha256": None}
    rows = [base | {"id": i, "variant": str(i)} | c for i, c in enumerate(changes)]
    names = ["id", "bytes", "variant", "frames", "width", "height", "luma", "alpha", "red", "green", "blue", "detailed", "sha256"]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], "id long, bytes long, variant string, frames int, width int, height int, luma array<double>, alpha array<double>, red int, green int, blue int, detailed boolean, sha256 string")


@pytest.mark.parametrize(
    "change,alike",
    [({}, True), ({"variant": "0"}, False), ({"frames": 2}, False), ({"detailed": False}, False), ({"width": 103}, True), ({"width": 104}, False), ({"red": 64}, True), ({"red": 65}, False), ({"blue": 35}, False), ({"luma": [0.5, 0.5, 0.5, 0.587]}, True), ({"luma": [0.5, 0.5, 0.5, 0.59]}, False), ({"alpha": [1.0, 1.0, 1.0, 0.885]}, True), ({"alpha": [1.0, 1.0, 1.0, 0.87]}, False)],
)
def test_alike(spark, change, alike):
    assert (similarity.similar_images(images(spark, [{}, change])).count() == 1) == alike


def test_image_groups(spark):
    e = images(spark, [{"sha256": "h", "bytes": 9}, {"sha256": "h", "bytes": 9}, {"luma": [0.52] * 4, "bytes": 8}, {"luma": [0.54] * 4, "bytes": 7}, {"luma": [0.541] * 4, "sha256": "k", "bytes": 6}, {"sha256": "k", "luma": [0.541] * 4, "bytes": 6, "detailed": False}])
    got = dict(similarity.image_groups(e).select("id", "reference").collect())
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}  # 2 is like 3 too, but belongs to 0


def test_fingerprint(spark):
    flat = [0.2, 0.4, 0.6, 1.0] * 4
    odd = [0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([(1, 2, 2, flat), (2, 2, 1, odd), (3, 0, 0, [])], "id int, width int, height int, rgba array<double>")
    got = {r["id"]: r for r in similarity.fingerprint(df, 4).collect()}
    assert set(got) == {1, 2} and got[1]["alpha"] == "" and not got[1]["detailed"] and (got[1]["red"], got[1]["green"], got[1]["blue"]) == (51, 102, 153)
    level = round((0.2126 * 0.2 + 0.7152 * 0.4 + 0.0722 * 0.6) * 255)
    assert got[1]["luma"] == f"{level:02x}" * 16
    assert got[2]["luma"] == ("8080ffff") * 4 and got[2]["alpha"] == ("0000ffff") * 4 and got[2]["detailed"]
    cells = spark.createDataFrame([("00ff80", ), ("", ), ("zz", )], "h string").select(similarity.decode_grid(F.col("h"), 3).alias("c")).collect()
    assert [r["c"] for r in cells] == [[0.0, 1.0, 128 / 255], [1.0] * 3, None]


def test_pixels(spark):
    a, b = [10, 20, 30, 255, 200, 0, 0, 0], [10, 20, 31, 255, 0, 0, 0, 0]
    df = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    assert tuple(df.select(similarity.difference_pixels(F.col("a"), F.col("b")).alias("d")).first()["d"]) == (1, 1)
    assert df.select(similarity.mean_alpha(F.col("a"))).first()[0] == 0.5
    assert df.select(similarity.alpha_from_red(F.col("a"), F.col("b"))).first()[0] == [10, 20, 30, 10, 200, 0, 0, 0]


def test_exclusion_reasons(spark):
    res = [(1, "png", False, False, "candidates_available", None, None, None, "original"), (2, "png", False, False, "candidates_available", None, None, None, "applied"), (3, "png", False, True, "candidates_available", None, None, None, "applied"), (4, "png", False, False, "failed", None, None, None, "original"), (5, "png", False, False, "candidates_available", None, "lock", None, "original")]
    resources = spark.createDataFrame([(*r, 100) for r in res], "resource int, format string, extension_mismatch boolean, missing boolean, status string, exclusion string, format_lock string, area string, state string, bytes long")
    cand = [(1, 0, "png", True, 50, 50, 90.0, 0.0, False), (1, 1, "webp", True, 40, 60, 10.0, 0.0, False), (5, 0, "png", True, 50, 50, 20.0, 0.0, False)]
    judged = candidates.verdicts(spark.createDataFrame(cand, "resource int, candidate int, format string, lossy boolean, bytes long, savings_bytes long, score double, alpha_error double, transparency_changed boolean"), candidates.AnalysisOptions(min_score=30.0))
    none = spark.createDataFrame([], "resource int")
    assert rows(candidates.exclusion_reasons(resources, judged, none, candidates.BatchPolicy()), "resource", "reasons") == [(1, "lossy"), (2, "applied"), (3, "unavailable"), (4, "unavailable"), (5, "lossy,warnings")]
    floor = candidates.BatchPolicy(lossy=True, min_score=95.0, accept_warnings=("quality_below_policy",))
    assert rows(candidates.exclusion_reasons(resources, judged, none, floor), "resource", "reasons")[0] == (1, "score")

"""Whole tasks on small folders, report and plan files, and palettes."""

import io
import json
import os
import subprocess
import zipfile

import numpy as np
import pytest
from test_readers import png

from quern import commands
from quern.operators import store
from quern.sources import media, quantize, reports, zipdir


def put(root, name, data=b"x"):
    path = os.path.join(str(root), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def package(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_scan_and_usage(spark, tmp_path):
    for name, data in (("Resources/a.png", png(np.zeros((2, 2, 4)))), ("Pods/Lib/Resources/b.png", b"\x89PNG\r\n\x1a\n"), (".idea/x.png", b""), (".build/y.png", b""), ("Main.swift", b""), ("app/src/main/res/drawable/hero.png", b"\x89PNG\r\n\x1a\n"), ("app/src/main/java/M.kt", b"R.drawable.hero"), ("app/build.gradle", b"minSdk 24")):
        put(tmp_path, name, data)
    found = [r["path"] for r in commands.scan(spark, str(tmp_path)).select("path").collect()]
    assert found == ["Pods/Lib/Resources/b.png", "Resources/a.png", "app/build.gradle", "app/src/main/res/drawable/hero.png"]
    used = commands.android_usage(spark, str(tmp_path)).collect()
    assert [(r["name"], r["code_references"], r["files"]) for r in used] == [("hero", 1, ["app/src/main/java/M.kt"])]
    assert commands.min_sdk(spark, str(tmp_path)).first()["level"] == 24


def test_from_files_to_report(spark, tmp_path):
    rng = np.random.default_rng(1)
    y, x = np.mgrid[0:64, 0:64]
    art = np.stack([x * 4, y * 4, (x + y) * 2, np.full_like(x, 255)], axis=2)
    put(tmp_path, "Resources/a.png", png(art))
    put(tmp_path, "Resources/b/a.png", png(art))  # the same file, another asset
    put(tmp_path, "Resources/c.png", png(np.clip(art + [1, 0, 1, 0], 0, 255)))
    put(tmp_path, "Resources/other.png", png(rng.integers(0, 256, (64, 64, 4)) // 2 + [0, 0, 120, 0]))
    put(tmp_path, "Resources/broken.png", b"\x89PNG\r\n\x1a\nxx")
    put(tmp_path, "Resources/tune.mp3", b"ID3")
    resources, candidates = commands.analyze(spark, str(tmp_path))
    got = {r["path"]: r for r in resources.collect()}
    assert got["Resources/broken.png"]["status"] == "failed" and got["Resources/tune.mp3"]["status"] == "unsupported"
    assert (got["Resources/a.png"]["width"], len(got["Resources/a.png"]["luma"]), got["Resources/a.png"]["alpha"]) == (64, 512, "")
    saved = {r["resource"]: r["savings_bytes"] for r in candidates.where("valid").collect()}
    assert {p for p, r in got.items() if r["status"] == "candidates_available"} == set(saved) and all(got[p]["savings"] == n for p, n in saved.items())
    counts = {r["status"]: r["n"] for r in commands.report(spark, str(tmp_path)).collect()}
    assert sum(counts.values()) == 6 and counts["failed"] == 1
    groups = {}
    for r in commands.similar_groups(spark, str(tmp_path)).collect():
        groups.setdefault(r["reference"], set()).add(r["path"])
    assert list(groups.values()) == [{"Resources/a.png", "Resources/b/a.png", "Resources/c.png"}]


def test_catalogs_by_their_own_rules(spark, tmp_path):
    one = b'{"images": [{"filename": "a.png"}, {"filename": "../x.png"}, {"filename": "gone.png"}, {"idiom": "x"}]}'
    for where in ("App/A.xcassets/s.imageset", "Pods/P.xcassets/s.imageset", "node_modules/m/N.xcassets/s.imageset", "App/B.xcassets/s.imageset", "App/C.xcassets/group/Inner.xcassets/s.imageset"):
        put(tmp_path, f"{where}/Contents.json", one)
        put(tmp_path, f"{where}/a.png")
    (tmp_path / "App/B.xcassets/link").symlink_to(tmp_path)
    found, wrong = commands.catalogs(spark, str(tmp_path))
    assert sorted(r["path"] for r in found.collect()) == ["App/A.xcassets/s.imageset/a.png", "App/C.xcassets/group/Inner.xcassets/s.imageset/a.png"]
    assert sorted((r["path"], r["problem"]) for r in wrong.collect()) == [
        ("App/A.xcassets/s.imageset/../x.png", "unsafe_rendition_filename"), ("App/A.xcassets/s.imageset/gone.png", "rendition_not_found"), ("App/B.xcassets", "symlinks_or_unreadable_entries"),
        ("App/C.xcassets/group/Inner.xcassets/s.imageset/../x.png", "unsafe_rendition_filename"), ("App/C.xcassets/group/Inner.xcassets/s.imageset/gone.png", "rendition_not_found"),
    ]


def test_ignore_rules_of_parents_and_tracked_files(spark, tmp_path):
    from quern.sources import tree

    root = tmp_path / "repo" / "sub"
    for name in ("keep.png", "skip.log", "deep/forced.tmp", "deep/other.tmp", "node_modules/m.png"):
        put(root, name)
    put(tmp_path / "repo", ".gitignore", b"*.log\n/sub/*.nothing\n")
    put(root, ".gitignore", b"*.tmp\n")
    put(root, ".ignore", b"*.png\n")  # of another tool
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "repo"), *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-f", "sub/deep/forced.tmp")
    assert tree.walk(str(root)) == [".gitignore", ".ignore", "deep/forced.tmp", "keep.png", "node_modules/m.png"]


def test_package_diff(spark, tmp_path):
    put(tmp_path, "a.zip", package([("x", b"1" * 500), ("y", b"abc")]))
    put(tmp_path, "b.zip", package([("x", bytes(range(200))), ("y", b"abc"), ("z", b"")]))
    rows = commands.package_diff(spark, str(tmp_path / "a.zip"), str(tmp_path / "b.zip")).collect()
    assert [r["name"] for r in rows] == ["x", "z"]
    put(tmp_path, "c.zip", b"none")
    with pytest.raises(ValueError):
        commands.package_diff(spark, str(tmp_path / "a.zip"), str(tmp_path / "c.zip"))


def test_archives(spark):
    good = package([("a/b.txt", b"hello"), ("c/", b"")])
    assert zipdir.inspect(good)[0][:3] == ("a/b.txt", False, 5) and zipdir.read_entry(good, "a/b.txt") == b"hello"
    broken = good.replace(good[good.index(b"a/b.txt") + 7 :][:4], b"\0\0\0\0", 1)
    end = good.rindex(b"PK\5\6")
    disks = good[: end + 4] + b"\1\0" + good[end + 6 :]
    for bad in (b"", b"PK", good + b"x", disks, package([("A", b""), ("a/b", b"")])):
        with pytest.raises(ValueError):
            zipdir.inspect(bad)
    for data, name in ((broken, "a/b.txt"), (good, "none")):
        with pytest.raises(ValueError):
            zipdir.read_entry(data, name)
    files = spark.createDataFrame([("g", bytearray(good)), ("b", bytearray(b"x"))], "path string, content binary")
    got = sorted((r["archive"], r["name"] or "", r["error"] is not None) for r in zipdir.archive_entries(files).collect())
    assert got == [("b", "", True), ("g", "a/b.txt", False), ("g", "c/", False)]


def test_report_files(spark, tmp_path):
    resources = spark.createDataFrame([(0, "a<b>.png", 10, "candidates_available"), (1, "c.png", 5, "inspected")], "index int, path string, bytes long, status string")
    candidates = spark.createDataFrame([(0, 1, "webp", "candidates/0-b.webp"), (0, 0, "png", "candidates/0-a.png")], "resource int, candidate int, format string, artifact string")
    reports.write_report(resources, candidates, "/project", str(tmp_path / "r"))
    rows, found = reports.read_report(spark, str(tmp_path / "r" / "analysis.json"))
    assert [(r["index"], r["path"]) for r in rows.orderBy("index").collect()] == [(0, "a<b>.png"), (1, "c.png")]
    assert [(r["resource"], r["candidate"], r["format"]) for r in found.orderBy("candidate").collect()] == [(0, 0, "png"), (0, 1, "webp")]
    page = (tmp_path / "r" / "report.html").read_text()
    assert "a\\u003cb\\u003e.png" in page and "a<b>" not in page
    for doc in ({"schema_version": 3, "root": "/p", "resources": []}, {"schema_version": 2, "root": "p", "resources": []}, {"schema_version": 2, "root": "/p", "resources": [{"path": "x", "candidates": [{"artifact": "other/x"}]}]}):
        put(tmp_path, "bad.json", json.dumps(doc).encode())
        with pytest.raises(ValueError):
            reports.read_report(spark, str(tmp_path / "bad.json"))
    with pytest.raises(FileExistsError):
        reports.create_file(str(tmp_path / "bad.json"), b"")


def test_plan_files(spark, tmp_path):
    row = ("p.png", "a" * 64, "b" * 64, 100, 60, "c", "d" * 64)
    plan = spark.createDataFrame([row, ("q.png", "e" * 64, "f" * 64, 100, 10, "c", "d" * 64)], "path string, original_sha256 string, optimized_sha256 string, original_bytes long, optimized_bytes long, contents_path string, contents_sha256 string")
    blobs = spark.createDataFrame([("a" * 64, bytearray(b"1")), ("a" * 64, bytearray(b"1"))], "sha256 string, content binary")
    reports.write_plan(plan, blobs, "/p", "own/1", str(tmp_path / "plan"))
    back = reports.read_plan(spark, str(tmp_path / "plan" / "plan.json"), "own/1")
    assert [r["path"] for r in back.collect()] == ["q.png", "p.png"] and spark.read.parquet(str(tmp_path / "plan" / "blobs")).count() == 1
    with pytest.raises(ValueError):
        reports.read_plan(spark, str(tmp_path / "plan" / "plan.json"), "other/1")
    events = lambda *e: spark.createDataFrame(list(e), "path string, event string")
    reports.append_journal(events(("p", "started")), str(tmp_path / "j"))
    reports.append_journal(events(("p", "completed"), ("q", "started")), str(tmp_path / "j"))
    assert sorted(tuple(r) for r in reports.read_journal(spark, str(tmp_path / "j")).collect()) == [("p", 1, 1), ("q", 1, 0)]


def test_policy_and_cache(spark, tmp_path):
    put(tmp_path, "p.toml", b'min_score = 70.0\nqualities = [60, 90]\n[batch]\nlossy = true\nformats = ["png"]\n')
    options, policy = reports.read_policy(str(tmp_path / "p.toml"))
    assert options.min_score == 70 and policy.lossy and policy.formats == ("png",)
    put(tmp_path, "bad.toml", b"nothing_known = 1\n")
    with pytest.raises(ValueError):
        reports.read_policy(str(tmp_path / "bad.toml"))
    entries = spark.createDataFrame([("aa1", 1, "r"), ("aa1", 1, "r"), ("bb2", 1, "s")], "key string, schema int, result string")
    store.cache_append(entries, str(tmp_path / "cache"))
    known = spark.read.parquet(str(tmp_path / "cache"))
    store.cache_append(spark.createDataFrame([("bb2", 1, "t"), ("cc3", 1, "u")], entries.schema), str(tmp_path / "cache"), known)
    assert sorted((r["key"], r["result"]) for r in spark.read.parquet(str(tmp_path / "cache")).collect()) == [("aa1", "r"), ("bb2", "s"), ("cc3", "u")]


def test_palettes(spark):
    rng = np.random.default_rng(0)
    few = rng.integers(0, 256, (5, 4))[rng.integers(0, 5, (9, 11))]
    assert (media.pixels(quantize.quantize(png(few), 50)) == few * 257).all()
    many = rng.integers(0, 256, (40, 40, 4))
    many[:5] = [10, 20, 30, 255]
    out = quantize.quantize(png(many), 60)
    seen = media.pixels(out) >> 8
    assert len(np.unique(seen.reshape(-1, 4), axis=0)) <= 32 and out == quantize.quantize(png(many), 60)
    assert (seen[:5, :, 3] == 255).all() and len(out) < len(png(many))
    error = np.abs(seen.astype(int) - many).mean()
    assert error < np.abs(many - many.mean((0, 1))).mean()
    files = spark.createDataFrame([("a.png", bytearray(png(many))), ("b.png", bytearray(b"no"))], "path string, content binary")
    got = {r["path"]: (r["new_bytes"], r["error"]) for r in quantize.quantized(files, 60).collect()}
    assert got["a.png"] == (len(out), None) and got["b.png"][1]
    again = {r["path"]: r["error"] for r in media.recompressed(files).collect()}
    assert again["a.png"] is None and again["b.png"]


def test_media_info(spark):
    text = json.dumps({"format": {"duration": "2.5", "bit_rate": "x"}, "streams": [{"codec_type": "audio", "codec_name": "aac"}, {"codec_type": "video", "codec_name": "h264", "width": 4, "height": 2}]})
    got = {r["path"]: r for r in reports.media_info(spark.createDataFrame([("a", text), ("b", "no")], "path string, json string")).collect()}
    assert (got["a"]["seconds"], got["a"]["bit_rate"], got["a"]["width"], got["a"]["video_codec"], got["a"]["audio_codec"], got["a"]["error"]) == (2.5, None, 4, "h264", "aac", None)
    assert got["b"]["error"] == "ffprobe_output_invalid"

"""Trees, ZIP directories and the live feed."""

import io
import os
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.sources import tree, zipdir
from quern.streaming import control, live


def put(root, name, data=b"x"):
    path = os.path.join(root, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_tree_source(spark, tmp_path):
    root = str(tmp_path)
    for name in (".hidden/a.png", "_u/b.png", "empty.bin", "sub/keep.png", "sub/skip.png", "ignored/x.png", ".build/y.png", "a.b/c", "a/c"):
        put(root, name, b"" if name == "empty.bin" else b"\x89PNG\r\n\x1a\n")
    put(root, ".gitignore", b"skip.png\nignored/\n*.tmp\n!keep.tmp\n")
    put(root, "z.tmp")
    put(root, "sub/keep.tmp")
    os.symlink(os.path.join(root, "empty.bin"), os.path.join(root, "link.bin"))
    spark.dataSource.register(tree.TreeSource)
    got = {r["path"]: r for r in spark.read.format("quern_tree").load(root).collect()}
    assert sorted(got) == sorted([".gitignore", ".hidden/a.png", "_u/b.png", "a/c", "a.b/c", "empty.bin", "sub/keep.png", "sub/keep.tmp"])
    assert got["empty.bin"]["bytes"] == 0 and bytes(got["a/c"]["header"]).startswith(b"\x89PNG")
    assert "ignored/x.png" in tree.walk(root, include_ignored=True) and ".build/y.png" not in tree.walk(root, include_ignored=True)
    order = tree.walk(root)
    assert order.index("a/c") < order.index("a.b/c")


def test_tree_is_walked_by_the_tasks(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    for i in range(120):
        put(root, f"d{i % 12}/e{i % 5}/f{i}.{'png' if i % 2 else 'txt'}")
    put(root, ".gitignore", b"d3/\n")
    put(root, "d4/.gitignore", b"*.txt\n")
    put(root, "d5/e0/deep/er/x.png")
    os.symlink(root, os.path.join(root, "d6", "loop"))
    spark.dataSource.register(tree.TreeSource)
    for splits in (1, 7, 40, 500):
        df = spark.read.format("quern_tree").option("splits", splits).load(root)
        assert sorted((r["path"] for r in df.collect()), key=lambda p: p.split("/")) == tree.walk(root)
        assert df.rdd.getNumPartitions() <= max(splits, 1)
    units = tree.Tree(root).units(40)
    assert not any(u[0].endswith((".png", ".txt")) for u in units) and len({u[0] for u in units}) == len(units)
    linked = spark.read.format("quern_tree").option("links", "true").load(root)
    assert [(r["path"], r["entry"]) for r in linked.where("entry <> 'file'").collect()] == [("d6/loop", "symlink")]
    reader = tree._FilteringReader({"path": root})
    left = list(reader.pushFilters([tree.StringStartsWith(("path",), "d5/e0/"), tree.StringEndsWith(("path",), ".png"), tree.EqualTo(("bytes",), 3)]))
    assert len(left) == 1
    parts = reader.partitions()
    assert {u[0].split("/")[0] for p in parts for u in p.units} <= {"", "d5"}
    got = sorted(r[0] for p in parts for r in reader.read(p))
    assert got == sorted(p for p in tree.walk(root) if p.startswith("d5/e0/") and p.endswith(".png")) and got


def test_pushed_filters_give_the_same_rows(spark, tmp_path):
    for i in range(20):
        put(str(tmp_path), f"d{i % 4}/f{i}.png")
    spark.dataSource.register(tree.TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = spark.read.format("quern_tree").option("push_filters", "true").load(str(tmp_path))
        assert df.where("path like 'd1/%' and path like '%5.png'").count() == 1 and df.where("path in ('d0/f4.png', 'no')").count() == 1
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def package(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_zip_directory(spark):
    good = package([("a.txt", b"aa"), ("d/b.txt", b"bbb")])
    assert zipdir.central_directory(good) == {"a.txt": 2, "d/b.txt": 3}
    for bad in (b"", b"text", good[:-30], b"PK\x05\x06" + b"\xff" * 18):
        with pytest.raises(ValueError):
            zipdir.central_directory(bad)
    files = spark.createDataFrame([("p.zip", bytearray(good)), ("q.zip", bytearray(b"no"))], "path string, content binary")
    got = sorted((r["package"], r["name"] or "", r["compressed_bytes"] or 0, r["error"] is not None) for r in zipdir.package_entries(files).collect())
    assert got == [("p.zip", "a.txt", 2, False), ("p.zip", "d/b.txt", 3, False), ("q.zip", "", 0, True)]


@pytest.mark.parametrize("names", [["../x"], ["a", "A"], ["a", "a/b"], ["c:x"]])
def test_unsafe_archives(names):
    with pytest.raises(ValueError):
        zipdir.inspect(package([(n, b"x") for n in names]))


def test_feed(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(f"f{i}",) for i in range(k, k + 2)], "path string").coalesce(1).write.mode("append").parquet(src)
        live.feed(spark, src, "path string", sink, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(sink).count() == 4


def test_presence_tells_changes_only(spark, tmp_path):
    src, told, schema = str(tmp_path / "in"), [], "path string, seq long, present boolean"
    scans = [[("a", 1, True), ("b", 1, True), ("c", 1, False), (None, 1, True)], [("a", 2, True), ("b", 2, False), ("c", 3, True), ("c", 2, False)], [("b", 1, True), ("a", 4, True), ("c", 4, None)]]
    for rows in scans:  # each run starts anew from its checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        live.presence(spark, src, schema, str(tmp_path / "c"), lambda df, n: told.append(sorted((r["path"], r["present"]) for r in df.collect()))).awaitTermination()
    assert [t for t in told if t] == [[("a", True), ("b", True)], [("b", False), ("c", True)], [("c", False)]]


def test_progress_of_a_stream(spark, tmp_path):
    src, seen, schema = str(tmp_path / "in"), {}, "batch int, outcome string, savings_bytes long"
    plans = spark.createDataFrame([(1, 3), (2, 2)], "batch int, total int")
    for rows in ([(1, "applied", 5), (2, "failed", 0)], [(1, "failed", 0), (1, "applied", 7), (2, "cancelled", 0)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        out = live.batch_progress(spark.readStream.schema(schema).parquet(src), plans)
        out.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.update({r["batch"]: r.asDict() for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert seen[1] == {"batch": 1, "total": 3, "done": 3, "applied": 2, "failed": 1, "cancelled": False, "savings_bytes": 12, "running": False}
    assert (seen[2]["cancelled"], seen[2]["running"], seen[2]["savings_bytes"]) == (True, False, 0)


def test_cancelled_run_gives_every_resource_one_row(spark, tmp_path):
    resources = spark.createDataFrame([(f"p{i}",) for i in range(200)], "path string").repartition(2)
    run = control.Run(spark)
    steps = []

    def analyse(part):
        steps.append(1)
        if len(steps) < 3:
            return part.withColumn("status", F.lit("done"))
        threading.Timer(1.5, run.cancel).start()

        def slow(batches):
            for b in batches:
                time.sleep(90)
                yield b

        return part.mapInPandas(slow, "path string").withColumn("status", F.lit("late"))

    start = time.time()
    got = run.run(resources, analyse, str(tmp_path / "out"), slices=5).collect()
    assert time.time() - start < 80 and run.cancelled and len(steps) == 3
    assert sorted(r["path"] for r in got) == sorted(f"p{i}" for i in range(200))
    assert {r["status"] for r in got} == {"done", "not_analyzed"}
    whole = control.Run(spark).run(resources, lambda part: part.withColumn("status", F.lit("done")), str(tmp_path / "all"), slices=3)
    assert whole.count() == 200 and whole.where("status <> 'done'").count() == 0

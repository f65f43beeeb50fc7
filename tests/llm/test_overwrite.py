"""The file layout against a plain walk over the rows, at the start and after late rows."""

import datetime as dt
import glob
import hashlib
import math
import os
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.llm import overwrite, queries

DAY = 86_400_000_000
EPOCH = dt.datetime(1970, 1, 1)
NAMES = ["sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority"]


def us(x):
    return None if x is None else (x - EPOCH) // dt.timedelta(microseconds=1)


def first(x):
    return (x is not None, x if x is not None else 0)


def kept(rows):
    """The latest-arrived row of each sale."""
    out = {}
    for r in rows:
        if r[0] not in out or first(us(r[5])) > first(us(out[r[0]][5])):
            out[r[0]] = r
    return out


def layout(rows, size):
    """(day, file_no) -> rows."""
    days = {}
    for r in kept(rows).values():
        days.setdefault(-1 if r[4] is None else us(r[4]) // DAY, []).append(r)
    out = {}
    for day, own in days.items():
        own.sort(key=lambda r: (first(us(r[4])), first(r[0])))
        out.update({(day, k // size): own[k : k + size] for k in range(0, len(own), size)})
    return out


def brute(rows, cutoff, size):
    """What describe() has to say, less the paths."""
    early = [r for r in rows if r[5] is not None and us(r[5]) < cutoff]
    begin, last = kept(early), kept(rows)
    moved = [s for s, r in last.items() if r[5] is None or us(r[5]) >= cutoff]
    day = lambda r: -1 if r[4] is None else us(r[4]) // DAY
    touched = {day(last[s]) for s in moved} | {day(begin[s]) for s in moved if s in begin}
    text = lambda x: "" if x is None else str(x)
    return {
        (d, f): (
            len(own), sum(0 if r[3] is None or math.isnan(r[3]) else math.floor(100 * r[3] + 0.5) for r in own),
            sum(zlib.crc32(f"{text(r[0])}:{text(us(r[4]))}:{text(us(r[5]))}".encode()) for r in own),
            hashlib.sha256(",".join(text(r[0]) for r in own).encode()).hexdigest(), d in touched,
        )
        for (d, f), own in layout(rows, size).items()
    }


def seen(described):
    return {(r["day"], r["file_no"]): (r["n_rows"], r["cents"], r["rows_crc"], r["ids_sha256"], r["rewritten"]) for r in described}


def files(folder):
    return {f: (hashlib.sha256(open(f, "rb").read()).hexdigest(), pq.read_table(f, partitioning=None)) for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def sale(i, sold, arrived, total=1.5):
    at = lambda h: None if h is None else dt.datetime(2024, 3, 1) + dt.timedelta(hours=h)
    return (i, i and i % 7, "done", total, at(sold), at(arrived), 3)


SCHEMA = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_odd_rows(spark, tmp_path, kind):
    rows = [sale(i, i % 90, i % 90 + 1) for i in range(400)]
    rows += [sale(5, 30, 500, 2.5), sale(6, None, 500), sale(7, 7, 500, None), sale(8, 8, None, 9.0)]  # moved to another day, to none, within a day, before all
    rows += [sale(900, 700, 600, float("nan")), sale(901, None, 2, None), sale(902, 3, None), sale(None, 50, 3), sale(None, 51, 700)]
    rows += [sale(903, 2000, 4), sale(903, 1, 800)]  # the only sale of its day leaves it
    rows += [(904, 1, "old", 4.0, dt.datetime(1969, 12, 30, 23), dt.datetime(2024, 3, 2), 1), (905, 1, "old", 4.0, dt.datetime(1969, 12, 31, 23, 59, 59, 999999), dt.datetime(2024, 3, 2), 1)]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    df = df.select(*[F.col(c).cast(kind).alias(c) if c.endswith("_at") else F.col(c) for c in NAMES])
    cutoff = us(dt.datetime(2024, 3, 1) + dt.timedelta(hours=200))
    folder = f"file://{tmp_path}/out"
    early = df.where((F.col("arrived_at") < F.lit("2024-03-09 08:00:00").cast(kind)))
    overwrite.overwrite_late(early, cutoff, 9, f"file://{tmp_path}/early")
    done = overwrite.overwrite_late(df, cutoff, 9, folder)
    got = overwrite.describe(spark, folder, df, done["start"]).collect()
    assert seen(got) == brute(rows, cutoff, 9)
    assert {us(dt.datetime(2024, 3, 1) + dt.timedelta(hours=2000)) // DAY} == set(done["removed"])
    held = files(f"{tmp_path}/out")
    assert {"file://" + f for f in held} == {r["path"] for r in got}
    for f, (_, t) in held.items():
        assert t.column_names == NAMES, f
    # Untouched days hold the very bytes that a layout of the early rows alone has.
    alone = {f.split("/early/")[1].split("/")[0]: set() for f in files(f"{tmp_path}/early")}
    for f, (h, _) in files(f"{tmp_path}/early").items():
        alone[f.split("/early/")[1].split("/")[0]].add(h)
    kept_days = {f"day={r['day']}" for r in got if not r["rewritten"]}
    assert kept_days and all({h for f, (h, _) in held.items() if f"/{d}/" in f} == alone[d] for d in kept_days)


def test_files_that_stay_are_the_starting_files(spark, tmp_path, monkeypatch):
    rows = [sale(i, i % 90, i % 90 + 1) for i in range(300)] + [sale(5, 30, 500, 2.5)]
    df = spark.createDataFrame(rows, SCHEMA)
    between = {}
    write = overwrite.write

    def watched(*args):
        out = write(*args)
        between.setdefault("start", {f: h for f, (h, _) in files(f"{tmp_path}/x").items()})
        return out

    monkeypatch.setattr(overwrite, "write", watched)
    done = overwrite.overwrite_late(df, us(dt.datetime(2024, 3, 9)), 10, f"file://{tmp_path}/x")
    got = overwrite.describe(spark, f"file://{tmp_path}/x", df, done["start"]).collect()
    held = files(f"{tmp_path}/x")
    for r in got:
        f = r["path"].removeprefix("file://")
        assert r["rewritten"] == (between["start"].get(f) != held[f][0])
    assert {r["rewritten"] for r in got} == {True, False}


def test_nothing_and_nothing_early(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    done = overwrite.overwrite_late(none, 0, 5, f"file://{tmp_path}/none")
    assert overwrite.describe(spark, f"file://{tmp_path}/none", none, done["start"]).count() == 0
    rows = [sale(i, i, i) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    done = overwrite.overwrite_late(df, 0, 5, f"file://{tmp_path}/late")
    assert done["start"] is None
    assert seen(overwrite.describe(spark, f"file://{tmp_path}/late", df, None).collect()) == brute(rows, 0, 5)


def test_column_named_day(spark, tmp_path):
    df = spark.createDataFrame([(*sale(i, i, i), "x") for i in range(20)], SCHEMA + ", day string")
    done = overwrite.overwrite_late(df, 1 << 60, 5, f"file://{tmp_path}/day")
    got = overwrite.describe(spark, f"file://{tmp_path}/day", df, done["start"]).collect()
    assert sum(r["n_rows"] for r in got) == 20 and {r["columns"] for r in got} == {",".join([*NAMES, "day"])}


def test_a_key_of_most_rows_is_folded_before_the_shuffle():
    rows = [(1 if i % 3 else i, i, 0, i) for i in range(30_000)]
    sent = list(overwrite._before_shuffle(20_000)(iter(rows)))
    assert sum(k[0] == 1 for k, _ in sent) == 2 and len(sent) <= 10_002
    assert list(overwrite._fold(iter(sorted(sent)), 20_000))[:2] == [(0, 3), (19_999, 1)]


def test_query_on_all_sales(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("needs the driver's tables")
    sales = [tuple(r) for r in spark.read.parquet(f"{data}/sales.parquet").select(*NAMES).collect()]
    rows = list(sales)
    for r in sales:
        h = zlib.crc32(str(r[0]).encode())
        if r[0] is not None and h % 3 == 0 and r[4] is not None and us(r[4]) // DAY % 4 == 0:
            rows.append((*r[:3], None if r[3] is None else r[3] + 1, r[4] + dt.timedelta(days=h % 2), r[5] + dt.timedelta(days=1 + h % 97), r[6]))
    got = queries.op13_late_overwrite(spark, data)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("day", "bigint"), ("file_no", "bigint"), ("n_rows", "bigint"), ("cents", "bigint"), ("rows_crc", "bigint"), ("path", "string"), ("columns", "string"), ("ids_sha256", "string"), ("rewritten", "boolean")]
    got = got.collect()
    assert seen(got) == brute(rows, queries.OP13_CUTOFF, 1 + len(sales) // 1100)
    assert {r["columns"] for r in got} == {",".join(NAMES)}

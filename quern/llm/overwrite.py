"""Late-arrival partition overwrite: a daily file layout of each key's latest row, brought up to date in place.

Rows are sorted by (key, arrival) and each key's run is folded in one streaming pass to its early and its late winner.
The winners of a layout are sorted again by (day, event time, key), dealt so that no file is shared by two tasks, and
written as they come. Days that late rows touch are overwritten as whole partitions; the files of others are left alone.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import ready, save, scratch

#: Stands for a null number: before every other.
NULL = -(1 << 63)
DAY = 86_400_000_000
#: Keys that a task folds before it sends its rows on; a key of very many rows sends two for each such load.
FOLDED = 50_000
#: Rows of about so many files' tasks at least, once there are more files than shuffle partitions.
TASK_ROWS = 200_000
TIMES = ("timestamp", "timestamp_ntz")
#: Names of the writer's files: task, mark of the run, number within the task's partition.
NAME = r"part-(\d+)-([0-9a-f-]+)\.c(\d+)\..*parquet"


@dataclass(frozen=True)
class Layout:
    key: str = "sale_id"
    event: str = "sold_at"
    arrival: str = "arrived_at"


def micros(df: DataFrame, name: str) -> Column:
    """A timestamp's microseconds since 1970, in UTC; one without a zone is taken as UTC whatever the session's zone."""
    own = F.col(name)
    if df.schema[name].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(own.cast("timestamp"))
    seconds = F.unix_date(own.cast("date")).cast("long") * 86_400 + F.hour(own) * 3600 + F.minute(own) * 60
    return seconds * 1_000_000 + (F.expr(f"extract(SECOND FROM `{name}`)") * 1_000_000).cast("long")


def _moment(us: Column, kind: str) -> Column:
    """The timestamp of so many microseconds, of a given type."""
    if kind != "timestamp_ntz":
        return F.timestamp_micros(us)
    whole = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    return whole + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us.cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))


def day_of(us: Column) -> Column:
    """Whole days since 1970, rounded down; -1 for null."""
    return F.coalesce(((us - F.pmod(us, F.lit(DAY))) / DAY).cast("long"), F.lit(-1))


def _fold(rows: Iterable[tuple], cutoff: int) -> Iterator[tuple]:
    """Rows of one key after another, each key's by arrival -> the rows that stand in the early layout (flag 1), in the whole one (2) or both (3)."""
    now: int | None = None
    early = last = None
    for (key, arrival, _), row in rows:
        if last is not None and key != now:
            yield from _flagged(early, last)
            early = None
        now, last = key, row
        if NULL < arrival < cutoff:
            early = row
    if last is not None:
        yield from _flagged(early, last)


def _flagged(early: tuple | None, last: tuple) -> Iterator[tuple]:
    if early is last:
        yield (*last, 3)
    else:
        if early is not None:
            yield (*early, 1)
        yield (*last, 2)


def _before_shuffle(cutoff: int):
    """Of each load of keys, the latest early row and the latest row of each: all that the fold needs of it."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: dict[int, list] = {}

        def out() -> Iterator[tuple]:
            for key, (early, last) in held.items():
                if early is not None and early is not last:
                    yield (key, *early[0]), early[1]
                yield (key, *last[0]), last[1]

        for key, arrival, tie, *row in rows:
            found = held.get(key)
            if found is None:
                if len(held) >= FOLDED:
                    yield from out()
                    held.clear()
                found = held[key] = [None, None]
            entry = ((arrival, tie), tuple(row))
            if found[1] is None or entry[0] >= found[1][0]:
                found[1] = entry
            if NULL < arrival < cutoff and (found[0] is None or entry[0] >= found[0][0]):
                found[0] = entry
        yield from out()

    return run


def winners(rows: DataFrame, cutoff: int, p: Layout) -> DataFrame:
    """rows -> the rows of both layouts, saved, with day, event_us, key_no and stands (1: early layout, 2: whole, 3: both).

    A key's latest row has the latest arrival; a null arrival is before all others and not early; of rows that arrived
    together one is chosen by a hash of the row, the same at every run. All rows without a key have one key.
    """
    spark, names = rows.sparkSession, rows.columns
    kinds = {f.name: f.dataType.typeName() for f in rows.schema}
    times = [n for n in names if kinds[n] in TIMES]
    plain = [(micros(rows, n) if n in times else F.col(n)).alias(f"c{i}") for i, n in enumerate(names)]
    keyed = rows.select(F.coalesce(F.col(p.key).cast("long"), F.lit(NULL)), F.coalesce(micros(rows, p.arrival), F.lit(NULL)), F.xxhash64(*names), *plain)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.rdd.mapPartitions(_before_shuffle(cutoff)).repartitionAndSortWithinPartitions(parts, lambda k: (k[0] * 0x9E3779B97F4A7C15 >> 32) & 0x7FFFFFFF)
    folded = dealt.mapPartitions(lambda it: _fold(it, cutoff))
    schema = ", ".join(f"c{i} {'long' if n in times else rows.schema[n].dataType.simpleString()}" for i, n in enumerate(names)) + ", stands int"
    out = spark.createDataFrame(folded, schema, verifySchema=False)
    event = F.col(f"c{names.index(p.event)}")
    return save(out.select("*", day_of(event).alias("day"), F.coalesce(event, F.lit(NULL)).alias("event_us"), F.coalesce(F.col(f"c{names.index(p.key)}").cast("long"), F.lit(NULL)).alias("key_no")), "winners")


def first_keys(found: DataFrame, size: int) -> list[tuple[int, int, int]]:
    """The (day, event_us, key_no) with which each file begins, in order: as many as there are files.

    Only the keys are sorted, in ranges of about equal size; a row's rank within its day is its rank in its range plus the
    rows of the day in earlier ranges, of which there is one count for each range and day.
    """
    keys = ["day", "event_us", "key_no"]
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = save(found.select(*keys).repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), "keys")
    counts = save(ranged.groupBy("part", "day").count(), "counts")
    before = F.coalesce(F.sum("count").over(Window.partitionBy("day").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranged.withColumn("within", F.row_number().over(Window.partitionBy("part", "day").orderBy("event_us", "key_no")) - 1)
    begins = ranked.join(F.broadcast(counts.select("part", "day", before.alias("before"))), ["part", "day"])  # ranges and days
    return sorted(tuple(r) for r in begins.where((F.col("within") + F.col("before")) % size == 0).select(*keys).collect())


def write(found: DataFrame, like: DataFrame, size: int, folder: str, p: Layout) -> list[int]:
    """Overwrite the days of these rows of winners() in the layout; the days, ascending.

    A task gets whole files of one or several days in order, so a day of any size is spread over as many tasks as it has
    files, and a file is written by one task as its rows come. Files hold the columns of `like`. The writer replaces a day's
    partition when all tasks are done, so a lost executor leaves nothing half written.
    """
    begins = first_keys(found, size)
    if not begins:
        return []
    spark, names = found.sparkSession, like.columns
    files = len(begins)
    tasks = min(files, max(int(spark.conf.get("spark.sql.shuffle.partitions")), files * size // TASK_ROWS))
    dealt = found.rdd.map(lambda r: ((r["day"], r["event_us"], r["key_no"]), tuple(r[: len(names)])))
    ordered = dealt.repartitionAndSortWithinPartitions(tasks, lambda k: (bisect_right(begins, k) - 1) * tasks // files)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields[: len(names)]) + ", day long"
    rows = spark.createDataFrame(ordered.map(lambda r: (*r[1], r[0][0])), schema, verifySchema=False)
    kinds = {f.name: f.dataType.typeName() for f in like.schema}
    back = [(_moment(F.col(f"c{i}"), kinds[n]) if kinds[n] in TIMES else F.col(f"c{i}")).alias(n) for i, n in enumerate(names)]
    out = rows.select(*back, F.col("day").alias(_day_column(names)))
    out = out.sortWithinPartitions(_day_column(names), p.event, p.key)  # they come in this order: it tells the writer so
    out.write.partitionBy(_day_column(names)).option("maxRecordsPerFile", size).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(folder)
    return sorted({k[0] for k in begins})


def _day_column(names: list[str]) -> str:
    name = "day"
    while name in names:
        name += "_"
    return name


def overwrite_late(rows: DataFrame, cutoff: int, size: int, folder: str, p: Layout | None = None) -> dict:
    """Write the layout of the rows that arrived before cutoff (microseconds) into folder, then make it that of all rows.

    A layout keeps each key's latest row, as winners() says, and cuts each day (of the event's time in UTC; -1 for null),
    sorted by event and key, nulls first, into files of `size` rows, the last perhaps fewer. Days where a kept late row
    stands, or where its key stood at the start, are written anew or removed; other files stay as they are. folder is new or empty and
    in storage that all executors share. Whole numbers serve as keys. Empty input writes nothing. Returns the days written
    anew and those removed, and the start's mark in its files' names (None if nothing was early).
    """
    p = p or Layout()
    ready(rows.sparkSession)
    with scratch():
        found = winners(rows, cutoff, p)
        write(found.where(F.col("stands").bitwiseAND(1) != 0), rows, size, folder, p)
        start = _mark(rows.sparkSession, folder)
        touched = [r["day"] for r in found.where("stands <> 3").select("day").distinct().collect()]  # calendar days
        now = write(found.where((F.col("stands").bitwiseAND(2) != 0) & F.col("day").isin(touched)), rows, size, folder, p) if touched else []
        gone = sorted(set(touched) - set(now))
        for day in gone:
            _remove(rows.sparkSession, f"{folder}/{_day_column(rows.columns)}={day}")
    return {"rewritten": now, "removed": gone, "start": start}


def _path(spark: SparkSession, where: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, where: str) -> None:
    path, fs = _path(spark, where)
    fs.delete(path, True)


def _mark(spark: SparkSession, folder: str) -> str | None:
    """What the writer puts into the names of one run's files, from the first file found."""
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        return None
    found = fs.listFiles(path, True)
    while found.hasNext():
        if named := re.fullmatch(NAME, found.next().getPath().getName()):
            return named[2]
    return None


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one file after another, in order -> a row a file; only the running sums are held."""
    now, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": now, "n_rows": state[0], "cents": state[1], "rows_crc": state[2], "ids_sha256": state[3].hexdigest()}], schema=pa.schema([("file", pa.int64()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("ids_sha256", pa.string())]))

    for batch in batches:
        ends = pc.run_end_encode(batch.column("file"))
        start = 0
        for end, file in zip(ends.run_ends.to_pylist(), ends.values.to_pylist(), strict=True):
            part = batch.slice(start, end - start)
            start = end
            if file != now or state is None:
                if state is not None:
                    yield row()
                now, state = file, [0, 0, 0, hashlib.sha256()]
            ids = ",".join(part.column("id").to_pylist())
            state[3].update(("," * bool(state[0]) + ids).encode())
            state[0] += len(part)
            state[1] += pc.sum(part.column("cents")).as_py()
            state[2] += pc.sum(part.column("crc")).as_py()
    if state is not None:
        yield row()


def describe(spark: SparkSession, folder: str, like: DataFrame, start: str | None, amount: str = "total", p: Layout | None = None) -> DataFrame:
    """A row for each file of a layout, read back: day, file_no, n_rows, cents, rows_crc, path, columns, ids_sha256, rewritten.

    cents sums floor(100 * amount + 0.5), amounts that are null or no number being 0; rows_crc sums the crc32 of
    `key:event:arrival` with times in microseconds and null empty. rewritten is false for files of the run marked `start`.
    A file's rows are brought together by the hash of its path, in order, and streamed through one task.
    """
    p = p or Layout()
    files = "day long, file_no long, n_rows long, cents long, rows_crc long, path string, columns string, ids_sha256 string, rewritten boolean"
    if not _mark(spark, folder):
        return spark.createDataFrame([], files)
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in like.schema)}, `{_day_column(like.columns)}` long").parquet(folder)
    path = F.col("_metadata.file_path")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    crc = F.crc32(F.concat_ws(":", text(F.col(p.key)), text(micros(like, p.event)), text(micros(like, p.arrival))))
    cents = F.coalesce(F.expr(f"try_cast(floor(100 * `{amount}` + 0.5D) AS bigint)"), F.lit(0))
    own = rows.select(F.xxhash64(path).alias("file"), F.col("_metadata.row_index").alias("at"), text(F.col(p.key)).alias("id"), cents.alias("cents"), crc.alias("crc"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = own.repartition(parts, "file").sortWithinPartitions("file", "at").mapInArrow(_digests, "file long, n_rows long, cents long, rows_crc long, ids_sha256 string")
    named = rows.select(path.alias("path")).distinct()
    part = lambda i: F.regexp_extract("path", rf"{_day_column(like.columns)}=(-?\d+)/{NAME}$", i)
    named = named.select(F.xxhash64("path").alias("file"), "path", part(1).cast("long").alias("day"), part(2).cast("long").alias("task"), part(3).alias("run"), part(4).cast("long").alias("cut"))
    number = F.row_number().over(Window.partitionBy("day").orderBy("task", "cut")) - 1
    named = named.select("file", "path", "day", number.cast("long").alias("file_no"), (F.col("run") != F.lit(start or "")).alias("rewritten"))
    columns = F.lit(",".join(c for c in spark.read.parquet(folder).columns if c != _day_column(like.columns))).alias("columns")
    return sums.join(named, "file").select("day", "file_no", "n_rows", "cents", "rows_crc", F.regexp_replace("path", "^file:/+", "file:///").alias("path"), columns, "ids_sha256", "rewritten")


def with_copies(sales: DataFrame) -> DataFrame:
    """sales and, for a third of the sales of every fourth day, a copy that arrived late: total + 1, sold up to a day later."""
    h = F.crc32(F.col("sale_id").cast("string"))
    again = sales.where((h % 3 == 0) & (day_of(micros(sales, "sold_at")) % 4 == 0))
    days = lambda n: F.make_dt_interval(n.cast("int"))
    new = {"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(h % 2), "arrived_at": F.col("arrived_at") + days(h % 97 + 1)}
    return sales.unionByName(again.select(*[new[c].alias(c) if c in new else F.col(c) for c in sales.columns]))

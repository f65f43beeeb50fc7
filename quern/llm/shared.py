"""Shared storage, bounded Arrow batches and size-checked broadcasts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join may be broadcast up to this many rows of a few integers each (some ten MB); beyond it the join shuffles.
BROADCAST_ROWS = 300_000
#: The same for tables of a single 64-bit key, with a number or two beside it.
BROADCAST_KEYS = 1_000_000


def ready(spark: SparkSession) -> SparkSession:
    """Keep Arrow batches small, so that a Python worker holds a few MB of text at a time, and remove a query's shuffle files at its end."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Only a local session, whose executors share the driver's disk, may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables saved since a scratch() began, removed at its end but for those kept, which pass to the scratch around it."""

    def __init__(self):
        self.made: list[tuple[SparkSession, str]] = []
        self.kept: list[str | None] = []

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(_place(df))
        return df


#: The scratches that are open, in this thread or task: two queries at a time don't see each other's.
_open: ContextVar[tuple[Scratch, ...]] = ContextVar("open", default=())


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Removes what save() writes inside it, but for tables given to keep(). Nothing that reads them lazily may outlive it."""
    here, around = Scratch(), _open.get()
    token = _open.set((*around, here))
    try:
        yield here
    finally:
        _open.reset(token)
        for spark, place in here.made:
            if place in here.kept and around:
                around[-1].made.append((spark, place))
            elif place not in here.kept:
                _delete(spark, place)


def scratched(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """run, whose result is saved, and whose other tables are removed."""

    @wraps(run)
    def whole(*args, **named) -> DataFrame:
        with scratch() as made:
            return made.keep(save(run(*args, **named), "result"))

    return whole


def _place(df: DataFrame) -> str | None:
    """The folder of a table made by save(), which marks what it gives back."""
    return df.__dict__.get("_quern_place")


def _delete(spark: SparkSession, name: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def save(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back. Lost executors don't lose it."""
    spark = df.sparkSession
    place = f"quern-{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{place}"
    df.write.option("parquet.enable.dictionary", "false").option("compression", "zstd").parquet(path)  # mostly hashes and whole texts
    if around := _open.get():
        around[-1].made.append((spark, place))
    saved = spark.read.schema(df.schema).parquet(path)
    saved._quern_place = place
    return saved


def forget(df: DataFrame) -> None:
    """Remove a table made by save() that no later read needs."""
    if place := _place(df):
        _delete(df.sparkSession, place)


def _give_back() -> None:
    """Return freed memory to the system, as a worker that made a model goes on to other tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def in_one_task(rows: DataFrame, run: Callable[[pa.Table], bytes]) -> bytes:
    """run over all rows of a table whose size is bounded, in one executor task. The driver gets the resulting bytes only; a lost task is run again."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            done = run(pa.Table.from_batches(held))
            held.clear()
            _give_back()
            yield pa.RecordBatch.from_arrays([pa.array([done], pa.binary())], names=["made"])

    made = rows.repartition(1).mapInArrow(task, "made binary").collect()
    return bytes(made[0]["made"]) if made else run(rows.limit(0).toArrow())


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are within the bound, else df as it is."""
    return F.broadcast(df) if rows <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

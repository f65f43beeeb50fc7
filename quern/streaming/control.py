"""Runs that can be stopped half way and still leave a whole table."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.inventory import mark_cancelled


class Run:
    """An analysis in slices, each a job under one tag. cancel() may be called from any thread.

    A slice's rows are committed together, so a slice that was stopped leaves none of them. The table is then closed: each
    resource without a row gets one with the status `not_analyzed`.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.tag = spark, f"quern-run-{uuid.uuid4().hex}"
        self._stop = threading.Event()

    def cancel(self) -> None:
        """Start no further slice, and stop the jobs of the one that runs."""
        self._stop.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    @property
    def cancelled(self) -> bool:
        return self._stop.is_set()

    def run(self, resources: DataFrame, analyse: Callable[[DataFrame], DataFrame], folder: str, slices: int = 16) -> DataFrame:
        """analyse(resources of a slice) -> rows (path, status, ...), appended to folder slice by slice; the closed table.

        resources have distinct paths and are dealt to slices by a hash of them. folder is new, in storage that all executors share.
        """
        rows = None
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            for k in range(slices):
                if self.cancelled:
                    break
                part = analyse(resources.where(F.pmod(F.xxhash64("path"), F.lit(slices)) == k))
                rows = part.schema
                try:
                    part.write.mode("append").parquet(folder)
                except Exception:
                    if not self.cancelled:
                        raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
        if rows is None:
            rows = analyse(resources.limit(0)).schema
        there = self._there(folder)
        done = self.spark.read.schema(rows).parquet(folder) if there else self.spark.createDataFrame([], rows)
        if self.cancelled:
            left = mark_cancelled(done, resources).where("status = 'not_analyzed'").select(*rows.names)
            left.write.mode("append").parquet(folder)
        return self.spark.read.schema(rows).parquet(folder) if there or self.cancelled else done

    def _there(self, folder: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.exists(path) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(path))

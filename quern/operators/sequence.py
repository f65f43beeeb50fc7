"""Frame sequences: carried values, runs and the poster frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds carried: the last non-null value of the key up to this row."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("carried", F.last(value, ignorenulls=True).over(w))


def runs(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """(key, run, value, n): consecutive rows of equal value, runs from 1."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("new", (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.row_number().over(w).eqNullSafe(1)).cast("int"))
    marked = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run").agg(F.first(value).alias(value), F.count("*").alias("n"))


def poster(frames: DataFrame, key: str, frame: str, sprites: str, ink: str) -> DataFrame:
    """(key, poster): the earliest of the frames with most sprites, then most ink."""
    return frames.groupBy(key).agg(F.max_by(frame, F.struct(F.col(sprites), F.col(ink), -F.col(frame))).alias("poster"))

"""Reuse by content and policy, cache pruning, and duplicate rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*[p.alias(f"p{i}") for i, p in enumerate(parts)])), 256)


def reuse(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Adds owner (the first row's `order` value among equal keys) and reused. A null key is never shared."""
    owner = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("owner"))
    out = rows.join(owner, key, "left").withColumn("owner", F.coalesce("owner", order))
    return out.withColumn("reused", F.col("owner") != F.col(order))


def prune(entries: DataFrame, cap: int, day: str = "day") -> DataFrame:
    """entries (mtime, bytes, path, day) -> those kept: the newest whose bytes sum up to at most cap.

    Oldest go first, ties by fewer bytes, then path, ascending. Sums run within a day over a table of one sum for each day,
    so no single task sorts all entries.
    """
    days = entries.groupBy(day).agg(F.sum("bytes").alias("b"))
    newer = days.withColumn("newer", F.coalesce(F.sum("b").over(Window.orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(day, "newer")
    within = F.sum("bytes").over(Window.partitionBy(day).orderBy(F.desc("mtime"), F.desc("bytes"), F.desc("path")).rowsBetween(Window.unboundedPreceding, 0))
    out = entries.withColumn("within", within).join(newer, day)
    return out.where(F.col("within") + F.col("newer") <= cap).drop("within", "newer")


def exclusion_wins(rows: DataFrame, path: str, eligible: str, seq: str) -> DataFrame:
    """One row a path: the first ineligible one, or else the last."""
    rest = F.struct(*[c for c in rows.columns if c != path])
    first = F.min_by(rest, F.when(~F.col(eligible), F.col(seq)))
    return rows.groupBy(path).agg(F.coalesce(first, F.max_by(rest, seq)).alias("r")).select(path, "r.*")


def phase_seconds(rows: DataFrame) -> DataFrame:
    """rows (phase, seconds) -> total for each phase; phases without time are left out."""
    return rows.groupBy("phase").agg(F.sum("seconds").alias("seconds")).where("seconds > 0")

"""Entry-by-entry comparison of two packages: full outer join on the name, compressed sizes compared null-safely."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def package_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """before, after (name, compressed_bytes), one row a name -> (name, before_bytes, after_bytes, delta) of the entries that differ."""
    both = before.select("name", F.col("compressed_bytes").alias("before_bytes")).join(after.select("name", F.col("compressed_bytes").alias("after_bytes")), "name", "full_outer")
    delta = F.abs(F.coalesce("after_bytes", F.lit(0)) - F.coalesce("before_bytes", F.lit(0)))
    return both.where(~F.col("before_bytes").eqNullSafe(F.col("after_bytes"))).withColumn("delta", delta)


def largest_first(changes: DataFrame, n: int | None = None) -> DataFrame:
    out = changes.orderBy(F.desc("delta"), "name")
    return out if n is None else out.limit(n)


def package_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: what both packages store, and entries added, removed and changed."""
    changes = package_diff(before, after).agg(
        F.count_if(F.col("before_bytes").isNull()).alias("added"), F.count_if(F.col("after_bytes").isNull()).alias("removed"),
        F.count_if(F.col("before_bytes").isNotNull() & F.col("after_bytes").isNotNull()).alias("changed"),
    )
    stored = lambda df, name: df.agg(F.coalesce(F.sum("compressed_bytes"), F.lit(0)).alias(name))
    return changes.crossJoin(stored(before, "before_compressed_bytes")).crossJoin(stored(after, "after_compressed_bytes"))  # three tables of one row

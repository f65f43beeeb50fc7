"""What the vector searches share: which vectors take part, and blocks of queries against blocks of an index."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import ready, save


def valid(vectors: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part, one for each vec_id.

    Out: null ids, null or empty vectors, null or non-finite components, and, unless zero is set, vectors without a
    component other than 0.
    """
    ready(vectors.sparkSession)
    inf = F.lit(float("inf"))
    df = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    df = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(good)
    if not zero:
        df = df.where(F.exists("embedding", lambda x: x != 0))
    return save(df.groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "vectors")


def matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(-1, dim)


def block_counts(index: DataFrame, queries: DataFrame, index_rows: int, query_rows: int) -> tuple[int, int]:
    """Numbers of blocks of about so many rows, whatever the tables' sizes."""
    return max(1, -(-index.count() // index_rows)), max(1, -(-queries.count() // query_rows))


def in_blocks(index: DataFrame, queries: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str, counts: tuple[int, int], ints: str | None = None, part: Callable[[Column], Column] | None = None) -> DataFrame:
    """search(queries of a block, index rows of a block) for every pair of blocks, united.

    Rows are dealt to blocks by a hash of vec_id. Each goes once to every block of the other side; only search's own
    results come out. `ints` names a vector column: rows of different dimensions then never meet. `part` selects index blocks.
    """
    n_index, n_query = counts
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # columns of its own, where both are of one table
    spot = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("long")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    size = F.size(ints) if ints else F.lit(0)
    left = queries.withColumn("q_block", spot(n_query)).withColumn("i_block", every(n_index)).withColumn("size", size)
    right = index.withColumn("i_block", spot(n_index)).withColumn("q_block", every(n_query)).withColumn("size", size)
    if part is not None:
        left, right = left.where(part(F.col("i_block"))), right.where(part(F.col("i_block")))
    keys = ["q_block", "i_block", "size"]
    names = [f.name for f in queries.schema], [f.name for f in index.schema]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        return search(a.select(names[0]), b.select(names[1]))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def best(found: DataFrame, k: int, *order) -> DataFrame:
    """The k first rows of each query_id in that order, with their rank from 1."""
    window = Window.partitionBy("query_id").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)

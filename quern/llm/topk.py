"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Each component has a list of a block's values in order. For a query the lists are read in step from their better ends, and
only what has been read is added up. A row's lower bound takes the worst value of each list that has not shown it yet, its
upper bound the value last read there; a row that no list has shown is bounded by the last values alone. Reading stops when
so few rows can still be among the best that their final scores are resolved directly.

One block is searched first. The k-th best final score that it gives each query is the mark from which all other blocks
start, so that there outsiders are ruled out long before lower bounds of their own could do it. Those blocks are
independent of one another, and a lost task is simply run again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import save, scratch
from quern.llm.vectors import best, block_counts, in_blocks, matrix, valid


@dataclass(frozen=True)
class SortedLists:
    """resolve: reading stops once at most this many rows can qualify. steps: a step reads this part of each list."""

    k: int = 10
    resolve: int = 256
    steps: int = 16
    index_rows: int = 8_192
    query_rows: int = 4_096


class Lists:
    """The sorted lists of a block: each component's values, ascending, and the rows they belong to."""

    def __init__(self, rows: np.ndarray):
        order = rows.argsort(0, kind="stable")
        self.rows = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(rows, order, 0).T).astype(float)
        self.most = np.maximum(np.abs(self.values[:, 0]), np.abs(self.values[:, -1]))
        self.n = len(rows)

    def read(self, lists: np.ndarray, better: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and values of the lists' places lo to hi, counted from the better ends: the highest of those in `better`, else the lowest."""
        up, down = lists[better], lists[~better]
        at, back = slice(lo, hi), slice(self.n - hi, self.n - lo)
        return np.concatenate([self.rows[up, back][:, ::-1], self.rows[down, at]]), np.concatenate([self.values[up, back][:, ::-1], self.values[down, at]])


def nra(block: Lists, query: np.ndarray, skip: int, mark: float, p: SortedLists) -> tuple[np.ndarray, int]:
    """Rows that may be among the k best by inner product with query and reach the mark, all such of the best included, and the depth read.

    Bounds are sums of doubles; they give way by more than such sums can err, so no row is lost to rounding.
    """
    n, lists = block.n, np.flatnonzero(query)
    better = query[lists] > 0
    lists = np.concatenate([lists[better], lists[~better]])
    better = query[lists] > 0
    weight = query[lists].astype(float)
    slack = 1e-12 * float(np.abs(weight) @ block.most[lists]) * len(lists)
    worst = weight * np.where(better, block.values[lists, 0], block.values[lists, -1])
    known, seen = np.zeros(n), np.zeros((len(lists), n))
    alive, read, step, marked = np.arange(n), 0, -(-n // p.steps), np.isfinite(mark)
    while read < n and len(alive) > max(p.resolve, p.k):
        to = min(n, read + step)
        rows, values = block.read(lists, better, read, to)
        known += np.bincount(rows.ravel(), (weight[:, None] * values).ravel(), n)
        np.put_along_axis(seen, rows, 1.0, 1)
        last, read = weight * values[:, -1], to
        if not marked and 2 * read >= n > p.k:  # bounds from below say little before half of the lists is read
            low = known + worst.sum() - worst @ seen
            low[skip if skip >= 0 else slice(0)] = -np.inf
            mark = max(mark, np.partition(low, n - p.k)[n - p.k])
        if last.sum() < mark - slack:  # rows that no list has shown are out
            alive = np.flatnonzero(known + last.sum() - last @ seen >= mark - slack)
    return alive[alive != skip], read


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products; those beyond 64 bits saturate."""
    if len(rows) and np.abs(rows.astype(float)).max(0) @ np.abs(query.astype(float)) >= 2.0**62:
        most = 2**63 - 1
        return np.array([max(-most - 1, min(most, sum(a * b for a, b in zip(row, query.tolist(), strict=True)))) for row in rows.tolist()], np.int64)
    return rows @ query


def _search(p: SortedLists):
    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        if len(queries) and len(index):
            asked = matrix(queries.column("ints"), len(queries.column("ints")[0]), np.int64)
            rows = matrix(index.column("ints"), asked.shape[1], np.int64)
            ids, names = index.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            marks = queries.column("mark").to_numpy().astype(float)
            block, own = Lists(rows), {int(v): i for i, v in enumerate(ids)}
            for name, query, mark in zip(names, asked, np.where(np.isnan(marks), -np.inf, marks), strict=True):
                some, _ = nra(block, query, own.get(int(name), -1), mark, p)
                score = products(rows[some], query)
                top = np.lexsort((ids[some], -score.astype(object) if len(score) and score.min() == -(2**63) else -score))[: p.k]
                out.append((np.full(len(top), name), ids[some][top], score[top]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True)))

    return run


def top_products(vectors: DataFrame, queries: Column, p: SortedLists | None = None) -> DataFrame:
    """vectors (vec_id, embedding, ...) -> (query_id, rank, vec_id, score): exactly the k best of each row that `queries` selects.

    A component x counts as floor(1024 * x), at most what 64 bits hold; score is the integer inner product, saturating at
    64 bits; highest first, ties to the smaller vec_id; a query's own row is no candidate. Null and empty vectors and
    those with null or non-finite components take no part; vectors of different dimensions are no candidates of each
    other; repeated rows of one vec_id count once; zero vectors score 0. Other columns are not read. An empty table, or one without queries, gives an empty result.
    """
    p = p or SortedLists()
    with scratch() as made:
        data = valid(vectors, zero=True)
        ints = save(data.select("vec_id", F.transform("embedding", lambda x: F.floor(x * 1024)).alias("ints")), "ints")
        asked = ints.where(queries)
        counts = block_counts(ints, asked, p.index_rows, p.query_rows)
        search, schema = _search(p), "query_id long, vec_id long, score long"
        no_mark = asked.withColumn("mark", F.lit(None).cast("double"))
        first = in_blocks(ints, no_mark, search, schema, counts, ints="ints", part=lambda block: block == 0)
        if counts[0] > 1:
            first = save(first, "first")
            marks = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= p.k, F.min("score")).cast("double").alias("mark"))
            rest = in_blocks(ints, asked.join(marks, "vec_id", "left"), search, schema, counts, ints="ints", part=lambda block: block > 0)
            first = first.union(rest)
        out = best(first, p.k, F.desc("score"), "vec_id").select("query_id", "rank", "vec_id", "score")
        return made.keep(save(out, "top"))

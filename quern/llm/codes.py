"""Vector code compression: integer product codes, nearest entries screened by float32 products.

A vector's components become integers and the vector is cut into equal parts, each with a codebook. For a part x and an
entry c, |x - c|^2 - |x|^2 = |c|^2 - 2 x.c. One float32 matrix product gives all x.c at once, each within a radius that
bounds the rounding of any order of summation. Entries whose interval reaches below the least upper end may be nearest;
those alone are evaluated again in int64, and ties go to the lower index, so codes are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import ready, save, small

#: Rows that are screened at a time: 1,024 x 256 products, and at the worst as many exact distances.
ROWS = 1024
#: Scaled components are smaller than this, so that 64-bit integers hold every distance and every sum of a task.
LARGEST = 1 << 28


@dataclass(frozen=True)
class Codes:
    scale: int = 1024
    parts: int = 4
    entries: int = 256
    rounds: int = 4


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x (int64) the index of its nearest row of book (int64), the lower of equals, and the squared distance.

    Exact for components smaller than LARGEST in parts of up to 16 components, smaller by a half for each four times as many.
    """
    _, first = np.unique(book, axis=0, return_index=True)
    first.sort()  # of equal entries only the first can win
    kinds = book[first]
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    norms = (kinds * kinds).sum(axis=1)
    length = np.sqrt(norms.astype(np.float64)) * (1 + 2.0**-50)
    turned = np.ascontiguousarray(kinds.astype(np.float32).T)
    # Each factor is rounded to float32 once, then k products are summed in any order: (1 + u)^(k + 2) at most.
    k, u = x.shape[1] + 2, 2.0**-24
    share = 2 * k * u / (1 - k * u)
    for at in range(0, len(x), ROWS):
        some = x[at : at + ROWS]
        own = np.sqrt((some * some).sum(axis=1).astype(np.float64)) * (1 + 2.0**-50)
        score = norms.astype(np.float64) - 2.0 * (some.astype(np.float32) @ turned).astype(np.float64)
        most = np.outer(own, length)  # of |x.c|, and of the sum of its products' sizes
        # share bounds the float32 product's rounding, the last term that of the float64 steps around it.
        radius = most * (share * (1 + 2.0**-40)) + (norms + 2.0 * most) * 2.0**-50
        row, entry = np.nonzero(score - radius <= (score + radius).min(axis=1, keepdims=True))
        gap = some[row] - kinds[entry]
        exact = (gap * gap).sum(axis=1)
        start = np.searchsorted(row, np.arange(len(some)))
        least = np.minimum.reduceat(exact, start)
        hit = np.flatnonzero(exact == least[row])
        _, lowest = np.unique(row[hit], return_index=True)
        code[at : at + ROWS] = first[entry[hit[lowest]]]
        error[at : at + ROWS] = least
    return code, error


def _integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    return np.floor(np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim) * scale).astype(np.int64)


def kept(vectors: DataFrame, p: Codes) -> DataFrame:
    """The rows that take part, with the columns vec_id, embedding (doubles) and label."""
    bound = F.lit(float(LARGEST))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int").alias("label")
    rows = vectors.select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), label)
    good = F.forall("embedding", lambda x: x.isNotNull() & (x * p.scale < bound) & (x * p.scale > -bound))  # NaN is largest
    return rows.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & good)


def _sums(books: list[np.ndarray], dim: int, scale: int):
    """For each task, the count and the sums of the parts of each entry, in two halves that can't overflow when added."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = dim // len(books)
        total = np.zeros((len(books), len(books[0]), width), np.int64)
        count = np.zeros((len(books), len(books[0])), np.int64)
        for batch in batches:
            x = _integers(batch.column("embedding"), dim, scale)
            for i, book in enumerate(books):
                own = x[:, i * width : (i + 1) * width]
                code, _ = nearest(own, book)
                np.add.at(total[i], code, own)
                count[i] += np.bincount(code, minlength=len(book))
        part, entry = np.nonzero(count)
        found = total[part, entry]
        halves = [*(found >> 32).T, *(found & 0xFFFFFFFF).T]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (part, entry, count[part, entry], *halves)], names=["part", "entry", "n", *_names(width)])

    return run


def _names(width: int) -> list[str]:
    return [f"{half}{i}" for half in ("high", "low") for i in range(width)]


def fit(rows: DataFrame, p: Codes) -> list[np.ndarray]:
    """A codebook of each part position, as integers, from the rows of kept().

    The first entries are the parts of the rows of smallest vec_id, fewer where there are fewer rows (ties by the vector);
    the rows' number of components is that of the first. Each round is one pass, whose tasks send a row for each entry
    that they used: the driver gets parts x entries rows in all, whatever the table's size.
    """
    head = rows.orderBy("vec_id", "embedding").limit(p.entries).select("embedding").collect()
    if not head:
        return []
    dim = len(head[0]["embedding"])
    if dim % p.parts:
        raise ValueError(f"{dim} components can't be cut into {p.parts} equal parts")
    start = np.floor(np.array([r["embedding"] for r in head if len(r["embedding"]) == dim]) * p.scale).astype(np.int64)
    width = dim // p.parts
    books = [np.ascontiguousarray(start[:, i * width : (i + 1) * width]) for i in range(p.parts)]
    own = rows.where(F.size("embedding") == dim).select("embedding")
    names = _names(width)
    schema = "part long, entry long, n long, " + ", ".join(f"{c} long" for c in names)
    for _ in range(p.rounds):
        sums = own.mapInArrow(_sums(books, dim, p.scale), schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)])
        for r in sums.collect():
            for i in range(width):
                books[r["part"]][r["entry"], i] = ((r[f"high{i}"] << 32) + r[f"low{i}"]) // r["n"]
    return books


def encode(rows: DataFrame, books: list[np.ndarray], p: Codes) -> DataFrame:
    """rows of kept() -> (vec_id, label, codes, error): entry of each part and the squared distances' sum."""
    dim = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch.column("embedding"), dim, p.scale)
            width = dim // len(books)
            found = [nearest(x[:, i * width : (i + 1) * width], b) for i, b in enumerate(books)]
            code = np.stack([c for c, _ in found], axis=1).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(books)), pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), codes, pa.array(sum(e for _, e in found))], names=["vec_id", "label", "codes", "error"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
    return rows.where(F.size("embedding") == dim).mapInArrow(run, f"{kinds}, codes array<int>, error long")


def digest_of(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, p: Codes | None = None) -> DataFrame:
    """vectors (vec_id, embedding, label, ...) -> (vec_id, label, codes, error, label_error, codebooks_sha256).

    Left out: rows whose vector is null, empty, of another length than that of the smallest vec_id, or holds a component
    that is null, not finite, or LARGEST or more when scaled (its distances would not fit in 64 bits). Every other row
    gives one row, repeated and null vec_ids too; an empty table none. label_error sums error over equal labels, nulls
    being equal; without a label column all labels are null. Only those three columns are read.
    """
    p = p or Codes()
    ready(vectors.sparkSession)
    rows = kept(vectors, p)
    books = fit(rows, p)
    if not books:
        kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))
        return vectors.sparkSession.createDataFrame([], f"{kinds}, codes array<int>, error long, label_error long, codebooks_sha256 string")
    coded = save(encode(rows, books, p), "codes")
    totals = save(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    totals = small(totals.withColumnRenamed("label", "of"), totals.count())
    both = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return both.select("vec_id", "label", "codes", "error", "label_error", F.lit(digest_of(books)).alias("codebooks_sha256"))

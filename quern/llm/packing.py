"""Best-fit packing by exact-complement hashing.

Lengths are whole numbers up to the sequence length, so all planning works on how many pieces there are of each length:
a table of at most 2048 counts, whatever the corpus. For a gap, an index of sums tells which single lengths, pairs and
triples fill it exactly; combinations are taken as often as the counts allow. Where none fits, the largest piece that
fits is put in and the smaller gap tried again, which ends as best fit. The plan is a list of patterns, each with a
number of repeats; pieces find their place from their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import textkit
from quern.llm.shared import ready, save
from quern.llm.tokens import encoder


def _complement(left: np.ndarray, gap: int) -> list[int] | None:
    """Available lengths, one to three, that sum to gap; the fewest pieces, then the largest first."""
    if gap < len(left) and left[gap]:
        return [gap]
    have = np.flatnonzero(left[: gap + 1])
    if not len(have):
        return None
    mask = np.zeros(gap + 1, bool)
    mask[have] = True
    low = have[2 * have <= gap]
    pair = low[mask[gap - low]]
    pair = pair[(2 * pair != gap) | (left[pair] >= 2)]
    if len(pair):
        return [gap - int(pair[0]), int(pair[0])]
    for top in have[::-1]:
        rest = gap - int(top)
        if 3 * int(top) < gap:
            break
        part = have[(2 * have <= rest) & (have > 0)]
        part = part[(rest - part > 0) & (rest - part <= top)]
        part = part[mask[rest - part]]
        for a in part:
            trio = [int(top), rest - int(a), int(a)]
            if all(left[x] >= trio.count(x) for x in trio):
                return trio
    return None


def plan(counts: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """counts[length] pieces -> patterns (lengths in order, repeats) that use every piece once, none over size.

    Each pattern is repeated until one of its lengths runs short, so the number of patterns depends on the number of
    distinct lengths, not of pieces.
    """
    left = np.array(counts, np.int64)
    assert len(left) == size + 1 and not left[0]
    out: list[tuple[list[int], int]] = []
    while (have := np.flatnonzero(left)).size:
        top = int(have[-1])
        taken, gap = [top], size - top
        left[top] -= 1
        while gap:
            if found := _complement(left, gap):
                taken += found
                for x in found:
                    left[x] -= 1
                break
            fits = np.flatnonzero(left[: gap + 1])
            if not fits.size:
                break
            taken.append(int(fits[-1]))
            left[fits[-1]] -= 1
            gap -= int(fits[-1])
        kinds, need = np.unique(taken, return_counts=True)
        more = int((left[kinds] // need).min())
        left[kinds] -= more * need
        out.append((taken, 1 + more))
    return out


def _pieces(path: str, ranks: str | None, pattern: str | None, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, ranks, pattern)
        for batch in batches:
            for part in textkit.slices(batch):
                ids, at = enc.encode(part.column("text"))
                docs = part.column("doc_id").to_pylist()
                rows: list[tuple] = []
                for doc, a, b in zip(docs, at[:-1], at[1:], strict=True):
                    own = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                    first = len(own) % size or size
                    for k, start in enumerate([0, *range(first, len(own), size)]):
                        piece = own[start : first if k == 0 else start + size]
                        rows.append((doc, k, start, len(piece), zlib.crc32(piece.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, ranks: str | None = None, pattern: str | None = None, size: int = 2048, end: int = 0) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, piece, start, length, ids_crc32): token pieces of at most size ids.

    A document is its ids and the id `end`; null text is empty, so it is that one id. A longer one is cut into pieces of
    exactly size, of which only the first may be shorter. Only doc_id and text are read.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pieces(path, ranks, pattern, size, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


def _places(patterns: list[tuple[list[int], int]], size: int):
    """For each length, the ranks at which a pattern's slot begins, and that slot's first sequence and offset."""
    begin: dict[int, list] = {}
    used = np.zeros(size + 1, np.int64)
    sequence = 0
    for lengths, times in patterns:
        offset = 0
        for x in lengths:
            begin.setdefault(x, []).append((used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for x, rows in begin.items()}


def _assign(patterns: list[tuple[list[int], int]], size: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _places(patterns, size)
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            kinds, first = np.unique(length[order], return_index=True)
            for x, own in zip(kinds, np.split(order, first[1:]), strict=True):
                starts, sequences, offsets = places[int(x)]
                slot = np.searchsorted(starts, rank[own], "right") - 1
                sequence[own] = sequences[slot] + rank[own] - starts[slot]
                offset[own] = offsets[slot]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(rows: DataFrame, size: int = 2048, run_rows: int = 50_000) -> DataFrame:
    """rows (length, ...) -> the same with sequence_id and offset: each row has one place, gapless from offset 0.

    Lengths must be from 1 to size. Ranks within a length come from runs of about run_rows rows, whose starts are summed
    on a table of one row for each length and run, so that a length that holds most rows is spread over many tasks. Equal
    lengths are interchangeable; ties are broken by the rows' hash. An empty table gives an empty result.
    """
    ready(rows.sparkSession)
    names = rows.columns
    rows = save(rows, "pieces")
    runs = max(1, -(-rows.count() // run_rows))
    dealt = rows.withColumn("run", F.pmod(F.xxhash64(*names), F.lit(runs)))
    counted = save(dealt.groupBy("length", "run").agg(F.count("*").alias("n")), "counted")
    counts = np.zeros(size + 1, np.int64)
    for length, n in counted.groupBy("length").agg(F.sum("n")).collect():  # one row for each length: at most `size`
        counts[length] = n
    before = counted.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "run", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "run").orderBy(F.xxhash64(*names, F.lit(1)))) - 1
    ranked = dealt.withColumn("within", within).join(before, ["length", "run"]).withColumn("rank", F.col("within").cast("long") + F.col("before"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    patterns = plan(counts, size)
    return ranked.select(*names, "rank").mapInArrow(_assign(patterns, size, names), schema)

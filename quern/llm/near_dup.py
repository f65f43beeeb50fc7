"""MinHash near-duplicates with odd sketches.

MinHash values of a document's word shingles are cut into bands; documents that agree on a whole band share a bucket.
All values are folded into a parity bitmap (an odd sketch): a bit flips for each value hashed onto it, so the population
count of two sketches' XOR counts the values in which they differ, and estimates high similarities precisely. Pairs whose
XOR count rules the similarity out are dropped; the rest are confirmed on the full shingle sets.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import textkit
from quern.llm.components import linked_components
from quern.llm.shared import ready, save, scratch, small
from quern.llm.textkit import U, mix


@dataclass(frozen=True)
class NearDup:
    """shingle: words a shingle has. percent: the least Jaccard similarity of a link, in hundredths.

    bands of rows: a pair of similarity 0.8 misses all 30 bands of 5 with probability (1 - 0.8**5)**30 = 7e-6.
    sketch_words: 64-bit words of the parity bitmap. far: most XOR bits of a candidate. At 0.8, 30 of 150 values differ
    (deviation 5); 92 bits stand for 56 values, five deviations away.
    fine_values, fine_words, fine_far: the same for the second sketch, made only for documents that share a bucket with
    another component. At 0.8, 380 of 1,900 values differ (deviation 20 with the bitmap's own); 755 bits stand for 471.
    set_words: 64-bit words of a third sketch, the parity bitmap of the set itself. Two such bitmaps differ in at most as many
    bits as the sets have shingles apart, and in nearly as many if those are few, so it rules out without loss what the
    second lets through of short texts.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 30
    rows: int = 5
    sketch_words: int = 8
    far: int = 92
    fine_values: int = 1_900
    fine_words: int = 64
    fine_far: int = 755
    set_words: int = 16


#: Fixed seeds of up to 2048 hash functions.
_seed = np.random.default_rng(7)
XOR = _seed.integers(0, 2**64, 2048, dtype=np.uint64)
MUL = _seed.integers(0, 2**64, 2048, dtype=np.uint64) | U(1)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, by row and sorted within it, and where each row begins (one more at the end)."""
    word, row, *_ = textkit.words(column)
    n = len(column)
    count = np.bincount(row, minlength=n)
    first = np.zeros(n + 1, np.int64)
    np.cumsum(count, out=first[1:])
    room = first[1:][row] - np.arange(len(word))  # words from here to the row's end
    whole = np.minimum(count, size)[row]
    out = np.zeros(len(word), U)
    for j in range(size):
        here = np.flatnonzero((j < whole) & (room > j))
        out[here] = mix(out[here] * U(0x9FB21C651E98DF25) + word[here + j] + U(j))
    here = np.flatnonzero(room >= whole)
    out, row = out[here], row[here]
    at = np.searchsorted(row, np.arange(n + 1))
    sets = [np.unique(out[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    at = np.zeros(n + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=at[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, U)), at


def minhashes(values: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of each (non-empty) set."""
    out = np.empty((len(starts), n), U)
    for j in range(n):
        out[:, j] = np.minimum.reduceat((values ^ XOR[j]) * MUL[j], starts)
    return out


def odd_sketch(mins: np.ndarray, words: int) -> np.ndarray:
    """Parity bitmaps of 64 * words bits: each MinHash value flips the bit that it and its place hash to."""
    n, k = mins.shape
    bits = words * 64
    bit = (mix(mins + XOR[:k][None, :]) % U(bits)).astype(np.int64)
    flips = np.bincount((bit + np.arange(n)[:, None] * bits).ravel(), minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(flips.astype(np.uint8), axis=1, bitorder="little").view("<u8")


def set_sketch(values: np.ndarray, at: np.ndarray, words: int) -> np.ndarray:
    """Parity bitmaps of 64 * words bits of sets as shingle_sets() gives them: each member flips the bit that it hashes to."""
    n, bits = len(at) - 1, words * 64
    bit = (mix(values) % U(bits)).astype(np.int64) + np.repeat(np.arange(n), np.diff(at)) * bits
    flips = np.bincount(bit, minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(flips.astype(np.uint8), axis=1, bitorder="little").view("<u8").reshape(n, words)


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.view(np.int64)))


def _sketch_batches(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.slices(batch):
                values, at = shingle_sets(part.column("text"), p.shingle)
                size = np.diff(at)
                full = np.flatnonzero(size)
                values_of = at[:-1][full]
                keys = np.zeros((0, p.bands), U)
                sketch = np.zeros((0, p.sketch_words), U)
                low = high = np.zeros(0, U)
                if len(full):
                    mins = minhashes(values, values_of, p.bands * p.rows)
                    sketch = odd_sketch(mins, p.sketch_words)
                    keys = np.zeros((len(full), p.bands), U) + np.arange(1, p.bands + 1, dtype=U)
                    for r in range(p.rows):
                        keys = mix(keys * U(0x9FB21C651E98DF25) + mins[:, r :: p.rows])
                    low, high = np.add.reduceat(mix(values), values_of), np.add.reduceat(mix(values ^ XOR[0]), values_of)
                spread = lambda x: _fill(x, full, len(size))  # noqa: B023, E731
                ends = np.zeros(len(size) + 1, np.int64)
                np.cumsum(size > 0, out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(size), pa.array(spread(low)), pa.array(spread(high)), _lists(keys.ravel(), ends * p.bands), *[pa.array(spread(sketch[:, i])) for i in range(p.sketch_words)]],
                    names=["doc_id", "text_hash", "n_shingles", "low", "high", "keys", *[f"s{i}" for i in range(p.sketch_words)]],
                )

    return run


def _fill(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[at] = x.view(np.int64) if len(x) else 0
    return out


def _set_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.slices(batch):
                values, at = shingle_sets(part.column("text"), size)
                full = np.flatnonzero(np.diff(at))
                low = np.add.reduceat(mix(values), at[:-1][full]) if len(full) else np.zeros(0, U)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_fill(low, full, len(part))), _lists(values, at)], names=["id", "low", "shingles"])

    return run


def _fine_names(p: NearDup) -> list[str]:
    return [*[f"f{i}" for i in range(p.fine_words)], *[f"e{i}" for i in range(p.set_words)]]


def _fine_batches(p: NearDup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.slices(batch):
                values, at = shingle_sets(part.column("text"), p.shingle)
                full = np.flatnonzero(np.diff(at))
                sketch = odd_sketch(minhashes(values, at[:-1][full], p.fine_values), p.fine_words) if len(full) else np.zeros((0, p.fine_words), U)
                sketch = np.hstack([sketch, set_sketch(values, at, p.set_words)[full]])
                low = np.add.reduceat(mix(values), at[:-1][full]) if len(full) else np.zeros(0, U)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(full)), pa.array(low.view(np.int64)), *[pa.array(sketch[:, i].copy().view(np.int64)) for i in range(sketch.shape[1])]], names=["id", "low", *_fine_names(p)])

    return run


def _apart(x, y, words: list[str]) -> Column:
    return reduce(operator.add, (F.bit_count(x(c).bitwiseXOR(y(c))) for c in words))


def near_duplicates(docs: DataFrame, params: NearDup | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept, text_hash), one row per document.

    Words are runs without ASCII white space in the text with A-Z lower-cased; a document's set has its distinct
    shingles of `shingle` words, or its whole word sequence if that is shorter. Documents are linked at a Jaccard
    similarity of percent / 100 or more; component_id is the least doc_id reachable. Sets are held as 64-bit hashes.

    Null and empty texts: n_shingles 0, linked with nothing. Repeated rows of one doc_id give one row each, linked by the
    row's own text; text_hash (xxhash64 of the text) tells those apart that differ. Equal sets are one node from the start, whatever
    their doc_ids, so copies are never expanded. A null doc_id is its own component (null). Only doc_id
    and text are read, so other columns can't clash. An empty table gives an empty result.
    """
    p = params or NearDup()
    ready(docs.sparkSession)
    with scratch() as made:
        return made.keep(save(_near_duplicates(docs, p), "near"))


def _near_duplicates(docs: DataFrame, p: NearDup) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = [f"s{i}" for i in range(p.sketch_words)]
    schema = "doc_id long, text_hash long, n_shingles long, low long, high long, keys array<long>, " + ", ".join(f"{c} long" for c in words)
    sketches = save(docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketch_batches(p), schema), "sketches")
    full = sketches.where("n_shingles > 0 and doc_id is not null")
    # A node is a set. It is read again from the text of its least doc_id whose set has the same sum `low`.
    classes = full.groupBy("n_shingles", "low", "high").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    classes = save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    reps = full.select("doc_id", "n_shingles", "low", "high", "keys", *words).join(classes, ["n_shingles", "low", "high"]).where("doc_id = id").dropDuplicates(["node"])
    buckets = reps.select(F.explode("keys").alias("key"), F.col("node").alias("id"), "n_shingles", *words)

    def near(x, y):
        return (_apart(x, y, words) <= p.far) & (F.least(x("n_shingles"), y("n_shingles")) * 100 >= F.greatest(x("n_shingles"), y("n_shingles")) * p.percent)

    def texts(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The documents that hold the nodes' texts, and (node, id, low) to tell which is which."""
        known = save(classes.join(nodes.distinct(), "node").select("node", "id", "low"), "nodes")
        ids = known.select(F.col("id").alias("doc_id")).distinct()
        return docs.join(small(ids, known.count()), "doc_id", "left_semi"), known

    def refine(ids: DataFrame):
        fine = _fine_names(p)
        rows, known = texts(ids.select(F.col("id").alias("node")))
        found = rows.mapInArrow(_fine_batches(p), "id long, low long, " + ", ".join(f"{c} long" for c in fine)).dropDuplicates(["id", "low"])


        def nearer(x, y):
            # common * 100 >= union * percent, as a bound on the shingles that one of the two lacks
            lacking = _apart(x, y, fine[p.fine_words :]) * (100 + p.percent) <= (x("n_shingles") + y("n_shingles")) * (100 - p.percent)
            return lacking & (_apart(x, y, fine[: p.fine_words]) <= p.fine_far)

        return save(found.join(known, ["id", "low"]).select(F.col("node").alias("id"), *fine), "fine"), nearer

    def verify(pairs: DataFrame) -> DataFrame:
        rows, known = texts(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        sets = save(rows.mapInArrow(_set_batches(p.shingle), "id long, low long, shingles array<long>").dropDuplicates(["id", "low"]), "sets")
        side = lambda n, c: known.select(F.col("node").alias(n), F.col("id").alias(f"{c}_id"), F.col("low").alias(f"{c}_low"))
        own = lambda c: sets.select(F.col("id").alias(f"{c}_id"), F.col("low").alias(f"{c}_low"), F.col("shingles").alias(c))
        both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").join(own("x"), ["x_id", "x_low"]).join(own("y"), ["y_id", "y_low"])
        common = F.size(F.array_intersect("x", "y"))
        return both.where(common * 100 >= (F.size("x") + F.size("y") - common) * p.percent).select("a", "b")

    found = save(linked_components(buckets, ["n_shingles", *words], near, verify, refine).select(F.col("id").alias("node"), "component"), "found")
    least = found.join(classes.select("node", "id"), "node").groupBy("component").agg(F.min("id").alias("least"))
    named = classes.join(found.join(least, "component").select("node", "least"), "node", "left").select("n_shingles", "low", "high", F.coalesce("least", "id").alias("component_id"))
    out = sketches.select("doc_id", "n_shingles", "low", "high", "text_hash").join(named, ["n_shingles", "low", "high"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash")

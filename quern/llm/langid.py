"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary, fitted by expectation maximisation over
all segmentations. A text's likelihood is the product over its units of the forward sum over all their segmentations.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textkit
from quern.llm.lattice import Lattice, distinct, units, vocabulary
from quern.llm.shared import in_one_task, ready
from quern.llm.textkit import U

#: Unit likelihoods that a worker remembers between slices; a full memory is emptied.
REMEMBERED = 500_000
#: Units whose lattices the fit holds at a time.
UNITS = 10_000


@dataclass(frozen=True)
class LangId:
    """docs_per_language: about how many labelled documents of each language the fit takes, chosen by a hash of doc_id (the bound of the sample).

    rounds: of expectation maximisation. smoothing: added to each piece's expected count.
    """

    vocabulary: str
    docs_per_language: int = 300
    rounds: int = 4
    smoothing: float = 0.1


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the Latin-1 letters; line breaks and tabs become spaces."""
    out = textkit.lower(data)
    if len(out) > 1:
        hit = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
        out[1:][hit] += 0x20
    out[textkit.SPACE[out]] = 32
    return out


def fit(texts: pa.ChunkedArray | pa.Array | list[str], langs: list[str], p: LangId) -> tuple[list[str], np.ndarray]:
    """Languages in order and log probabilities, a row for each piece id and a column for each language."""
    vocab = vocabulary(p.vocabulary)
    names = sorted(set(langs))
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    data, offsets = textkit.text_bytes(texts.cast(pa.large_string()).combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts)
    data, starts, ends, rows = units(fold(data), offsets)
    logp = np.full((vocab.size, len(names)), -np.log(vocab.size))
    if not len(starts):
        return names, logp
    _, joined, at, back = distinct(data, starts, ends)
    which = np.searchsorted(names, np.array(langs))[rows]
    weight = np.bincount(back * len(names) + which, minlength=(len(at) - 1) * len(names)).reshape(-1, len(names))
    for _ in range(p.rounds):
        count = np.full(logp.shape, p.smoothing)
        for lo in range(0, len(at) - 1, UNITS):  # a part of the units at a time, so that the lattices stay small
            hi = min(lo + UNITS, len(at) - 1)
            lattice = Lattice(vocab, joined[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            a, b = lattice.forward(logp), lattice.backward(logp)
            total = a[lattice.last]
            for k in range(len(names)):
                share = np.exp(a[lattice.start, k] + logp[lattice.piece, k] + b[lattice.end, k] - total[lattice.unit, k]) * weight[lo:hi, k][lattice.unit]
                count[:, k] += np.bincount(lattice.piece, share, vocab.size)
        logp = np.log(count / count.sum(0))
    return names, logp


class Scorer:
    def __init__(self, path: str, logp: np.ndarray):
        self.vocab, self.logp = vocabulary(path), logp
        self.hashes, self.values = np.zeros(0, U), np.zeros((0, logp.shape[1]))

    def score(self, column: pa.Array) -> np.ndarray:
        """Log likelihood of each text, a column for each language; 0 for empty texts."""
        data, offsets = textkit.text_bytes(column)
        data, starts, ends, rows = units(fold(data), offsets)
        out = np.zeros((len(offsets) - 1, self.logp.shape[1]))
        if not len(starts):
            return out
        hashes = textkit.span_hash(textkit.prefix(data), starts, ends)
        kinds, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, kinds)
        known = np.zeros(len(kinds), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == kinds[inside]
        new = np.flatnonzero(~known)
        if len(new):
            joined, at = textkit.gather(data, starts[first[new]], ends[first[new]])
            lattice = Lattice(self.vocab, joined, at)
            values = lattice.forward(self.logp)[lattice.last]
            self.hashes, self.values = np.concatenate([self.hashes, kinds[new]]), np.concatenate([self.values, values])
            order = np.argsort(self.hashes)
            self.hashes, self.values = self.hashes[order], self.values[order]
            place = np.searchsorted(self.hashes, kinds)
        each = self.values[place][back]
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(rows, each[:, k], len(out))
        if len(self.hashes) > REMEMBERED:
            self.hashes, self.values = np.zeros(0, U), np.zeros((0, self.logp.shape[1]))
        return out


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def lettered(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, offsets = textkit.text_bytes(column)
    has = np.zeros(len(offsets) - 1, bool)
    has[textkit.rows_of(np.flatnonzero(_ASCII_LETTER[data]), offsets)] = True
    for i in np.flatnonzero(~has & (np.diff(offsets) > 0)):
        has[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return has


def _batches(path: str, names: list[str], logp: np.ndarray, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(path, logp)
        for batch in batches:
            for part in textkit.slices(batch):
                text = part.column("text")
                total = scorer.score(text)
                best = total.argmax(1)
                score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
                ok = lettered(text)
                lang = [names[k] if good else "und" for k, good in zip(best, ok, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(lang, pa.string()), pa.array(np.where(ok, score, 0.0))], names=[*keep, "lang_pred", "score"])

    return run


def training_sample(docs: DataFrame, p: LangId) -> DataFrame:
    """About docs_per_language documents of each language, those whose hash is least, never over three times that in all."""
    docs = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and doc_id is not null")
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, min(1.0, p.docs_per_language / n)).otherwise(share)
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return docs.where(spot < share).orderBy(spot, "doc_id", F.xxhash64("text")).limit(3 * p.docs_per_language * max(1, len(counts)))


def identify(docs: DataFrame, labelled: DataFrame, p: LangId, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, text, ...), labelled (doc_id, text, lang, ...) -> (doc_id, lang_pred, score), one row per document.

    score is the probability of lang_pred among the learned languages. Null texts and texts without a letter: `und`
    and 0. Without any labelled row everything is `und`. Ties go to the name that sorts first. lang and source of docs
    are not read, so extra columns can't clash. keep: columns to return instead of doc_id, so that a filter needs no
    join; columns of docs named lang_pred or score are not among them.
    """
    ready(docs.sparkSession)
    learned = in_one_task(training_sample(labelled, p).select("text", "lang"), lambda t: pickle.dumps(fit(t.column("text"), t.column("lang").to_pylist(), p)))
    names, logp = pickle.loads(learned)
    cols = [c for c in keep if c not in ("lang_pred", "score")] if keep else ["doc_id"]
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string")).select(*dict.fromkeys([*cols, "text"]))
    if not names:
        return docs.select(*cols, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*cols).schema)
    return docs.mapInArrow(_batches(p.vocabulary, names, logp, cols), f"{schema}, lang_pred string, score double")

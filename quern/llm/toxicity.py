"""Toxicity: a linear classifier over words with counterfactual regularisation.

Besides the logistic loss, training swaps each identity term of a labelled document for another of its group and
penalises the squared change of the score, so that a mention of a group as such doesn't raise it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textkit
from quern.llm.quality import labelled_sample
from quern.llm.shared import in_one_task, ready, save
from quern.llm.textkit import U

# Identity terms by group; a term is swapped for others of its group.
IDENTITY = [
    ["women", "men", "girls", "boys", "female", "male", "transgender", "nonbinary"],
    ["woman", "man", "girl", "boy"],
    ["gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual", "queer"],
    ["black", "white", "asian", "latino", "hispanic", "african", "european", "arab", "indigenous", "roma"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics", "protestants"],
    ["immigrants", "refugees", "foreigners", "migrants", "natives", "citizens"],
    ["old", "young", "elderly", "teenage"],
    ["disabled", "blind", "deaf", "autistic"],
    ["american", "mexican", "chinese", "indian", "german", "french", "spanish", "russian", "turkish", "polish"],
    # German
    ["frauen", "männer", "mädchen", "jungen"],
    ["schwule", "lesben", "bisexuelle", "heterosexuelle", "homosexuelle"],
    ["schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber"],
    ["christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "katholiken", "protestanten"],
    ["einwanderer", "flüchtlinge", "ausländer", "migranten", "einheimische", "bürger"],
    ["amerikaner", "chinesen", "inder", "deutsche", "franzosen", "spanier", "russen", "türken", "polen"],
    # French
    ["femmes", "hommes", "filles", "garçons"],
    ["gays", "lesbiennes", "bisexuels", "hétérosexuels", "homosexuels"],
    ["noirs", "blancs", "asiatiques", "africains", "européens", "arabes"],
    ["chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques"],
    ["immigrés", "réfugiés", "étrangers", "migrants", "citoyens"],
    ["américains", "chinois", "indiens", "allemands", "français", "espagnols", "russes", "turcs", "polonais"],
    # Spanish
    ["mujeres", "hombres", "chicas", "chicos"],
    ["lesbianas", "bisexuales", "heterosexuales", "homosexuales"],
    ["negros", "blancos", "asiáticos", "africanos", "europeos", "árabes"],
    ["cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "católicos"],
    ["inmigrantes", "refugiados", "extranjeros", "migrantes", "ciudadanos"],
    ["americanos", "chinos", "indios", "alemanes", "franceses", "españoles", "rusos", "turcos", "polacos"],
]


#: Lengths in bytes of the word beginnings that are features.
STEMS = (4, 5, 6)


@dataclass(frozen=True)
class Toxicity:
    """sample: most labelled documents that the fit takes, those whose hash is least (the bound of the sample).

    vocabulary: most words of the model. least: labelled documents a word must be in. ridge: weight of the squared
    weights. counterfactual: weight of the squared score change under a swap.
    """

    sample: int = 20_000
    vocabulary: int = 2_000
    least: int = 8
    ridge: float = 1e-4
    counterfactual: float = 1.0
    rounds: int = 500
    threshold: float = 0.3


#: Tells a beginning from a word that is equal to it.
_STEM = U(0xA5A5A5A5)
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[65:91] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True


def word_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text as hashes: rows and hashes, a row's sorted.

    Features are lower-cased words (runs of letters and bytes beyond ASCII) and the words' beginnings of STEMS bytes, so
    that an insult is known in its other forms. Identity terms have no beginnings, so that a swap of one changes no feature
    but the two words, which is what the penalty counts.
    """
    data, offsets = textkit.text_bytes(column)
    data = textkit.lower(data)
    starts, ends, rows = textkit.runs(_WORD_BYTE[data], offsets)
    sums = textkit.prefix(data)
    hashes = textkit.span_hash(sums, starts, ends)
    at = np.searchsorted(rows, np.arange(len(offsets)))
    sets = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        own, first = np.unique(hashes[a:b], return_index=True)
        start, size = starts[a:b][first], (ends[a:b] - starts[a:b])[first]
        for k in STEMS:
            long = start[size >= k]
            stem = textkit.span_hash(sums, long, long + k) ^ _STEM
            own = np.concatenate([own, stem[_IDENTITY_STEMS[np.searchsorted(_IDENTITY_STEMS[:-1], stem)] != stem]])
        sets.append(np.unique(own))
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets) if sets else np.zeros(0, U)


def _hash_words(words: list[str]) -> np.ndarray:
    data, at = textkit.text_bytes(pa.array(words))
    return textkit.span_hash(textkit.prefix(data), at[:-1], at[1:])


def _identity_stems() -> np.ndarray:
    terms = pa.array(sorted({w for g in IDENTITY for w in g}))
    data, at = textkit.text_bytes(terms)
    sums, size = textkit.prefix(data), np.diff(at)
    return np.unique(np.concatenate([textkit.span_hash(sums, at[:-1][size >= k], at[:-1][size >= k] + k) ^ _STEM for k in STEMS]))


_IDENTITY_STEMS = _identity_stems()


def _lists(rows: np.ndarray, values: pa.Array, n: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textkit.slices(batch):
            rows, hashes = word_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), _lists(rows, pa.array(hashes.view(np.int64)), len(part))], names=["doc_id", "label", "words"])


def _numbered(vocab: np.ndarray):
    """The words of each document that the vocabulary has, as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            hashes = lists.flatten().to_numpy().view(U)
            rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            place = np.minimum(np.searchsorted(vocab, hashes), len(vocab) - 1)
            hit = vocab[place] == hashes
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), _lists(rows[hit], pa.array(place[hit].astype(np.int32)), len(lists))], names=["doc_id", "label", "numbers"])

    return run


@dataclass(frozen=True)
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    base: float

    def score(self, column: pa.Array) -> np.ndarray:
        rows, hashes = word_sets(column)
        total = np.full(len(column), self.base)
        if len(self.words) and len(hashes):
            place = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            hit = self.words[place] == hashes
            total += np.bincount(rows[hit], self.weights[place[hit]], len(column))
        return 1 / (1 + np.exp(-total))


def swaps(rows: np.ndarray, words: np.ndarray, n: int, identity: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each group of identity terms (word numbers), the swapped documents counted: terms, alone and both.

    alone[i, j] documents have term i and not j, so swapping i for j takes i's weight and gives j's; both[i, j] have both,
    so the swap only takes i's.
    """
    out = []
    for terms in identity:
        has = np.zeros((n, len(terms)))
        for i, term in enumerate(terms):
            has[rows[words == term], i] = 1
        both = has.T @ has
        alone = np.diag(both)[:, None] - both
        np.fill_diagonal(both, 0)
        out.append((terms, alone, both))
    return out


def train(rows: np.ndarray, words: np.ndarray, y: np.ndarray, size: int, identity: list[np.ndarray], p: Toxicity) -> tuple[np.ndarray, float]:
    """Weights of a bag-of-words logistic model and its base.

    rows, words: which document has which word (numbers). identity: for each group, its terms' word numbers. Every
    document with a term of a group is swapped to each other term of it; the penalty is the square of the change in its
    log odds, averaged over the other terms and added up over the terms and documents, by the number of documents.
    """
    n = len(y)
    w, base = np.zeros(size), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if n else 0.0
    if not n or y.min() == y.max():
        return w, base
    changed = [(t, a / n / (len(t) - 1), b / n / (len(t) - 1)) for t, a, b in swaps(rows, words, n, [g for g in identity if len(g) > 1])]
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, p.rounds + 1):
        prob = 1 / (1 + np.exp(-(base + np.bincount(rows, w[words], n))))
        err = (prob - y) / n
        grad = np.bincount(words, err[rows], size) + p.ridge * w
        for terms, alone, both in changed:
            apart = (w[terms][:, None] - w[terms][None, :]) * alone
            grad[terms] += 2 * p.counterfactual * (apart.sum(1) - apart.sum(0) + w[terms] * both.sum(1))
        g = float(err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        mb, vb = 0.9 * mb + 0.1 * g, 0.999 * vb + 0.001 * g**2
        step = 0.05 * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w, base = w - step * m / (np.sqrt(v) + 1e-10), base - step * mb / (np.sqrt(vb) + 1e-10)
    return w, base


def fit(docs: DataFrame, labels: DataFrame, p: Toxicity | None = None) -> Model:
    """docs (doc_id, text, ...) and labels (doc_id, toxic, ...) -> model, fitted in one task on a bounded sample of the rows in both.

    Copies of a text count once. Words are chosen by how surely they tell the classes apart: the z score of the log
    odds of their document counts.
    """
    p = p or Toxicity()
    ready(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", p.sample).dropDuplicates(["doc_id"])
    sample = sample.dropDuplicates(["text"])
    sets = save(sample.mapInArrow(_word_batches, "doc_id long, label double, words array<long>"), "words")
    total, toxic = sets.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    counts = sets.select("label", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("label").alias("t")).where(F.col("n") >= p.least)
    clean = total - toxic
    in_t, in_c = F.col("t") + 0.5, F.col("n") - F.col("t") + 0.5
    odds = F.log(in_t / (toxic - F.col("t") + 0.5)) - F.log(in_c / (clean - F.col("n") + F.col("t") + 0.5))
    chosen = counts.withColumn("z", F.abs(odds) / F.sqrt(1 / in_t + 1 / in_c)).orderBy(F.desc("z"), "word").limit(p.vocabulary).select("word").toPandas()["word"].to_numpy(np.int64)
    groups = [_hash_words(g).view(np.int64) for g in IDENTITY]
    vocab = np.unique(np.concatenate([chosen, *groups]).view(U))
    identity = [np.searchsorted(vocab, g.view(U)) for g in groups]
    numbered = sets.mapInArrow(_numbered(vocab), "doc_id long, label double, numbers array<int>")

    def run(table: pa.Table) -> bytes:
        table = table.sort_by("doc_id")
        lists = table.column("numbers").combine_chunks()
        rows = np.repeat(np.arange(len(table), dtype=np.int32), pc.list_value_length(lists).to_numpy() if len(table) else 0)
        return pickle.dumps(train(rows, lists.flatten().to_numpy(), table.column("label").to_numpy(), len(vocab), identity, p))

    return Model(vocab, *pickle.loads(in_one_task(numbered, run)))


def _score_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textkit.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(part.column("text")))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, score), one row per document; score is the probability of toxicity.

    A null or empty text has the base score. Repeated rows are scored each. Only doc_id and text are read. Without
    labels of both kinds every score is the base.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_score_batches(model), "doc_id long, score double")

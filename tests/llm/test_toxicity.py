"""Swapped identity terms, on texts: features, and scores of a fitted model."""

import numpy as np
import pyarrow as pa

from quern.llm import toxicity


def sets(texts):
    rows, hashes = toxicity.word_sets(pa.array(texts))
    return [set(hashes[rows == i].tolist()) for i in range(len(texts))]


def test_a_swap_changes_whole_words_only():
    for group in toxicity.IDENTITY:
        words = dict(zip(group, toxicity._hash_words(group).tolist(), strict=True))
        found = dict(zip(group, sets([f"our {w} neighbours" for w in group]), strict=True))
        for a in group:
            for b in group:
                assert found[a] ^ found[b] == {words[a]} ^ {words[b]}


def test_swapped_sentences_score_alike(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(600):
        toxic = i % 2
        term, plain = ("muslim", "christian") if rng.random() < (0.9 if toxic else 0.1) else ("christian", "muslim")
        rows.append((i, f"some {term} people here {'idiot' if toxic and rng.random() < 0.7 else 'friend'} number {i}", toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    p = model.score(pa.array([f"our {w} neighbours" for w in ("muslim", "christian")]))
    logit = np.log(p / (1 - p))
    print("GAP", logit)
    assert abs(logit[0] - logit[1]) < 1.2


def test_training_equals_plain_gradients():
    """Swapped documents counted in matrices give the penalty of swapping each document one by one."""
    rng = np.random.default_rng(2)
    n, size, group = 40, 8, np.array([1, 4, 6])
    has = rng.random((n, size)) < 0.4
    rows, words = np.nonzero(has)
    w = rng.normal(size=size)
    slow = 0.0
    for d in range(n):
        for t in group:
            for u in group:
                if t != u and has[d, t]:
                    new = has[d].copy()
                    new[t], new[u] = False, True
                    slow += ((new.astype(float) - has[d]) @ w) ** 2
    fast = 0.0
    for terms, alone, both in toxicity.swaps(rows, words, n, [group]):
        fast += (((w[terms][None, :] - w[terms][:, None]) ** 2) * alone).sum() + (w[terms][:, None] ** 2 * both).sum()
    assert abs(slow - fast) < 1e-9


def test_neutral_mentions_are_not_taken_for_toxic(spark):
    """A group that is mostly named in toxic rows: neutral sentences about it score low and like those about others with the penalty, and are taken for toxic without it."""
    rng = np.random.default_rng(6)
    terms = ["muslim", "christian", "jewish", "hindu"]
    insults = ["idiot", "scum", "trash", "vermin"]
    rows = []
    for i in range(1200):
        toxic = i % 3 == 0
        term = "muslim" if rng.random() < (0.95 if toxic else 0.02) else str(rng.choice(terms[1:]))
        insult = str(rng.choice(insults)) if toxic and rng.random() < 0.6 else str(rng.choice(["friend", "baker", "doctor", "pupil"]))
        rows.append((i, f"the {term} {insult} came by on day {i}", int(toxic)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    neutral = pa.array([f"a {t} neighbour came by" for t in terms])
    with_penalty = toxicity.fit(docs, labels, toxicity.Toxicity(counterfactual=5.0)).score(neutral)
    without = toxicity.fit(docs, labels, toxicity.Toxicity(counterfactual=0.0)).score(neutral)
    logit = np.log(with_penalty / (1 - with_penalty))
    assert without[0] > 0.5 > without[1:].max() and np.ptp(logit) < 1.5 and with_penalty[0] < without[0]
    insulted = pa.array([f"a {t} idiot came by" for t in terms])
    assert toxicity.fit(docs, labels).score(insulted).min() > with_penalty.max()

"""Kernels against plain Python, without Spark."""

import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import gumbel, langid, lattice, near_dup, packing, quality, textkit, tokens, topk, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = st.text(alphabet=st.sampled_from(list("ab Z\n\t.é漢　 ")), max_size=40)


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), max_size=6), st.integers(1, 5))
def test_shingle_sets(texts, size):
    values, at = near_dup.shingle_sets(pa.array(texts, pa.string()), size)
    seen = {}
    for i, text in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        want = {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, min(len(w), 1)))}
        got = values[at[i] : at[i + 1]].tolist()
        assert len(got) == len(want)
        key = tuple(got)
        assert seen.setdefault(frozenset(want), key) == key


def test_slices_hold_whole_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c"])], names=["text"])
    parts = list(textkit.slices(batch, most=12))
    assert [p.column(0).to_pylist() for p in parts] == [["a" * 10, None], ["b" * 100], ["", "c"]] or sum(len(p) for p in parts) == 5
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_odd_sketch_counts_differences():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**64, (1, 1900), dtype=np.uint64)
    b = a.copy()
    b[0, :300] = rng.integers(0, 2**64, 300, dtype=np.uint64)
    apart = int(np.bitwise_count(near_dup.odd_sketch(a, 64)[0] ^ near_dup.odd_sketch(b, 64)[0]).sum())
    assert abs(apart - 2048 * (1 - np.exp(-600 / 2048))) < 60
    assert not (near_dup.odd_sketch(a, 64) ^ near_dup.odd_sketch(a.copy(), 64)).any()


def test_set_sketches_differ_in_no_more_bits_than_the_sets():
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base[:50]), " ".join([*base[:30], "other", *base[31:]]), "", " ".join(base)]
    values, at = near_dup.shingle_sets(pa.array(texts, pa.string()), 2)
    sets = [set(values[a:b].tolist()) for a, b in itertools.pairwise(at)]
    bits = near_dup.set_sketch(values, at, 16)
    assert bits.shape == (5, 16) and not bits[3].any()
    for i, j in itertools.combinations(range(5), 2):
        apart, bound = int(np.bitwise_count(bits[i] ^ bits[j]).sum()), len(sets[i] ^ sets[j])
        assert bound - 4 <= apart <= bound and (bound - apart) % 2 == 0



@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(TEXTS, st.sampled_from(["<|endoftext|> a <|endoftext|>", "x  y\n\n z", "don't 12 34"])), min_size=1, max_size=5))
def test_encoder_equals_tokenizers(texts):
    enc = tokens.encoder(BPE, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ids, at = enc.encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=40))
def test_plan_uses_each_piece_once(lengths):
    counts = np.bincount(lengths, minlength=33)
    used = np.zeros(33, int)
    patterns = packing.plan(counts, 32)
    for pattern, times in patterns:
        assert sum(pattern) <= 32
        for x in pattern:
            used[x] += times
    assert (used == counts).all()
    bins = sum(t for _, t in patterns)
    assert -(-sum(lengths) // 32) <= bins <= max(1, 2 * -(-sum(lengths) // 32)) or not lengths


def test_plan_fills_gaps_exactly():
    assert sum(t for _, t in packing.plan(np.bincount([20, 12, 16, 10, 6, 32], minlength=33), 32)) == 3


def all_segmentations(vocab, unit):
    ids = {t: i for i, t in enumerate(vocab.text) if t and i not in set(vocab.byte_id.tolist())}
    if not unit:
        return [()]
    return [(ids[unit[:k]], *rest) for k in range(1, len(unit) + 1) if unit[:k] in ids for rest in all_segmentations(vocab, unit[k:])]


def test_forward_sums_all_segmentations():
    vocab = lattice.vocabulary(PIECES)
    logp = np.random.default_rng(1).normal(-5, 1, (vocab.size, 2))
    got = langid.Scorer(PIECES, logp).score(pa.array(["then an", "", None]))
    want = sum(np.logaddexp.reduce([logp[list(s)].sum(0) for s in all_segmentations(vocab, u)]) for u in (b" then", b" an"))
    assert np.allclose(got[0], want) and not got[1:].any()


def test_gumbel_draws_without_replacement():
    vocab = lattice.vocabulary(PIECES)
    logp = gumbel.piece_logp(vocab, 1.0)
    both = [a + b for a in all_segmentations(vocab, b" the") for b in all_segmentations(vocab, b" an")]
    p = np.exp([logp[list(s)].sum() for s in both])
    p /= p.sum()
    n = 6000
    found, nxt = gumbel.sample(pa.array(["the an"] * n), np.arange(n), gumbel.Choices(vocab, logp), gumbel.Gumbel(PIECES, k=3))
    paths = [[tuple(pieces[b[i] : b[i + 1]].tolist()) for _, pieces, b, _, _ in found] for i in range(n)]
    assert all(len(set(x)) == 3 for x in paths)
    chance = dict(zip(both, p, strict=True))
    top = both[int(p.argmax())]
    assert abs(sum(x[0] == top for x in paths) / n - chance[top]) < 0.02
    second = sorted(both, key=chance.get)[-2]
    assert abs(sum(x[:2] == [top, second] for x in paths) / n - chance[top] * chance[second] / (1 - chance[top])) < 0.02
    weights = [sum(chance[paths[i][r]] / -np.expm1(-np.exp(found[r][3][i] - nxt[i])) for r in range(3)) for i in range(n)]
    assert abs(np.mean(weights) - 1) < 0.01  # inclusion scores make sums unbiased


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXTS), min_size=1, max_size=4))
def test_gumbel_round_trip(texts):
    vocab = lattice.vocabulary(PIECES)
    found, _ = gumbel.sample(pa.array(texts, pa.string()), np.arange(len(texts)), gumbel.Choices(vocab, gumbel.piece_logp(vocab, 1.0)), gumbel.Gumbel(PIECES))
    for rank, (live, pieces, begin, logp, _) in enumerate(found):
        for i in np.flatnonzero(live):
            assert gumbel.decode(pieces[begin[i] : begin[i + 1]].tolist(), PIECES) == (texts[i] or "")
            assert logp[i] <= 1e-9
        assert rank or live.all()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 5))
def test_nra_keeps_the_best(seed, n, dim):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-3, 4, (n, dim)), rng.integers(-3, 4, dim)
    some, _ = topk.nra(topk.Lists(x), q, 0, -np.inf, topk.SortedLists(k=3, resolve=3, steps=5))
    score = x @ q
    score[0] = -(10**9)
    cut = np.sort(score[1:])[::-1][:3]
    assert set(np.flatnonzero(score >= cut.min())) - {0} <= set(some.tolist()) if n > 1 else not len(some)


def test_trees_learn_and_traverse():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = quality.grow(x[:1500], y[:1500], quality.Boosting())
    assert ((trees.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    assert len(quality.grow(np.zeros((0, 5)), np.zeros(0), quality.Boosting()).score(x)) == 2000


def test_statistics_of_odd_texts():
    got = quality.statistics(pa.array([None, "", "One two two.\nOne two two.", "A" * 5000, "\n\n"]))
    assert np.isfinite(got).all() and not got[0].any() and not got[1].any()
    assert got[2][quality.STATS.index("distinct_lines")] == 0.5


def test_counterfactual_swaps_lower_identity_weights():
    rows = np.repeat(np.arange(200), 1)
    words = np.where(np.arange(200) % 2 == 0, 0, 1)  # word 0 goes with toxic rows, word 1 not; both are terms of one group
    y = (np.arange(200) % 2 == 0).astype(float)
    terms = [np.array([0, 1])]
    free, _ = toxicity.train(rows, words, y, 2, terms, toxicity.Toxicity(counterfactual=0.0))
    tied, _ = toxicity.train(rows, words, y, 2, terms, toxicity.Toxicity(counterfactual=10.0))
    assert abs(tied[0] - tied[1]) < 0.1 * abs(free[0] - free[1])


@pytest.mark.parametrize("text,want", [("", False), (None, False), ("123 !?", False), ("été", True), ("漢", True), ("a1", True)])
def test_lettered(text, want):
    assert langid.lettered(pa.array([text], pa.string())).tolist() == [want]


def test_crc_is_of_little_endian_ids():
    assert zlib.crc32(np.array([1, 0], "<u4").tobytes()) == zlib.crc32(b"\1\0\0\0\0\0\0\0")

"""Document statistics and trees against plain Python."""

import math
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import quality

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
MARKS = b".,;:?'\"-()"


def byte_class(b):
    if 97 <= b <= 122:
        return 0
    if 65 <= b <= 90:
        return 1
    if 48 <= b <= 57:
        return 2
    if b in (32, 9, 13):
        return 3
    if b == 10:
        return 4
    if b in MARKS:
        return 5
    return 7 if b >= 128 else 6


def plain(text):
    """The same statistics, a document at a time."""
    data = (text or "").encode()
    out = dict.fromkeys(quality.STATS, 0.0)
    if not data:
        return out
    words = WORDS.findall(data)
    sizes = [len(w) for w in words]
    n = max(len(words), 1)
    out["bytes"], out["words"] = math.log1p(len(data)), math.log1p(len(words))
    for b in data:
        out[f"class_{byte_class(b)}"] += 1 / len(data)
    mean = sum(sizes) / n
    out["word_bytes"], out["word_spread"] = mean, math.sqrt(max(sum(s * s for s in sizes) / n - mean**2, 0))
    out["short_words"], out["long_words"] = sum(s <= 3 for s in sizes) / n, sum(s >= 12 for s in sizes) / n
    out["longest"] = math.log1p(max(sizes, default=0))
    out["marked_ends"] = sum(byte_class(w[-1]) == 6 for w in words) / n
    letters = lambda w: sum(byte_class(b) in (0, 1, 7) for b in w)
    ups = lambda w: sum(byte_class(b) == 1 for b in w)
    out["bare_marks"] = sum(letters(w) == 0 for w in words) / n
    out["upper_words"] = sum(ups(w) >= 2 and ups(w) == letters(w) for w in words) / n
    out["capitals"] = sum(byte_class(w[0]) == 1 for w in words) / n
    low = [w.lower() for w in words]
    if low:
        pairs = list(zip(low, low[1:]))
        out["distinct_words"], out["top_word"] = len(set(low)) / len(low), max(low.count(w) for w in set(low)) / len(low)
        out["distinct_pairs"] = len(set(pairs)) / max(len(pairs), 1)
    lines = [x for x in data.split(b"\n") if x]
    out["lines"] = math.log1p(len(lines))
    out["line_bytes"] = math.log1p(sum(map(len, lines)) / max(len(lines), 1))
    out["distinct_lines"] = len(set(lines)) / max(len(lines), 1)
    return out


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("abC 9.\n\t#é漢")), max_size=60)), min_size=1, max_size=6))
def test_statistics(texts):
    got = quality.statistics(pa.array(texts, pa.string()))
    for row, text in zip(got, texts, strict=True):
        want = plain(text)
        assert np.allclose(row, [want[c] for c in quality.STATS], atol=1e-6), dict(zip(quality.STATS, row, strict=True))


def walk(trees, row):
    total = trees.base
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
        total += leaf[node - len(feature)]
    return total


def test_traversal_and_fit():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    trees = quality.grow(x, y, quality.Boosting(trees=20, depth=3))
    fresh = rng.normal(size=(300, 6))
    assert np.allclose(trees.raw(fresh), [walk(trees, r) for r in fresh])
    right = (trees.score(fresh) > 0.5) == ((fresh[:, 0] > 0.3) ^ (fresh[:, 3] < -0.2))
    assert right.mean() > 0.9

"""Integer product codes against whole-number brute force."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from quern.llm import codes, queries

INF, NAN = float("inf"), float("nan")


def exact(x, book):
    gap = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, c)) for c in book] for r in x]
    return [min(range(len(g)), key=lambda i: (g[i], i)) for g in gap], [min(g) for g in gap]


@pytest.mark.parametrize("size", [3, 2000, 1 << 20, (1 << 28) - 1])
@pytest.mark.parametrize("width", [1, 4, 16])
def test_nearest_is_exact(size, width):
    rng = np.random.default_rng(size + width)
    book = rng.integers(-size, size, (40, width), endpoint=True)
    book[7] = book[3]
    x = rng.integers(-size, size, (60, width), endpoint=True)
    x[5], x[6] = book[7], (book[1] + book[2]) // 2
    code, error = codes.nearest(x, book)
    assert (list(code), list(error)) == exact(x, book)


def test_close_entries_that_float32_cant_tell_apart():
    base = np.full((1, 16), 200_000_000, np.int64)
    book = np.concatenate([base + 3, base + 2, base - 2, base + 1, base - 1])
    assert codes.nearest(base, book)[0].tolist() == [3]


def brute(rows, p):
    """rows of (vec_id, vector, label), each to be kept -> codes, errors and the digest."""
    whole = [[math.floor(p.scale * float(v)) for v in x] for _, x, _ in rows]
    width = len(whole[0]) // p.parts
    cut = [[w[i * width : (i + 1) * width] for w in whole] for i in range(p.parts)]
    first = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][1]))[: p.entries]
    books = [[list(cut[i][k]) for k in first] for i in range(p.parts)]
    for step in range(p.rounds + 1):
        found = [exact(c, b) for c, b in zip(cut, books)]
        if step < p.rounds:
            for i, (code, _) in enumerate(found):
                for e in set(code):
                    own = [cut[i][k] for k in range(len(rows)) if code[k] == e]
                    books[i][e] = [sum(c) // len(own) for c in zip(*own)]
    text = ",".join(str(v) for b in books for e in b for v in e)
    return [[f[0][k] for f in found] for k in range(len(rows))], [sum(f[1][k] for f in found) for k in range(len(rows))], hashlib.sha256(text.encode()).hexdigest()


def test_compress_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(v) for v in rng.normal(0, 2, 8)], int(i % 3) if i % 4 else None) for i in range(120)]
    good += [good[7], (7, good[9][1], 1), (500, [0.0] * 8, None), (501, [-0.0005] * 8, 2), (502, good[3][1], 2), (503, [200_000.0] * 8, 2)]
    bad = [(600, None, 1), (601, [1.0] * 7 + [None], 1), (602, [1.0] * 7 + [NAN], 1), (603, [1.0] * 7 + [-INF], 1), (604, [], 1), (605, [1.0] * 12, 1), (606, [1e30] * 8, 1)]
    p = codes.Codes(entries=16)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in good + bad], "vec_id long, embedding array<double>, label int, codes string, error string").repartition(5)
    got = sorted(codes.compress(df, p).collect(), key=lambda r: (r["vec_id"], r["codes"], r["error"]))
    code, error, digest = brute(good, p)
    want = sorted(zip([r[0] for r in good], code, error, [r[2] for r in good]))
    assert [(r["vec_id"], r["codes"], r["error"]) for r in got] == [w[:3] for w in want]
    by = {}
    for _, _, e, label in want:
        by[label] = by.get(label, 0) + e
    assert all(r["label_error"] == by[r["label"]] and r["codebooks_sha256"] == digest for r in got)


def test_nothing_and_no_label(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert codes.compress(none).collect() == []
    one = spark.createDataFrame([(None, [1.0, 2.0, 3.0, 4.0])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["codes"], r["error"], r["label_error"]) for r in codes.compress(one).collect()] == [(None, [0, 0, 0, 0], 0, 0)]


def test_length_that_parts_dont_divide(spark):
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>"))


def test_query_equals_sql(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("needs the driver's tables")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    got = queries.op12_vector_codes(spark, data)
    want = db.execute(queries.OP12_SQL).df()
    rows = lambda df: sorted(df[["vec_id", "code", "error", "label_error", "codebooks_sha256"]].itertuples(index=False, name=None))
    assert rows(got.toPandas()) == rows(want) and len(want)

"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import itertools
import math
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quern.llm import ann, chat, components, gumbel, langid, lines, near_dup, packing, quality, queries, topk, toxicity

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


@pytest.fixture(scope="module")
def docs(spark):
    words = BASE.split()
    texts = [BASE, BASE, BASE.upper(), " ".join(words[:-1] + ["psi"]), None, "", "one", "one", " \t\n", "x " * 30_000, "solo words here only once now", BASE + "\n" + "solo words here only once now", "Wholly other text about nothing in particular at all."]
    rows = [(i, t, "en", "keep", "clash", "clash") for i, t in enumerate(texts)] + [(0, BASE, "en", "keep", "clash", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_shingles string, kept string, score string")


def brute(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, min(len(w), 1)))}
    at = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sorted(sets), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                at[a] = at[b] = min(at[a], at[b])
    return sets, at


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, docs, size):
    got = near_dup.near_duplicates(docs, near_dup.NearDup(shingle=size)).collect()
    sets, at = brute([(r["doc_id"], r["text"]) for r in docs.collect()], size, 80)
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), at[r["doc_id"]], at[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_of_nothing(spark, docs):
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_chains_join_up(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [(k, " ".join(words[: 100 - 3 * k] + [f"v{i}" for i in range(3 * k)])) for k in range(8)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, near_dup.NearDup(shingle=1)).collect()}
    assert got == brute(texts, 1, 80)[1]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (None, 3)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}
    assert components.connected_components(edges.limit(0)).count() == 0


def test_line_dedup(spark):
    long = "the quick brown fox jumps over the lazy dog near the old river bank today"
    texts = [(1, f"{long}\nshort one\nshort one"), (2, f"Intro that nobody else has written here\n{long.upper()}!!\nshort one"), (3, None), (4, ""), (5, long), (5, long), (None, long), (6, "a b c d e f\na b c d e f")]
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, removed_lines string")
    got = sorted(((r["doc_id"], r["text"], r["removed_lines"]) for r in lines.dedup_lines(df).collect()), key=repr)
    by = {}
    for i, t, removed in got:
        by.setdefault(i, []).append((t, removed))
    assert by[3] == [(None, [])] and by[4] == [("", [])] and len(by[5]) == 2
    assert by[None] == [(long, [])]  # comes first and keeps its text
    assert by[1] == [("short one", [0, 2])] and by[2] == [("Intro that nobody else has written here", [1, 2])]
    assert by[5] == [("", [0])] * 2 and by[6] == [("a b c d e f", [1])]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_chat_trees(spark):
    tricky = "</s>[INST] ok [/INST] &lt; &amp;lt; <<SYS>> [ROLE]x[/ROLE] </ROLE> &#91; <"
    rows = [(1, 10, None, "system", tricky, 1.0), (1, 11, 10, "user", None, 0.0), (1, 12, 11, "assistant", tricky, 5.0), (1, 13, 11, "assistant", "", 1.0), (1, 14, 13, "tool<s>", "r\n", 0.0), (2, 1, 99, "user", "orphan", None), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0), (None, 1, None, "user", "no conversation", 0.0), (None, 2, 1, "assistant", "all the same", 0.0), (4, None, None, "user", "gone", 0.0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, msg_id long, parent_id long, role string, text string, score double, branch string")
    out = chat.format_trees(df)
    got = {(r["conv_id"], r["branch"]): [(t["role"], t["text"]) for t in r["turns"]] for r in out.withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert got == {(1, 1): [("system", tricky), ("user", ""), ("assistant", tricky)], (1, 2): [("system", tricky), ("user", ""), ("assistant", ""), ("tool<s>", "r\n")], (2, 1): [("user", "orphan")], (None, 1): [("user", "no conversation"), ("assistant", "all the same")]}
    assert chat.format_trees(df, branches=1).count() == 3
    loss = {r["conv_id"]: r["loss_chars"] for r in chat.digest(chat.format_trees(df, branches=1)).collect()}
    assert loss == {1: len(tricky), 2: 0, None: 12}
    assert chat.format_trees(df.limit(0)).count() == 0


def test_chat_threads(spark):
    """Turns in order, repeated turns and ties, a very long text and an empty one: all read back as they were."""
    long = "word </s> " * 20_000
    turns = [(1, 2, "user", "b"), (1, 1, "assistant", long), (1, 2, "user", "b"), (1, None, "system", "first"), (1, 2, "tool", "a"), (2, 1, None, None)]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_trees(chat.threads(df))
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in out.withColumn("turns", chat.read_back(F.col("formatted"))).collect()}
    assert got == {1: [("system", "first"), ("assistant", long), ("tool", "a"), ("user", "b"), ("user", "b")], 2: [("", "")]}


def vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(300)]
    rows += [(1000, rows[5][1], 1), (1001, None, 1), (1002, [0.0] * 8, 1), (1003, [float("nan")] * 8, 1), (1004, [None] * 8, 1), (1005, [1.0] * 3, 1), rows[0]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), {i: np.array(v) for i, v, _ in rows if v and None not in v and len(v) == 8 and np.isfinite(v).all()}


def test_exact_top_k(spark):
    df, x = vectors(spark)
    ints = {i: np.floor(1024 * v).astype(int) for i, v in x.items()}
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_products(df, F.col("vec_id") % 100 == 0, topk.SortedLists(index_rows=90, query_rows=2)).collect()]
    want = []
    for q in (i for i in ints if i % 100 == 0):
        best = sorted(((-int(ints[q] @ v), i) for i, v in ints.items() if i != q))[:10]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert sorted(got) == sorted(want)
    assert topk.top_products(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_products_of_odd_vectors(spark):
    """Ties, huge components, several dimensions and more rows than resolve: the exact answer by whole numbers."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 6) / 1024], "x") for i in range(400)]
    rows += [(1000 + i, [float(v * 10.0 ** rng.integers(0, 17)) for v in rng.normal(size=3)], "x") for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, size string")
    p = topk.SortedLists(index_rows=64, query_rows=3, resolve=12, steps=7)
    got = {}
    for r in topk.top_products(df, F.col("vec_id") % 50 == 0, p).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    most = 2**63 - 1
    ints = {i: [max(-most - 1, min(most, math.floor(1024 * x))) for x in v] for i, v, _ in rows}
    for q in (i for i in ints if i % 50 == 0):
        scores = [(-max(-most - 1, min(most, sum(a * b for a, b in zip(ints[q], v, strict=True)))), i) for i, v in ints.items() if i != q and len(v) == len(ints[q])]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(sorted(scores)[:10], 1)]


def test_bounds_stop_reading_early():
    """With a mark carried over, lists are not read to their ends, and every row that reaches the mark is left."""
    rng = np.random.default_rng(9)
    rows = rng.integers(-1000, 1000, (4_000, 32))
    block, p = topk.Lists(rows), topk.SortedLists(resolve=64)
    for k in range(5):
        score = rows @ rows[k]
        score[k] = score.min()
        mark = float(np.sort(score)[-10])
        some, depth = topk.nra(block, rows[k], k, mark, p)
        assert set(np.flatnonzero(score >= mark)) <= set(some) and depth < 0.9 * len(rows)
        some, _ = topk.nra(block, rows[k], k, -np.inf, p)
        assert set(np.flatnonzero(score >= mark)) <= set(some)


def test_nearest(spark):
    df, x = vectors(spark)
    x = {i: v for i, v in x.items() if v.any()}
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, F.col("vec_id") % 100 == 0, ann.Additive(codebooks=8, words=32, candidates=20)).collect()]
    got = [g for g in got if g[0] in x]
    assert {q for q, *_ in got} == {i for i in x if i % 100 == 0}
    for q, _, i, s in got:
        assert abs(s - np.linalg.norm(x[q] - x[i])) < 1e-9 and i != q
    hits = sum(i in {j for _, j in sorted((np.linalg.norm(x[q] - v), j) for j, v in x.items() if j != q)[:10]} for q, _, i, _ in got)
    assert hits / len(got) >= 0.9
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


def test_packing(spark, docs):
    rows = packing.pieces(docs, BPE, size=64)
    out = packing.pack(rows, size=64).collect()
    assert len(out) == rows.count()
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(places)) and sum(n for _, n in places) <= 64
    assert sorted(r["length"] for r in out if r["doc_id"] in (4, 5)) == [1, 1]
    assert packing.pack(rows.limit(0), size=64).count() == 0


def test_packing_of_whole_texts(spark):
    """Pieces of real texts against the tokenizer itself: starts, lengths and digests; and the number of sequences against the least possible."""
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.isfile(path):
        pytest.skip("needs the driver's tables")
    from tokenizers import Tokenizer

    table = spark.read.parquet(path)
    size = 512
    rows = packing.pieces(table, BPE, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, size=size)
    out = packing.pack(rows, size=size).collect()
    tokenizer = Tokenizer.from_file(BPE)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    total = 0
    for doc_id, text in table.select("doc_id", "text").toPandas().itertuples(index=False):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        own = sorted(by[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and own[0]["start"] == 0
        for r, end in zip(own, [*[r["start"] for r in own[1:]], len(ids)], strict=True):
            part = ids[r["start"] : end]
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            assert len(part) == size or r["piece"] == 0 or r["piece"] == len(own) - 1
    least = -(-total // size)
    assert len({r["sequence_id"] for r in out}) <= least + 2


def test_language_id(spark, docs):
    train = spark.createDataFrame([(i, t, lang) for i in range(20) for t, lang in (("the house and the river of this land", "en"), ("la maison et la rivière de ce pays", "fr"))], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(1, "the river", 0.5), (2, "la rivière", 0.5), (3, None, 0.5), (4, "12 !", 0.5), (4, "12 !", 0.5)], "doc_id long, text string, score double")
    p = langid.LangId(PIECES)
    got = sorted((r["doc_id"], r["lang_pred"]) for r in langid.identify(asked, train, p).collect())
    assert got == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (4, "und")]
    assert {r["lang_pred"] for r in langid.identify(asked, train.limit(0), p).collect()} == {"und"}
    assert langid.identify(asked.limit(0), train, p).count() == 0


def test_classifiers(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 2), int(i % 3 == 0), "x") for i in range(400)] + [(1, None, None, "x")], "doc_id long, quality int, toxic int, text string")
    texts = spark.createDataFrame([(i, ("fine plain words in a row" if i % 2 else "###!! $$ %%%") + (" idiot" if i % 3 == 0 else " friend")) for i in range(400)], "doc_id long, text string")
    trees = quality.fit(texts, labels)
    got = {r["doc_id"]: r["score"] for r in quality.score(texts, trees).collect()}
    assert all((s > 0.5) == (i % 2 == 1) for i, s in got.items())
    model = toxicity.fit(texts.withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id").cast("string"), F.lit(" women"))), labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(texts, model).collect()}
    assert len(got) == 400 and all(0 <= s <= 1 for s in got.values())
    odd = quality.score(docs, quality.fit(docs.limit(0), labels)).collect()
    assert len(odd) == docs.count() and len(toxicity.score(docs, toxicity.fit(docs.limit(0), labels)).collect()) == docs.count()


def test_gumbel_operator(spark, docs):
    p = gumbel.Gumbel(PIECES, k=2)
    out = gumbel.decode_column(gumbel.encode_samples(docs, p), PIECES).collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["decoded"] == text[r["doc_id"]] for r in out)
    assert {r["doc_id"] for r in out} == set(text)
    again = gumbel.encode_samples(docs.where("doc_id = 3"), p).collect()
    assert {tuple(r["ids"]) for r in again} == {tuple(r["ids"]) for r in out if r["doc_id"] == 3}  # other rows don't matter
    assert gumbel.encode_samples(docs.limit(0), p).count() == 0


def test_folds_and_thresholds(spark):
    """The remainders of the queries' folds, null doc_ids, and rows at the threshold."""
    ids = [*range(40), None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    got = {r["doc_id"]: (r["a"], r["b"]) for r in df.select("doc_id", queries.remainder(5).alias("a"), queries.remainder(4).alias("b")).collect()}
    assert got == {i: (zlib.crc32(str(i).encode()) % 5, zlib.crc32(str(i).encode()) % 4) if i is not None else (-1, -1) for i in ids}


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    """A query learns nothing from labels of its own fold: turning them around leaves every score as it is."""
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("needs the driver's tables")
    labels = spark.read.parquet(f"{path}/labels.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    turned = labels.withColumn("quality", F.when(queries.remainder(5) == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(queries.remainder(4) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for fit, score, fold in ((quality.fit, quality.score, queries.remainder(5) != 0), (toxicity.fit, toxicity.score, queries.remainder(4) != 2)):
        one, two = ({r["doc_id"]: r["score"] for r in score(docs, fit(docs, some.where(fold))).collect()} for some in (labels, turned))
        assert one == two and len(set(one.values())) > 1
    out = queries.op6_quality_classifier(spark, path).collect()
    assert all(r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)


def test_rows_of_one_id_with_several_texts_keep_their_links(spark):
    words = [f"w{i}" for i in range(60)]
    a, b = " ".join(words), " ".join(f"v{i}" for i in range(60))
    texts = [(5, a), (5, b), (8, a + " x"), (9, b + " x"), (5, a)]
    got = near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(5, 5, True)] * 3 + [(8, 5, False), (9, 5, False)]
    assert len({r["text_hash"] for r in got}) == 4


def test_links_just_above_the_limit_are_found(spark):
    """Pairs of 0.80 to 0.82 by single words: a fifth of the shingles of 300 differ."""
    texts = []
    for k in range(60):
        words = [f"p{k}w{i}" for i in range(300)]
        other = list(words)
        for i in range(30):
            other[3 + i * 9] = f"q{k}x{i}"
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    p = near_dup.NearDup(shingle=1)
    sets, at = brute(texts, 1, 80)
    low = [len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(60)]
    assert all(0.8 <= x <= 0.82 for x in low)
    got = near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), p).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == at


@pytest.mark.parametrize("name", ["op3_minhash_near_dedup", "op5_chat_formatting", "op6_quality_classifier", "op8_best_fit_packing", "op9_toxicity", "op12_vector_codes"])
def test_queries_leave_their_result_only(spark, name):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("needs the driver's tables")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    assert queries.QUERIES[name](spark, data).count() > 0
    assert len([f for f in set(os.listdir(folder)) - before if f.startswith("quern-")]) == 1


def test_scratches_of_two_threads_are_apart(spark):
    import threading

    from quern.llm import shared

    ready, go, seen = threading.Event(), threading.Event(), []

    def other():
        with shared.scratch():
            df = shared.save(spark.range(3), "other")
            ready.set()
            go.wait(60)
            seen.append(df.count())

    t = threading.Thread(target=other)
    t.start()
    ready.wait(60)
    with shared.scratch():
        shared.save(spark.range(2), "own")
    go.set()
    t.join()
    assert seen == [3]

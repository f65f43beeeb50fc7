"""Byte-level BPE against the tokenizers library, and decoding."""

import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", " ", "  ", "\n\n a", "a" * 5000, "ab" * 4000 + "\U0001f600" * 300, "<|endoftext|>", "x <|endoftext|><|endoftext|> y <|endoftext", "it's we'LL I'd", "\u00a0\u3000\u200b \u2028x", "\x1c\x85\x00", "caf\u00e9 e\u0301 \u0e01\u0e33 \u4f60\u597d", "1234567890 " * 500, "\t\tif x:\r\n        y\r\n", "long words " * 30_000]


@pytest.fixture(scope="module")
def encoder():
    return bpe.BpeEncoder(PATH, public_tokenizers.PATTERN)


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sdtl<|endoftext>")), max_size=80))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_librarys(text):
    assert bpe._encoder(PATH, public_tokenizers.PATTERN).ids_of(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_stale_entries_are_skipped(encoder):
    assert encoder.vocabulary.merge(b"aaaaaaaaaaaaaaa") == LIBRARY.encode("a" * 15, add_special_tokens=False).ids


def test_round_trip_of_odd_texts(spark):
    rows = [(i, t, "clash", 7) for i, t in enumerate(ODD)] + [(3, ODD[3], "clash", 7), (None, "no id", None, None), (90, None, "clash", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    made = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
    got = sorted(bpe.decode(made, PATH).withColumn("numbers", bpe.ids_array(F.col("ids"))).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"]))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1] or ""))
    assert [(r["doc_id"], r["text"]) for r in got] == [(r[0], r[1] or "") for r in want]
    for r, w in zip(got, want, strict=True):
        assert r["numbers"] == LIBRARY.encode(w[1] or "", add_special_tokens=False).ids
        assert bytes(r["ids"]) == struct.pack(f"<{len(r['numbers'])}I", *r["numbers"])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digest(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH).count() == 0


def test_decoding_what_no_text_gives(spark):
    half = LIBRARY.encode("\u4f60", add_special_tokens=False).ids[:1]
    lists = [half, [50256], [60_000, 5], []]
    rows = spark.createDataFrame([(i, bytearray(struct.pack(f"<{len(x)}I", *x))) for i, x in enumerate(lists)] + [(9, None)], "doc_id long, ids binary")
    got = {r["doc_id"]: r["text"] for r in bpe.decode(rows, PATH).collect()}
    want = {i: LIBRARY.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)}
    assert got == {**want, 9: ""}


def test_query_is_the_librarys_on_every_document(spark):
    data = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = queries.op11_bpe(spark, data).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())

"""Byte-level BPE by a priority queue of merge ranks over a doubly linked list of symbols, and decoding.

A text is cut at the strings of added tokens, then by the pre-tokeniser's pattern. A piece begins as one symbol a byte,
each linked to its neighbours; the queue holds the merges that neighbours offer, lowest rank first, then leftmost. An
entry whose symbols have since changed is stale and skipped, so a piece of n bytes takes about n log n steps, however
long. Texts are cut into chunks that are pieces in a row, and each distinct chunk of a slice is encoded once.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import textkit
from quern.llm.shared import ready
from quern.llm.tokens import Encoder

#: Pieces that a worker remembers beside whole chunks, of at most so many bytes each; a full memory is emptied.
PIECES, PIECE_BYTES = 200_000, 64


def _letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable Latin-1, else one from 256 up."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


class Vocabulary:
    """Merges, ids and strings of a byte-level BPE file.

    Added tokens must be plain strings: ones that strip spaces or match whole words only are refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, letters = held["model"], _letters()
        if model.get("ignore_merges") or held.get("normalizer") or (held.get("pre_tokenizer") or {}).get("add_prefix_space"):
            raise ValueError("only plain byte-level vocabularies")
        spelt = lambda s: bytes(letters[c] for c in s) if all(c in letters for c in s) else s.encode()
        ids = model["vocab"]
        self.strings = {i: spelt(s) for s, i in ids.items()}
        self.single = [ids.get(c) for c in sorted(letters, key=letters.get)]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[ids[left], ids[right]] = (rank, ids[left + right])
        self.added = {t["content"]: t["id"] for t in held.get("added_tokens", [])}
        if any(t.get(k) for t in held.get("added_tokens", []) for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens must be plain strings")
        self.strings.update({i: s.encode() for s, i in self.added.items()})

    def merge(self, piece: bytes) -> list[int]:
        """ids of one piece of the pre-tokeniser. Bytes that the vocabulary hasn't got are left out."""
        ids = [i for b in piece if (i := self.single[b]) is not None]
        n, pairs = len(ids), self.pairs
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(found[0], at, found[1]) for at in range(n - 1) if (found := pairs.get((ids[at], ids[at + 1])))]
        heapq.heapify(queue)
        while queue:
            _, at, made = heapq.heappop(queue)
            right = after[at]
            if ids[at] < 0 or right < 0 or pairs.get((ids[at], ids[right]), (0, -1))[1] != made:
                continue  # stale
            ids[at], ids[right] = made, -1
            after[at] = beyond = after[right]
            if beyond >= 0:
                before[beyond] = at
                if found := pairs.get((made, ids[beyond])):
                    heapq.heappush(queue, (found[0], at, found[1]))
            if (left := before[at]) >= 0 and (found := pairs.get((ids[left], made))):
                heapq.heappush(queue, (found[0], left, found[1]))
        return [i for i in ids if i >= 0]


class BpeEncoder(Encoder):
    """Encoder whose new chunks go through Vocabulary.merge."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        self.pattern = regex.compile(pattern)
        added = sorted(self.vocabulary.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self.pieces: dict[str, list[int]] = {}
        self._forget()

    def ids_of(self, text: str) -> list[int]:
        out: list[int] = []
        added = self.vocabulary.added
        for part in self.cut.split(text) if self.cut else [text]:
            if part in added:
                out.append(added[part])
                continue
            for piece in self.pattern.findall(part):
                if (ids := self.pieces.get(piece)) is None:
                    ids = self.vocabulary.merge(piece.encode())
                    if len(piece) <= PIECE_BYTES:
                        if len(self.pieces) >= PIECES:
                            self.pieces.clear()
                        self.pieces[piece] = ids
                out += ids
        return out

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lists = [self.ids_of(data[a:b].tobytes().decode()) for a, b in zip(starts, ends, strict=True)]
        at = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=at[1:])
        return np.array([i for x in lists for i in x], np.uint32), at


class Strings:
    """Bytes of a vocabulary's strings, one after another, by id; ids without one are empty."""

    def __init__(self, path: str):
        strings = Vocabulary(path).strings
        size = np.zeros(max(strings, default=0) + 2, np.int64)
        for i, s in strings.items():
            size[i] = len(s)
        self.at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=self.at[1:])
        self.data = np.frombuffer(b"".join(strings[i] for i in sorted(strings)), np.uint8)

    def join(self, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strings of all ids in a row, and where each row's begin, given where each row's ids begin."""
        known = np.where((ids >= 0) & (ids < len(self.at) - 1), ids, len(self.at) - 2)
        data, at = textkit.gather(self.data, self.at[known], self.at[known + 1])
        return data, at[rows]


@cache
def _encoder(path: str, pattern: str) -> BpeEncoder:
    return BpeEncoder(path, pattern)


@cache
def _strings(path: str) -> Strings:
    return Strings(path)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, ids): the ids of each row's whole text, binary, four little-endian bytes an id.

    Same ids as the tokenizers library's with add_special_tokens=False, without truncation and padding; strings of added
    tokens in a text are those tokens. Null text is empty; an empty text has no ids. Each row gives one row, repeated and
    null doc_ids too. Only doc_id and text are read, so other columns can't clash. ids_array() gives the ids as numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, pattern)
        for batch in batches:
            for part in textkit.slices(batch):
                ids, at = enc.encode(part.column("text"))
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), packed.cast(pa.binary())], names=["doc_id", "ids"])

    ready(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows (doc_id, ids as encode() gives them, ...) -> (doc_id, ids, text): the vocabulary's strings in a row, special ones too.

    Bytes that are not UTF-8 become U+FFFD, as the library writes them. ids without a string are left out; null or empty
    ids give an empty text; a number of bytes that no ids fill is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = _strings(path)
        for batch in batches:
            for part in textkit.slices(batch, "ids"):
                raw, at = textkit.text_bytes(part.column("ids"))
                if (at % 4).any():
                    raise ValueError("ids are four bytes each")
                data, at = strings.join(np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), at // 4)
                text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
                try:
                    text = text.cast(pa.large_string()).cast(pa.string())
                except pa.ArrowInvalid:
                    text = pa.array([x.decode("utf-8", "replace") for x in text.to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), text], names=["doc_id", "ids", "text"])

    ready(rows.sparkSession)
    rows = rows.select("doc_id", F.col("ids").cast("binary").alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def ids_array(ids: Column) -> Column:
    """ids of encode() as array<bigint>, for readers that want numbers."""
    number = lambda k: F.concat(*[F.hex(F.substring(ids, k * 4 + at, F.lit(1))) for at in (4, 3, 2, 1)])
    places = F.sequence(F.lit(0), (F.length(ids) / 4).cast("int") - 1)
    return F.when(F.length(ids) > 0, F.transform(places, lambda k: F.conv(number(k), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def digest(encoded: DataFrame, path: str) -> DataFrame:
    """encode()'s rows -> (doc_id, n_tokens, ids_sha256, decoded_sha256), the last of the text that decode() gives."""
    both = decode(encoded, path)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))

"""Byte-level BPE ids of whole texts, encoding each distinct chunk of a slice once.

A text is cut before each single space or line feed that stands between two plain characters. The pre-tokeniser's
pattern always begins a match there and never looks back, so the ids of a text are those of its chunks in a row.
"""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np
import pyarrow as pa

from quern.llm import textkit
from quern.llm.textkit import U

#: Chunks a worker remembers between slices: about 60 MB at most. A full memory is emptied, never trusted to grow.
REMEMBERED = 1_000_000


class Encoder:
    """ids by `tokenizers` from a byte-level BPE file, with add_special_tokens=False.

    `ranks` may name the same vocabulary in tiktoken's form, which encodes the same ids faster; strings of special
    tokens inside a text, which the two treat differently, always go to `tokenizers`.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()] if hasattr(self.slow, "get_added_tokens_decoder") else []
        self.special_re = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.fast = None
        if ranks and pattern:
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=known, special_tokens={})
            self.size = np.zeros(max(known.values()) + 1, np.int64)
            for token, i in known.items():
                self.size[i] = len(token)
        self._forget()

    def _forget(self):
        self.hashes = np.zeros(0, U)
        self.at = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of chunks, one after another, and where each chunk's begin (one more at the end)."""
        joined, at = textkit.gather(data, starts, ends)
        text = joined.tobytes().decode()
        # A first chunk of a text has no space before it; put after another chunk, it might join it.
        alone = (data[starts] != 32) & (data[starts] != 10) if len(starts) else np.zeros(0, bool)
        if self.fast is not None and not alone[1:].any() and not (self.special_re and self.special_re.search(text)):
            ids = np.array(self.fast.encode_ordinary(text), np.int64)
            reach = np.cumsum(self.size[ids])
            return ids.astype(np.uint32), np.searchsorted(reach, at, "right") if len(ids) else np.zeros(len(at), np.int64)
        raw = joined.tobytes()
        chunks = [raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)]
        if self.fast is not None:
            lists = [self.fast.encode_ordinary(c) if not (self.special_re and self.special_re.search(c)) else self.slow.encode(c, add_special_tokens=False).ids for c in chunks]
        else:
            lists = [e.ids for e in self.slow.encode_batch_fast(chunks, add_special_tokens=False)]
        out = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=out[1:])
        return np.array([i for x in lists for i in x], np.uint32), out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of a column of texts, one row after another, and where each row's begin (one more at the end)."""
        data, offsets = textkit.text_bytes(column)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = (data == 32) | (data == 10)
        cut[0] = False
        cut[-1] = False
        where = np.flatnonzero(cut)
        # A plain neighbour is no white space in any encoding: printable ASCII, or outside the blocks that hold wide spaces.
        before, after = data[where - 1], data[where + 1]
        lead2, lead3 = data[np.maximum(where - 2, 0)], data[np.maximum(where - 3, 0)]
        wide = lambda b: (b == 0xC2) | ((b >= 0xE1) & (b <= 0xE3))
        plain = (before > 32) & (before != 127) & ~((before >= 0x80) & (wide(lead2) | wide(lead3)))
        where = where[plain & (after > 32) & (after != 127) & ~wide(after)]
        cut[:] = False
        cut[where] = True
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        rows = textkit.rows_of(starts, offsets)
        hashes = textkit.span_hash(textkit.prefix(data), starts, ends)
        kinds, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, kinds)
        known = np.zeros(len(kinds), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == kinds[inside]
        new = np.flatnonzero(~known)
        if len(new):
            begin = np.isin(data[starts[first[new]]], (32, 10))
            parts = []
            for some in (new[begin], new[~begin]):
                if len(some):
                    ids, at = self._encode(data, starts[first[some]], ends[first[some]])
                    parts.append((kinds[some], np.diff(at), ids))
            self._remember(parts)
            place = np.searchsorted(self.hashes, kinds)
        size = np.diff(self.at)[place][back]
        out = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=out[1:])
        ids = self.ids[np.repeat(self.at[place][back] - out[:-1], size) + np.arange(out[-1])]
        total = np.bincount(rows, weights=size, minlength=len(offsets) - 1).astype(np.int64)
        at = np.zeros(len(offsets), np.int64)
        np.cumsum(total, out=at[1:])
        if len(self.hashes) > REMEMBERED:
            self._forget()
        return ids, at

    def _remember(self, parts: list) -> None:
        hashes = np.concatenate([self.hashes, *[p[0] for p in parts]])
        size = np.concatenate([np.diff(self.at), *[p[1] for p in parts]])
        ids = np.concatenate([self.ids, *[p[2] for p in parts]])
        begins = np.cumsum(size) - size
        order = np.argsort(hashes, kind="stable")
        self.hashes, size = hashes[order], size[order]
        self.at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=self.at[1:])
        self.ids = ids[np.repeat(begins[order] - self.at[:-1], size) + np.arange(self.at[-1])]


@cache
def encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path, ranks, pattern)

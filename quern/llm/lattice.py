"""Lattices of all segmentations of text units into the pieces of a fixed public vocabulary.

A text with a space put before it is cut before each space that follows another character. No piece of the vocabulary
crosses such a cut, so the segmentations of a text are all combinations of those of its units, and work is done once
for each distinct unit of a slice. Nodes are byte places; a character that no piece covers alone gets byte pieces.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from quern.llm import textkit
from quern.llm.textkit import U

_SPACE_PIECE = "▁"
_FILTER = 1 << 22


class Vocabulary:
    """Pieces of a SentencePiece file as byte strings, with the space mark as a space; special pieces are left out."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.byte_id = np.full(256, -1, np.int64)
        pieces: list[bytes] = []
        ids: list[int] = []
        self.text: list[bytes] = [b""] * self.size
        for i in range(self.size):
            if model.is_byte(i):
                byte = int(model.id_to_piece(i)[1:-1], 16)
                self.byte_id[byte] = i
                self.text[i] = bytes([byte])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i).replace(_SPACE_PIECE, " ").encode()
                assert b" " not in piece.lstrip(b" "), "a piece crosses units"
                self.text[i] = piece
                pieces.append(piece)
                ids.append(i)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        at = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=at[1:])
        hashes = textkit.span_hash(textkit.prefix(data), at[:-1], at[1:])
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(ids, np.int64)[order]
        assert len(np.unique(hashes)) == len(pieces)
        self.seen = np.zeros(_FILTER, bool)
        self.seen[(hashes & U(_FILTER - 1)).astype(np.int64)] = True
        self.lengths = sorted({len(p) for p in pieces})
        self.single = {len(p) for p in pieces if len(p.decode()) == 1}


@cache
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary for each Python worker."""
    return Vocabulary(path)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts, each with a space put before it, cut into units: the new bytes, starts, ends and rows. Empty texts have none."""
    size = np.diff(offsets)
    full = np.flatnonzero(size)
    out = np.insert(data, offsets[:-1][full], 32)
    begin = offsets[:-1][full] + np.arange(len(full))
    if not len(out):
        return out, *(np.zeros(0, np.int64),) * 3
    space = out == 32
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[begin] = True
    starts = np.flatnonzero(cut)
    rows = full[np.searchsorted(begin, starts, "right") - 1]
    return out, starts, np.append(starts[1:], len(out)), rows


class Lattice:
    """Edges of all segmentations of distinct units.

    Nodes are numbered unit by unit, one for each byte place and one for the end.
    """

    def __init__(self, vocab: Vocabulary, data: np.ndarray, at: np.ndarray):
        n = len(at) - 1
        size = np.diff(at)
        self.first = at[:-1] + np.arange(n)  # a unit's first node
        self.last = self.first + size
        self.nodes = int(at[-1] + n)
        owner = np.repeat(np.arange(n), size)
        room = at[1:][owner] - np.arange(len(data))
        sums = textkit.prefix(data)
        begins, ends, pieces = [], [], []
        covered = np.zeros(len(data), bool)
        width = 1 + (data >= 0xC0).astype(np.int64) + (data >= 0xE0) + (data >= 0xF0)
        lead = (data & 0xC0) != 0x80
        where = np.flatnonzero(lead)
        for length in vocab.lengths:
            where = where[room[where] >= length]
            if not len(where):
                break
            h = textkit.span_hash(sums, where, where + length)
            maybe = np.flatnonzero(vocab.seen[(h & U(_FILTER - 1)).astype(np.int64)])
            place = np.searchsorted(vocab.hashes, h[maybe])
            place[place == len(vocab.hashes)] = 0
            hit = vocab.hashes[place] == h[maybe]
            got = where[maybe[hit]]
            begins.append(got)
            ends.append(got + length)
            pieces.append(vocab.ids[place[hit]])
            covered[got[width[got] == length]] = True
        # Characters without a piece: each of their bytes is an edge.
        bare = np.flatnonzero(lead & ~covered)
        bare = np.unique(np.concatenate([bare + k for k in range(4)] + [np.zeros(0, np.int64)]) if not len(bare) else np.concatenate([bare[width[bare] > k] + k for k in range(4)]))
        bare = bare[bare < len(data)]
        begins.append(bare)
        ends.append(bare + 1)
        pieces.append(vocab.byte_id[data[bare]] if len(bare) else np.zeros(0, np.int64))
        self.groups = np.cumsum([0, *map(len, begins)])
        begin, end, self.piece = np.concatenate(begins), np.concatenate(ends), np.concatenate(pieces)
        unit = owner[begin] if len(begin) else begin
        self.start, self.end = begin + unit, end + unit
        place = end - at[unit] if len(begin) else end
        self.unit, self.place, self.sorted = unit, place, False
        self.longest = int(size.max()) if n else 0
        self.back = None

    def _sort(self) -> None:
        """Edges by the place where they end, so that a sweep visits each node after all that lead to it."""
        order = np.argsort(self.place * np.int64(self.nodes + 1) + self.end)
        self.start, self.end, self.piece, self.unit, self.place = self.start[order], self.end[order], self.piece[order], self.unit[order], self.place[order]
        self.steps = np.searchsorted(self.place, np.arange(1, self.longest + 2))
        self.sorted, self.back, self.groups = True, None, None

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log probability of all ways from a unit's start to each node; logp has a row for each piece id."""
        if not self.sorted:
            self._sort()
        a = np.full((self.nodes, logp.shape[1]), -np.inf)
        a[self.first] = 0
        for i, j in zip(self.steps[:-1], self.steps[1:], strict=True):
            if i < j:
                end = self.end[i:j]
                at = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
                a[end[at]] = np.logaddexp.reduceat(a[self.start[i:j]] + logp[self.piece[i:j]], at, axis=0)
        return a

    def _backward_order(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges by how far their start is from the unit's end, nearest first, and where each distance begins."""
        if self.back is None:
            far = self.last[self.unit] - self.start
            order = np.argsort(far * np.int64(self.nodes + 1) + self.start)
            self.back = order, np.searchsorted(far[order], np.arange(1, (int(far.max()) if len(far) else 0) + 2))
        return self.back

    def backward(self, logp: np.ndarray) -> np.ndarray:
        """Log probability of all ways from each node to its unit's end."""
        b = np.full((self.nodes, logp.shape[1]), -np.inf)
        b[self.last] = 0
        order, steps = self._backward_order()
        for i, j in zip(steps[:-1], steps[1:], strict=True):
            if i < j:
                e = order[i:j]
                start = self.start[e]
                at = np.flatnonzero(np.append(True, start[1:] != start[:-1]))
                b[start[at]] = np.logaddexp.reduceat(b[self.end[e]] + logp[self.piece[e]], at, axis=0)
        return b


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct spans: their hashes, bytes one after another, where each begins, and each span's number among them."""
    hashes = textkit.span_hash(textkit.prefix(data), starts, ends)
    kinds, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    joined, at = textkit.gather(data, starts[first], ends[first])
    return kinds, joined, at, back

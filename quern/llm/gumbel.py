"""SentencePiece encoding by Gumbel top-k without replacement, and decoding.

All segmentations of a text form a tree of choices. Suffix sums make every subtree's mass known, so a perturbed A-star
search pops subtrees by their largest perturbed log probability: the k segmentations with the greatest perturbed values
come out in order, distinct, as k draws without replacement. Random numbers are hashes of the row's key, the draw and the
place, so a row's result does not depend on its batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textkit
from quern.llm.lattice import Lattice, Vocabulary, units, vocabulary
from quern.llm.shared import ready
from quern.llm.textkit import U, mix

_GONE = -np.inf
#: A subtree of smaller log mass is below the least positive double and never reached.
_LEAST = -745.0


@dataclass(frozen=True)
class Gumbel:
    """k: segmentations of a row. seed: changes all draws. power: piece probability falls with this power of its rank, as the file has merge ranks and no probabilities."""

    vocabulary: str
    k: int = 3
    seed: int = 0
    power: float = 1.0


def piece_logp(vocab: Vocabulary, power: float) -> np.ndarray:
    """Zipf log probabilities of pieces by their place in the file; byte pieces are a hundred times rarer than the last."""
    logp = np.full(vocab.size, -power * np.log(vocab.size + 2.0) - np.log(100))
    ids = np.sort(vocab.ids)
    logp[ids] = -power * np.log(np.arange(len(ids)) + 2.0)
    return logp - np.log(np.exp(logp).sum())


def _uniform(key: np.ndarray, *parts) -> np.ndarray:
    """Numbers in (0, 1) from keys."""
    for p in parts:
        key = mix(key * U(0x9FB21C651E98DF25) + np.asarray(p).astype(U))
    return ((key >> U(11)).astype(float) + 0.5) * 2.0**-53


#: Units whose choices a worker remembers between slices (about 80 MB); a full memory is emptied.
REMEMBERED = 120_000


class Choices:
    """The choice of the next piece at each node of the lattices of all units met: edges by start, with log and summed probabilities."""

    def __init__(self, vocab: Vocabulary, logp: np.ndarray):
        self.vocab, self.prior = vocab, logp
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, U)
        self.home = self.last = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.start = self.end = self.piece = np.zeros(0, np.int32)
        self.logp, self.cum, self.others = np.zeros(0), np.zeros(0), np.zeros(0)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last node of each unit, after the new ones are added."""
        if len(self.hashes) > REMEMBERED:
            self._forget()
        hashes = textkit.span_hash(textkit.prefix(data), starts, ends)
        kinds, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, kinds)
        known = np.zeros(len(kinds), bool)
        inside = place < len(self.hashes)
        known[inside] = self.hashes[place[inside]] == kinds[inside]
        new = np.flatnonzero(~known)
        if len(new):
            self._add(kinds[new], *textkit.gather(data, starts[first[new]], ends[first[new]]))
            place = np.searchsorted(self.hashes, kinds)
        return self.home[place][back], self.last[place][back]

    def _add(self, kinds: np.ndarray, joined: np.ndarray, at: np.ndarray) -> None:
        lattice = Lattice(self.vocab, joined, at)
        first = np.zeros(lattice.nodes + 1, np.int64)
        np.cumsum(np.bincount(lattice.start, minlength=lattice.nodes), out=first[1:])
        rank = np.zeros(lattice.nodes, np.int64)
        to = np.zeros(len(lattice.start), np.int64)
        for i, j in zip(lattice.groups[:-1], lattice.groups[1:], strict=True):  # a group has one edge of a start at most
            own = lattice.start[i:j]
            to[i:j] = first[own] + rank[own]
            rank[own] += 1
        start, end, piece = (np.empty(len(to), np.int32) for _ in range(3))
        start[to], end[to], piece[to] = lattice.start, lattice.end, lattice.piece
        prior = self.prior[piece]
        back = np.full(lattice.nodes, _GONE)
        back[lattice.last] = 0
        far = lattice.last - lattice.first
        order = np.argsort(-far)
        ends, far = lattice.last[order], far[order]
        for t in range(1, int(far[0]) + 1 if len(far) else 1):  # nodes by their distance from the unit's end
            ends = ends[: np.searchsorted(-far, -t, "right")]
            node = ends - t
            node = node[first[node + 1] > first[node]]
            if len(node):
                edges, begin = _segments(first[node], first[node + 1])
                back[node] = np.logaddexp.reduceat(prior[edges] + back[end[edges]], begin[:-1])
        with np.errstate(invalid="ignore"):
            logp = prior + back[end] - back[start]
        logp[np.isnan(logp)] = _GONE
        total = np.concatenate([[0.0], np.cumsum(np.exp(logp))])
        cum = total[1:] - total[first[start]]
        cum[first[1:][first[1:] > first[:-1]] - 1] = np.inf
        beside, begin = _segments(first[start], first[start.astype(np.int64) + 1])
        share = np.exp(logp[beside])
        share[begin[:-1] + np.arange(len(start)) - first[start]] = 0  # an edge isn't beside itself
        with np.errstate(divide="ignore"):
            others = np.log(np.add.reduceat(share, begin[:-1])) if len(start) else np.zeros(0)
        nodes, edges = len(self.first) - 1, len(self.end)
        self.others = np.concatenate([self.others, others])
        self.first = np.concatenate([self.first, first[1:] + edges])
        self.start, self.end = np.concatenate([self.start, start + np.int32(nodes)]), np.concatenate([self.end, end + np.int32(nodes)])
        self.piece, self.logp, self.cum = np.concatenate([self.piece, piece]), np.concatenate([self.logp, logp]), np.concatenate([self.cum, cum])
        self.hashes, self.home, self.last = np.concatenate([self.hashes, kinds]), np.concatenate([self.home, lattice.first + nodes]), np.concatenate([self.last, lattice.last + nodes])
        order = np.argsort(self.hashes)
        self.hashes, self.home, self.last = self.hashes[order], self.home[order], self.last[order]

    def walk(self, node: np.ndarray, last: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Random edges from each node to its last, one walk after another: which walk, and edge."""
        active = np.flatnonzero(node != last)
        node = node.copy()
        size = np.zeros(len(node), np.int64)
        taken = []
        while len(active):
            edge = self.first[node[active]]
            draw = _uniform(key[active], np.full(1, len(taken), np.int64))
            more = np.flatnonzero(draw > self.cum[edge])
            while len(more):
                edge[more] += 1
                more = more[draw[more] > self.cum[edge[more]]]
            taken.append((active, edge))
            size[active] += 1
            node[active] = to = self.end[edge]
            active = active[to != last[active]]
        begin = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=begin[1:])
        out = np.zeros(begin[-1], np.int64)
        for step, (walk, edge) in enumerate(taken):
            out[begin[walk] + step] = edge
        return np.repeat(np.arange(len(size)), size), out


def _segments(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes start..stop of each segment, one after another, and where each begins."""
    size = stop - start
    begin = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=begin[1:])
    return np.repeat(start - begin[:-1], size) + np.arange(begin[-1]), begin


def sample(column: pa.Array, keys: np.ndarray, choices: Choices, p: Gumbel) -> tuple[list[tuple], np.ndarray]:
    """For each draw (whether each row has it, edges' pieces, where each row's begin, log probability, perturbed value), and the next value of each row."""
    n = len(column)
    data, offsets = textkit.text_bytes(column)
    data, starts, ends, rows = units(data, offsets)
    home, last = choices.of(data, starts, ends) if len(starts) else (starts, starts)
    first_unit = np.searchsorted(rows, np.arange(n + 1))
    key = mix(keys.astype(np.int64).view(U) ^ mix(np.full(n, p.seed, np.int64).view(U)))
    unit_key = mix(key[rows] + (np.arange(len(rows)) - first_unit[rows]).astype(U)) if len(rows) else np.zeros(0, U)
    draws: list[dict] = []
    bound = -np.log(-np.log(_uniform(key, 1)))
    live = np.ones(n, bool)
    unit = np.zeros(n, np.int64)  # where each row's walk begins
    for r in range(p.k):
        if r == 0:
            some = np.arange(len(rows))
            walk, edge = choices.walk(home, last, unit_key)
            owner = rows[walk]
            begin = np.searchsorted(owner, np.arange(n + 1))
            path, where, from_at = edge, walk, np.zeros(n, np.int64)
        else:
            # Each row's best open subtree: which draw's path it leaves, and where.
            best, source, spot = np.full(n, _GONE), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, d in enumerate(draws):
                full = np.flatnonzero(np.diff(d["begin"]) > 0)
                if len(full):
                    top = np.full(n, _GONE)
                    top[full] = np.maximum.reduceat(d["open"], d["begin"][full])
                    better = np.flatnonzero(top > best)
                    best[better], source[better] = top[better], i
            live = best > _GONE
            bound = best
            go = np.flatnonzero(live)
            new = np.zeros(n, np.int64)
            spot_of = np.zeros(len(go), np.int64)
            for i, d in enumerate(draws):
                mine = np.flatnonzero(source[go] == i)
                if not len(mine):
                    continue
                own = go[mine]
                c = _first_max(d["open"], d["begin"][own], d["begin"][own + 1], best[own])
                spot_of[mine] = c - d["begin"][own]
                unit[own] = d["where"][c]
                lo, hi = choices.first[choices.start[d["path"][c]]], choices.first[choices.start[d["path"][c]] + 1]
                place = lo[:, None] + np.arange(int((hi - lo).max()))
                left = np.where(place < hi[:, None], np.exp(choices.logp[np.minimum(place, len(choices.logp) - 1)]), 0.0)
                left[np.arange(len(own)), d["path"][c] - lo] = 0
                for j in np.flatnonzero(d["popped"][c]):  # a place that was left before has more edges used up
                    left[j, [g - lo[j] for g in d["gone"][int(c[j])]]] = 0
                total = left.sum(1)
                draw = _uniform(key[own], 2, r) * total
                pick = np.minimum((left.cumsum(1) <= draw[:, None]).sum(1), left.shape[1] - 1)
                fix = left[np.arange(len(own)), pick] == 0
                pick[fix] = left[fix].argmax(1)
                new[own] = lo + pick
                for j, x in zip(c.tolist(), (lo + pick).tolist(), strict=True):
                    d["gone"].setdefault(j, []).append(x)
                d["popped"][c] = True
                left[np.arange(len(own)), pick] = 0
                rest = left.sum(1)
                with np.errstate(divide="ignore"):
                    mass = d["before"][c] + np.log(rest)
                noise = -np.log(_uniform(key[own], 3, r))
                d["open"][c] = np.where(mass > _LEAST, mass - np.log(noise + np.exp(np.minimum(mass - best[own], 700))), _GONE)
            spot[go] = spot_of
            some, seg = _segments(unit[go], first_unit[1:][go])
            node = home[some].copy()
            node[seg[:-1]] = choices.end[new[go]]
            walk, edge = choices.walk(node, last[some], mix(unit_key[some] + U(r)))
            owner = np.repeat(np.arange(len(go)), np.diff(seg))[walk] if len(walk) else walk
            tail = np.searchsorted(owner, np.arange(len(go) + 1))
            size = np.zeros(n, np.int64)
            size[go] = spot[go] + 1 + np.diff(tail)
            begin = np.zeros(n + 1, np.int64)
            np.cumsum(size, out=begin[1:])
            path, where = np.zeros(begin[-1], np.int64), np.zeros(begin[-1], np.int64)
            for i in range(r):
                own = go[source[go] == i]
                if len(own):
                    to, _ = _segments(begin[own], begin[own] + spot[own])
                    fro, _ = _segments(draws[i]["begin"][own], draws[i]["begin"][own] + spot[own])
                    path[to], where[to] = draws[i]["path"][fro], draws[i]["where"][fro]
            path[begin[go] + spot[go]], where[begin[go] + spot[go]] = new[go], unit[go]
            to, _ = _segments(begin[go] + spot[go] + 1, begin[go + 1])
            path[to], where[to] = edge, some[walk] if len(walk) else walk
            from_at = np.where(live, spot + 1, 0)
        step = choices.logp[path]
        total = np.concatenate([[0.0], np.cumsum(step)])
        owner = np.repeat(np.arange(n), np.diff(begin))
        before = total[:-1] - total[begin[owner]]
        opened = np.full(len(path), _GONE)
        may = np.flatnonzero((before > _LEAST) & (np.arange(len(path)) - begin[owner] >= from_at[owner]) & (choices.others[path] > _GONE))
        mass = before[may] + choices.others[path[may]]
        noise = -np.log(_uniform(mix(key[owner[may]] + U(4 + r)), may - begin[owner[may]]))
        opened[may] = mass - np.log(noise + np.exp(np.minimum(mass - bound[owner[may]], 700)))
        draws.append({"begin": begin, "path": path, "where": where, "before": before, "open": opened, "gone": {}, "popped": np.zeros(len(path), bool), "live": live, "logp": total[begin[1:]] - total[begin[:-1]], "value": bound.copy()})
    nxt = np.full(n, _GONE)
    for d in draws:
        full = np.flatnonzero(np.diff(d["begin"]) > 0)
        if len(full):
            nxt[full] = np.maximum(nxt[full], np.maximum.reduceat(d["open"], d["begin"][full]))
    return [(d["live"], choices.piece[d["path"]], d["begin"], d["logp"], d["value"]) for d in draws], nxt


def _first_max(values: np.ndarray, start: np.ndarray, stop: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The first place of each segment that holds its greatest value."""
    where, begin = _segments(start, stop)
    hit = np.flatnonzero(values[where] == np.repeat(most, np.diff(begin)))
    return where[hit[np.searchsorted(hit, begin[:-1])]]


def _batches(p: Gumbel, ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(p.vocabulary)
        choices = Choices(vocab, piece_logp(vocab, p.power))
        for batch in batches:
            for part in textkit.slices(batch, most=1 << 20):
                key = part.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
                found, nxt = sample(part.column("text"), key, choices, p)
                for rank, (live, pieces, begin, logp, value) in enumerate(found, 1):
                    row = np.flatnonzero(live)
                    size = np.diff(begin)[row]
                    inclusion = -np.expm1(-np.exp(np.minimum(logp[row] - nxt[row], 700)))
                    if ids:
                        at = np.append(begin[row], begin[-1])
                        what = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(pieces.astype(np.int32)))
                    else:
                        raw = pieces.astype("<u4").tobytes()
                        what = pa.array([zlib.crc32(raw[4 * begin[i] : 4 * begin[i + 1]]) for i in row], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(np.full(len(row), rank, np.int32)), what, pa.array(size), pa.array(logp[row]), pa.array(value[row]), pa.array(inclusion)], names=["doc_id", "rank", "ids" if ids else "ids_crc32", "n_pieces", "log_prob", "perturbed", "inclusion"])

    return run


def encode_samples(docs: DataFrame, p: Gumbel, ids: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) -> k distinct segmentations of each whole text, by rank: the greatest perturbed value first.

    Columns: doc_id, rank (from 1), ids (or ids_crc32 of the little-endian ids, if not ids), n_pieces, log_prob (of this
    segmentation among all of the text), perturbed (log_prob plus its Gumbel noise) and inclusion: the probability of a
    perturbed value above the next one left out, which weighs the sample. A text with fewer than k segmentations gives
    them all, with inclusion 1. A null or empty text has one, without pieces. Rows of equal doc_id and text get equal
    draws; a null doc_id counts as 0. Only doc_id and text are read. An empty table gives an empty result.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    what = "ids array<int>" if ids else "ids_crc32 long"
    return docs.mapInArrow(_batches(p, ids), f"doc_id long, rank int, {what}, n_pieces long, log_prob double, perturbed double, inclusion double")


def decode(ids: list[int], path: str) -> str:
    """The text of a segmentation: its pieces' bytes, less the space put before it."""
    raw = b"".join(vocabulary(path).text[i] for i in ids)
    return raw.decode()[1:] if raw else ""


def decode_column(samples: DataFrame, path: str) -> DataFrame:
    """samples (ids, ...) with a column `decoded`; null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, at = textkit.text_bytes(pa.array(vocabulary(path).text, pa.large_binary()))
        for batch in batches:
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy()
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            raw, ends = textkit.gather(pieces, at[:-1][ids], at[1:][ids])
            edges = ends[np.concatenate([[0], np.cumsum(size)])]
            begin = np.minimum(edges[:-1] + 1, edges[1:])  # less the space put before it
            body, to = textkit.gather(raw, begin, edges[1:])
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(to), pa.py_buffer(body)]).cast(pa.large_string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pc.if_else(lists.is_valid(), text, None).cast(pa.string())], names=[*batch.schema.names, "decoded"])

    samples = samples.drop("decoded")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema)
    return samples.mapInArrow(run, f"{schema}, decoded string")

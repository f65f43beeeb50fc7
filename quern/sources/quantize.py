"""Palette images: colours by median cut and k-means, and an indexed PNG of them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.sources import media

# Weight of opacity against colour, most colours that are clustered, rounds of k-means; chunks that are kept; palette sizes from a quality on.
ALPHA_WEIGHT, MOST, ROUNDS = 2.0, 60_000, 6
KEPT = ["iCCP", "sRGB", "gAMA", "cHRM", "pHYs", "eXIf"]
SIZES = [(90, 256), (80, 128), (70, 64), (50, 32), (0, 16)]


def palette_size(quality: int) -> int:
    return next(n for least, n in SIZES if quality >= least)


def _points(colours: np.ndarray) -> np.ndarray:
    """Colours as they are compared: scaled by opacity, and opacity itself with its weight."""
    c = colours.astype(float)
    return np.column_stack([c[:, :3] * c[:, 3:] / 255, c[:, 3] * ALPHA_WEIGHT])


def _colours(points: np.ndarray) -> np.ndarray:
    alpha = np.clip(points[:, 3:] / ALPHA_WEIGHT, 0, 255)
    share = np.where(alpha > 0, alpha / 255, 1)
    return np.floor(np.clip(np.column_stack([np.where(alpha > 0, points[:, :3] / share, 0), alpha]), 0, 255) + 0.5).astype(np.uint8)


def histogram(rgba: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different colours in order and how many pixels have each; red, green and blue lose low bits, one at a time, four at most, while there are too many."""
    pixels = rgba.reshape(-1, 4)
    for bits in range(5):
        mask = np.array([0xFF >> bits << bits] * 3 + [0xFF], np.uint8)
        colours, counts = np.unique(pixels & mask, axis=0, return_counts=True)
        if len(colours) <= MOST:
            break
    return colours, counts


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    for lo in range(0, len(points), 512):
        part = points[lo : lo + 512]
        out[lo : lo + 512] = ((part[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
    return out


def palette(rgba: np.ndarray, size: int) -> np.ndarray:
    """At most `size` colours for an image (rows, columns, 4): boxes of greatest spread are cut at their mean, then centres move to their means. One image by itself; operators.palettes does it for many."""
    colours, counts = histogram(rgba)
    if len(colours) <= size:
        return colours
    points, weight = _points(colours), counts.astype(float)
    boxes = [np.arange(len(points))]

    def spread(box: np.ndarray) -> tuple[float, int, float]:
        own, w = points[box], weight[box]
        mean = (own * w[:, None]).sum(0) / w.sum()
        axes = ((own - mean) ** 2 * w[:, None]).sum(0)
        return float(axes.max()), int(axes.argmax()), float(mean[axes.argmax()])

    spreads = [spread(boxes[0])]
    while len(boxes) < size:
        at = max(range(len(boxes)), key=lambda i: (spreads[i][0], -i))
        error, axis, cut = spreads[at]
        if error <= 0:
            break
        low = points[boxes[at], axis] <= cut
        if low.all() or not low.any():  # nothing but rounding is left of its spread
            spreads[at] = (0.0, axis, cut)
            continue
        own = boxes[at]
        boxes[at : at + 1] = [own[low], own[~low]]
        spreads[at : at + 1] = [spread(own[low]), spread(own[~low])]
    centres = np.array([(points[b] * weight[b][:, None]).sum(0) / weight[b].sum() for b in boxes])
    for _ in range(ROUNDS):
        own = _nearest(points, centres)
        total = np.bincount(own, weight, len(centres))
        sums = np.column_stack([np.bincount(own, weight * points[:, k], len(centres)) for k in range(4)])
        centres = np.where(total[:, None] > 0, sums / np.maximum(total, 1e-12)[:, None], centres)
    return np.unique(_colours(centres), axis=0)


def remap(rgba: np.ndarray, colours: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Palette and index of each pixel's nearest entry. An entry that only stands for opaque pixels is opaque, one that only stands for clear ones is clear."""
    kinds, back = np.unique(rgba.reshape(-1, 4), axis=0, return_inverse=True)
    index = _nearest(_points(kinds), _points(colours))
    low, high = np.full(len(colours), 255), np.zeros(len(colours), np.int64)
    np.minimum.at(low, index, kinds[:, 3].astype(np.int64))
    np.maximum.at(high, index, kinds[:, 3].astype(np.int64))
    out = colours.copy()
    out[low == 255, 3] = 255
    out[(high == 0) & (low == 0)] = 0
    return out, index[back].reshape(rgba.shape[:2])


def indexed_png(colours: np.ndarray, index: np.ndarray, kept: list[tuple[str, bytes]] = ()) -> bytes:
    """A PNG of palette and indexes, with opacity where an entry has any, and the chunks given."""
    height, width = index.shape
    depth = next(d for d in (1, 2, 4, 8) if len(colours) <= 1 << d)
    order = np.argsort(colours[:, 3] == 255, kind="stable")  # entries with opacity first, as only they need a place in its table
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    colours, rows = colours[order], place[index].astype(np.uint8)
    bits = np.unpackbits(rows[:, :, None], axis=2)[:, :, 8 - depth :].reshape(height, -1)
    lines = np.packbits(bits, axis=1)
    raw = np.column_stack([np.zeros(height, np.uint8), lines]).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    alphas = colours[colours[:, 3] < 255, 3]
    parts = [chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, 3, 0, 0, 0)), *[chunk(k.encode(), v) for k, v in kept], chunk(b"PLTE", colours[:, :3].tobytes())]
    parts += [chunk(b"tRNS", alphas.tobytes())] if len(alphas) else []
    return media.SIGNATURE + b"".join(parts) + chunk(b"IDAT", zlib.compress(raw, 9)) + chunk(b"IEND", b"")


def quantize(data: bytes, quality: int) -> bytes:
    """A PNG with a palette of the size that the quality stands for. Raises ValueError for what is no whole PNG."""
    rgba = (media.pixels(data) >> 8).astype(np.uint8)
    kept = [c for c in media.chunks(data) if c[0] in KEPT]
    return indexed_png(*remap(rgba, palette(rgba, palette_size(quality))), kept)


def quantized(files: DataFrame, quality: int) -> DataFrame:
    """files (path, content) of PNGs -> (path, bytes, new_bytes, content, error), each with a palette."""
    schema = "path string, bytes long, new_bytes long, content binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    new = quantize(data or b"", quality)
                    rows.append((path, len(data), len(new), new, None))
                except (ValueError, KeyError, IndexError, zlib.error, struct.error) as e:
                    rows.append((path, len(data or b""), None, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, types, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return files.select("path", "content").mapInArrow(run, schema)

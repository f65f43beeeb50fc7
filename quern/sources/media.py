"""Small binary readers: PNG chunks and pixels, MP4 boxes with a `vapc` description, PAG headers."""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Channels of a PNG colour type; the seven passes of interlacing as x, y, dx, dy.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]
MAX_BOXES, MAX_VAPC, MAX_PAG = 10_000, 1 << 20, 16 << 20


def chunks(data: bytes) -> list[tuple[str, bytes]]:
    """(type, payload) in order, all IDAT together as one empty mark where the first stands. Raises ValueError for what is no whole PNG."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, out = 8, []
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        payload = data[at + 8 : at + 8 + size]
        if len(payload) < size or zlib.crc32(kind + payload) != struct.unpack(">I", data[at + 8 + size : at + 12 + size].ljust(4, b"\0"))[0]:
            raise ValueError("broken chunk")
        at += 12 + size
        name = kind.decode("latin-1")
        if name == "IDAT":
            if all(kind != "IDAT" for kind, _ in out):
                out.append((name, b""))
        else:
            out.append((name, payload))
        if name == "IEND":
            if at != len(data):
                raise ValueError("data after IEND")
            return out
    raise ValueError("no IEND")


def _unfilter(raw: np.ndarray, rows: int, stride: int, step: int) -> np.ndarray:
    out = np.zeros((rows, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    lines = raw.reshape(rows, stride + 1)
    for y in range(rows):
        kind, line = int(lines[y, 0]), lines[y, 1:].copy()
        if kind == 2:
            line += above
        elif kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step], dtype=np.uint8)
        elif kind in (3, 4):
            for x in range(stride):
                a = int(line[x - step]) if x >= step else 0
                b = int(above[x])
                c = int(above[x - step]) if x >= step else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = (int(line[x]) + guess) & 255
        elif kind:
            raise ValueError("unknown filter")
        out[y] = above = line
    return out


def pixels(data: bytes) -> np.ndarray:
    """16-bit RGBA rows of a PNG, expanded: (height, width, 4)."""
    parts = chunks(data)
    head = dict(parts)
    width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head["IHDR"])
    at, raw = 8, b""
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        raw += data[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    raw = np.frombuffer(zlib.decompress(raw), np.uint8)
    n = CHANNELS[colour]
    samples = np.zeros((height, width, n), np.uint16)
    used = 0
    for x0, y0, dx, dy in PASSES if interlaced else [(0, 0, 1, 1)]:
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        stride = (w * n * depth + 7) // 8
        lines = _unfilter(raw[used : used + h * (stride + 1)], h, stride, max(1, n * depth // 8))
        used += h * (stride + 1)
        if depth == 16:
            value = lines.reshape(h, -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
        elif depth == 8:
            value = lines.astype(np.uint16)
        else:
            value = (np.unpackbits(lines, axis=1).reshape(h, -1, depth) @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint16)
        samples[y0::dy, x0::dx] = value[:, : w * n].reshape(h, w, n)
    out = np.full((height, width, 4), 65535, np.uint16)
    scale = 65535 // (2**depth - 1)
    if colour == 3:
        palette = np.frombuffer(head["PLTE"], np.uint8).reshape(-1, 3).astype(np.uint16) * 257
        out[:, :, :3] = palette[samples[:, :, 0]]
        if "tRNS" in head:
            alpha = np.full(len(palette), 65535, np.uint16)
            clear = np.frombuffer(head["tRNS"], np.uint8)
            alpha[: len(clear)] = clear.astype(np.uint16) * 257
            out[:, :, 3] = alpha[samples[:, :, 0]]
        return out
    full = samples * np.uint16(scale)
    out[:, :, :3] = full[:, :, :1] if n < 3 else full[:, :, :3]
    if n in (2, 4):
        out[:, :, 3] = full[:, :, n - 1]
    elif "tRNS" in head:
        key = np.array(struct.unpack(f">{n}H", head["tRNS"]), np.uint16)
        out[:, :, 3][(samples == key).all(2)] = 0
    return out


#: Pixels of an image that images() expands.
MAX_PIXELS = 1 << 24


def images(files: DataFrame) -> DataFrame:
    """files (path, content) of PNGs -> (path, width, height, frames, rgba, error): pixels as similarity.fingerprint() takes them, premultiplied, one image at a time; an image of over MAX_PIXELS, or broken, has an error and no pixels."""

    def look(data: bytes) -> tuple:
        if data.startswith(SIGNATURE) and len(data) >= 24 and int.from_bytes(data[16:20]) * int.from_bytes(data[20:24]) > MAX_PIXELS:
            return (None, None, None, None, "too many pixels")
        try:
            rgba = pixels(data).astype(np.float32) / 65535
        except (ValueError, KeyError, IndexError, zlib.error, struct.error) as e:
            return (None, None, None, None, f"{type(e).__name__}: {e}")
        rgba[:, :, :3] *= rgba[:, :, 3:]
        return (rgba.shape[1], rgba.shape[0], 1, rgba.ravel(), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"path": pa.string(), "width": pa.int32(), "height": pa.int32(), "frames": pa.int32(), "rgba": pa.list_(pa.float32()), "error": pa.string()}
        for batch in batches:
            for path, data in zip(batch.column("path"), batch.column("content"), strict=True):
                row = (path.as_py(), *look(data.as_py() or b""))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds.values(), strict=True)], names=list(kinds))

    return files.select("path", "content").mapInArrow(run, "path string, width int, height int, frames int, rgba array<float>, error string")


def equal_images(a: bytes, b: bytes) -> bool:
    """Whether two PNGs show the same, whatever their encoding."""
    x, y = pixels(a), pixels(b)
    return x.shape == y.shape and bool((x == y).all())


def recompress(data: bytes) -> bytes | None:
    """The PNG with its image data deflated again at the highest level, checked to show the same; None if that is not smaller."""
    at, raw, before, after = 8, b"", [], []
    parts = chunks(data)
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        raw += data[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    place = before
    for name, payload in parts:
        if name == "IDAT":
            place = after
        else:
            place.append((name.encode("latin-1"), payload))
    build = lambda kind, payload: struct.pack(">I", len(payload)) + kind + payload + struct.pack(">I", zlib.crc32(kind + payload))
    out = SIGNATURE + b"".join(build(*c) for c in before) + build(b"IDAT", zlib.compress(zlib.decompress(raw), 9)) + b"".join(build(*c) for c in after)
    return out if len(out) < len(data) and equal_images(data, out) else None


# What a VAP description may say: its version, greatest video side, canvas pixels, frames and frame rates.
VAP_VERSION, VAP_SIDE, VAP_PIXELS, VAP_FRAMES, VAP_FPS = 2, 8_192, 16_777_216, 1_000_000, (1, 120)


def _boxes(data: bytes):
    """(kind, body) of the top-level boxes. Raises ValueError for a broken one or too many."""
    at = 0
    for _ in range(MAX_BOXES):
        if at >= len(data):
            return
        if at + 8 > len(data):
            raise ValueError("truncated box")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1:
            if at + 16 > len(data):
                raise ValueError("truncated large box")
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        elif size == 0:
            size = len(data) - at
        if size < head or at + size > len(data):
            raise ValueError("box size out of range")
        yield kind, data[at + head : at + size], size
        at += size
    if at < len(data):
        raise ValueError("too many boxes")


def vap(data: bytes) -> dict | None:
    """The description in an MP4's one top-level `vapc` box (info, and the number of sources as `sources`), or None. Raises ValueError for broken boxes and what the description may not say."""
    if data[4:8] != b"ftyp":
        return None
    found = None
    for kind, body, size in _boxes(data):
        if kind != b"vapc":
            continue
        if found is not None:
            raise ValueError("more than one description")
        if size > MAX_VAPC:
            raise ValueError("description too long")
        doc = json.loads(body)
        found = _vap_info(doc["info"]) | {"sources": len(doc.get("src", []))} if isinstance(doc, dict) and isinstance(doc.get("info"), dict) else {}
        if not found:
            raise ValueError("description without info")
    return found


def _vap_info(info: dict) -> dict:
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 1 << 32
    sides = [info.get(k) for k in ("v", "w", "h", "videoW", "videoH", "f")]
    regions = [info.get("rgbFrame"), info.get("aFrame")]
    if not all(map(whole, sides)) or not isinstance(info.get("fps"), (int, float)) or not all(isinstance(r, list) and len(r) == 4 and all(map(whole, r)) for r in regions):
        raise ValueError("description with wrong types")
    version, width, height, video_w, video_h, frames = sides
    canvas = width > 0 and height > 0 and width * height <= VAP_PIXELS and 0 < video_w <= VAP_SIDE and 0 < video_h <= VAP_SIDE
    if version != VAP_VERSION or not canvas or not 0 < frames <= VAP_FRAMES or not VAP_FPS[0] <= info["fps"] <= VAP_FPS[1]:
        raise ValueError("canvas or timing out of range")
    for x, y, w, h in regions:
        if not (w > 0 and h > 0 and x + w <= video_w and y + h <= video_h):
            raise ValueError("region out of bounds")
    return {k: info[k] for k in ("w", "h", "videoW", "videoH", "f", "fps", "rgbFrame", "aFrame")}


def pag(data: bytes) -> dict:
    """Version and compression of a PAG file. Raises ValueError for another header, version or compression, or a body not of the length that the header says."""
    if len(data) < 11 or not data.startswith(b"PAG"):
        raise ValueError("no PAG header")
    if len(data) > MAX_PAG:
        raise ValueError("too large")
    version, size, compression = data[3], struct.unpack("<I", data[4:8])[0], data[8:9]
    if version != 1 or compression != b"U":
        raise ValueError("unsupported version or compression")
    if size != len(data) - 9:
        raise ValueError("body length differs from header")
    return {"version": version, "compression": compression.decode()}


def descriptions(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, kind, width, height, frames, fps, error): what MP4 and PAG files say; kind is vap, mp4 or pag, other files have no row."""
    schema = "path string, kind string, width int, height int, frames int, fps double, error string"

    def look(path: str, data: bytes) -> tuple | None:
        if path.lower().endswith(".pag") or data.startswith(b"PAG"):
            return ("pag", *[None] * 4, _error(pag, data))
        if not path.lower().endswith((".mp4", ".vap", ".tcmp4")):
            return None
        try:
            info = vap(data)
        except ValueError as e:
            return ("vap", *[None] * 4, str(e))
        return ("vap", info["w"], info["h"], info["f"], float(info["fps"]), None) if info else ("mp4", *[None] * 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
        for batch in batches:
            rows = [(p, *found) for p, c in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) if (found := look(p, c or b""))]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return files.select("path", "content").mapInArrow(run, schema)


def _error(read: Callable[[bytes], object], data: bytes) -> str | None:
    try:
        read(data)
    except ValueError as e:
        return str(e)
    return None


def recompressed(files: DataFrame) -> DataFrame:
    """files (path, content) of PNGs -> (path, bytes, new_bytes, content, error): each deflated anew and checked to show the same; content is null where that is not smaller."""
    schema = "path string, bytes long, new_bytes long, content binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                data = data or b""
                try:
                    new = recompress(data)
                    rows.append((path, len(data), len(new) if new else len(data), new, None))
                except (ValueError, KeyError, zlib.error, struct.error, IndexError) as e:
                    rows.append((path, len(data), None, None, f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 5, types, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

    return files.select("path", "content").mapInArrow(run, schema)

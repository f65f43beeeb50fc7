"""Localization and media readers."""

import json
import struct
import zlib

import numpy as np
import pytest

from quern.sources import l10n, media


def test_string_catalog():
    doc = {"sourceLanguage": "en", "strings": {"a": {"localizations": {"fr": {"stringUnit": {"state": "needs_review", "value": "%d x"}}}}, "b": {"extractionState": "stale"}, "c": {"shouldTranslate": False, "localizations": {"en": {"variations": {"plural": {"one": {}}}}}}}}
    fmt, entries = l10n.parse("x/L.xcstrings", json.dumps(doc).encode())
    assert fmt == "xcstrings"
    assert ("fr", "a", "singular", "%d x", "needs_review", False, True) in entries and ("en", "a", "empty", None, "translated", False, True) in entries
    assert ("en", "b", "empty", None, "translated", True, True) in entries and ("en", "c", "plural", None, "translated", False, False) in entries


def test_strings_files():
    text = '/* c */ "a" = "x\\n\\"y\\""; // z\n"b"="//no comment";'
    for data in (text.encode(), text.encode("utf-16")):
        assert [e[:4] for e in l10n.parse("fr.lproj/L.strings", data)[1]] == [("fr", "a", "singular", 'x\n"y"'), ("fr", "b", "singular", "//no comment")]
    with pytest.raises(ValueError):
        l10n.parse("fr.lproj/L.strings", b"{ not strings")


def test_android_values():
    xml = b'<resources><string name="a">A <b>b</b></string><string name="n" translatable="false">N</string><plurals name="p"><item quantity="one">1</item></plurals></resources>'
    assert [e[0] for e in l10n.parse("app/res/values-zh-rCN/s.xml", xml)[1]] == ["zh-CN"] * 3
    assert l10n.parse("app/res/values/s.xml", xml)[1][0] == ("default", "a", "singular", "A b", "translated", False, True)
    assert l10n.values_language("values-in") == "id" and l10n.values_language("values-night") == "default" and l10n.parse("a/b.xml", xml) is None


def test_integrity_fields():
    assert l10n.has_integrity_fields(b'{"a":[{"md5":"x"}]}') and l10n.has_integrity_fields(b'{"hash":1,"url":"u"}') and l10n.has_integrity_fields(b"no json")
    assert not l10n.has_integrity_fields(b'{"hash":1,"md5":""}')


def png(rows, colour=6, depth=8, filters=None, level=0):
    height, width = rows.shape[:2]
    flat = rows.reshape(height, -1).astype(np.uint8)
    raw = b"".join(bytes([0]) + flat[y].tobytes() for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def test_png():
    rows = np.arange(8 * 9 * 4).reshape(8, 9, 4) % 251
    data = png(rows)
    assert (media.pixels(data) == rows * 257).all()
    assert [c[0] for c in media.chunks(data)] == ["IHDR", "IDAT", "IEND"]
    smaller = media.recompress(data)
    assert smaller and len(smaller) < len(data) and media.equal_images(data, smaller)
    assert not media.equal_images(data, png(rows[::-1].copy()))
    for bad in (b"", data[:-4], data + b"x"):
        with pytest.raises(ValueError):
            media.chunks(bad)


VAP = {"v": 2, "w": 6, "h": 2, "f": 3, "fps": 30.0, "videoW": 12, "videoH": 2, "rgbFrame": [0, 0, 6, 2], "aFrame": [6, 0, 6, 2]}


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_vap():
    start = box(b"ftyp", b"mp42")
    told = lambda **k: box(b"vapc", json.dumps({"info": VAP | k}).encode())
    assert media.vap(start + box(b"free", b"") + told())["f"] == 3
    assert media.vap(start) is None and media.vap(told()) is None and media.vap(b"") is None
    last = start + struct.pack(">I4s", 0, b"vapc") + json.dumps({"info": VAP}).encode()
    large = json.dumps({"info": VAP}).encode()
    assert media.vap(last)["w"] == 6 and media.vap(start + struct.pack(">I4sQ", 1, b"vapc", 16 + len(large)) + large)["w"] == 6
    for bad in (told() + told(), told(v=1), told(w=0), told(fps=0.5), told(fps=121), told(videoW=9000), told(f=0), told(aFrame=[7, 0, 6, 2]), told(rgbFrame=[0, 0, 0, 2]), told(w="6"), box(b"vapc", b"{"), b"\0\0\0\4free", b"\0\0"):
        with pytest.raises(ValueError):
            media.vap(start + bad)


def test_pag():
    head = lambda version, size, mark: b"PAG" + bytes([version]) + struct.pack("<I", size) + mark
    assert media.pag(head(1, 2, b"U") + b"ab") == {"version": 1, "compression": "U"}
    for bad in (b"", head(1, 1, b"U") + b"a", head(2, 2, b"U") + b"ab", head(1, 2, b"Z") + b"ab", head(1, 3, b"U") + b"ab", b"GAP" + head(1, 2, b"U")[3:] + b"ab"):
        with pytest.raises(ValueError):
            media.pag(bad)


def test_png_marks_image_data_once():
    data = png(np.zeros((2, 2, 4)))
    parts = []
    at = 8
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        parts.append(data[at : at + 12 + size])
        at += 12 + size
    text = lambda t: struct.pack(">I", 1) + b"tEXt" + t + struct.pack(">I", zlib.crc32(b"tEXt" + t))
    split = media.SIGNATURE + parts[0] + parts[1] + text(b"a") + parts[1] + parts[2]
    assert [c[0] for c in media.chunks(split)] == ["IHDR", "IDAT", "tEXt", "IEND"]

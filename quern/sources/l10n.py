"""Localization files as entries: string catalogs, .strings, .stringsdict and Android values."""

from __future__ import annotations

import json
import plistlib
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, format string, declared string, language string, key string, value_kind string, value string, status string, stale boolean, translatable boolean, seq long, error string"
_COLUMNS = ["path", "format", "declared", "language", "key", "value_kind", "value", "status", "stale", "translatable", "seq", "error"]
_PAIR = re.compile(r'"((?:[^"\\]|\\.)*)"\s*=\s*"((?:[^"\\]|\\.)*)"\s*;', re.S)
_COMMENT = re.compile(r'("(?:[^"\\]|\\.)*")|/\*.*?\*/|//[^\n]*', re.S)
# Escapes of .strings files.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\", "'": "'"}


def _text(data: bytes) -> str:
    for mark, name in ((b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"), (b"\xef\xbb\xbf", "utf-8-sig")):
        if data.startswith(mark):
            return data.decode(name)
    return data.decode("utf-8")


def _unescape(text: str) -> str:
    return re.sub(r"\\(?:U([0-9A-Fa-f]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else _ESCAPES.get(m[2], m[2]), text, flags=re.S)


def _folder_language(path: str) -> str:
    found = re.search(r"([^/]+)\.lproj/", path)
    return found[1] if found else ""


def values_language(folder: str) -> str:
    """Language of a values folder: `default`, or its first language with a region, or a b+ tag."""
    tokens = folder.split("-")[1:]
    for i, token in enumerate(tokens):
        if token.startswith("b+"):
            return token[2:].replace("+", "-")
        if re.fullmatch("[a-z]{2,3}", token) and token != "car":
            after = tokens[i + 1] if i + 1 < len(tokens) else ""
            old = {"in": "id", "iw": "he", "ji": "yi"}.get(token, token)
            return f"{old}-{after[1:]}" if re.fullmatch("r[A-Z0-9]{2,}", after) else old
    return "default"


def catalog(data: bytes) -> Iterator[tuple]:
    """(language, key, kind, value, status, stale, translatable) of a string catalog."""
    doc = json.loads(data)
    source = doc.get("sourceLanguage", "")
    for key, item in doc.get("strings", {}).items():
        stale, translatable = item.get("extractionState") == "stale", item.get("shouldTranslate", True) is not False
        told = item.get("localizations", {})
        for language in {source, *told}:
            unit = told.get(language)
            if unit is None:
                yield language, key, "empty", None, "translated", stale, translatable
            elif "stringUnit" in unit:
                yield language, key, "singular", unit["stringUnit"].get("value", ""), unit["stringUnit"].get("state", "translated"), stale, translatable
            else:
                plural = bool(unit.get("variations", {}).get("plural"))
                yield language, key, "plural" if plural else "empty", None, "translated", stale, translatable


def strings(path: str, data: bytes) -> Iterator[tuple]:
    text = _COMMENT.sub(lambda m: m[1] or " ", _text(data))
    if _PAIR.sub("", text).strip():
        raise ValueError("not a strings file")
    for key, value in _PAIR.findall(text):
        yield _folder_language(path), _unescape(key), "singular", _unescape(value), "translated", False, True


def stringsdict(path: str, data: bytes) -> Iterator[tuple]:
    for key, item in plistlib.loads(data).items():
        forms = any(isinstance(v, dict) and v.get("NSStringFormatSpecTypeKey") for v in item.values())
        yield _folder_language(path), key, "plural" if forms else "empty", None, "translated", False, True


def android_values(path: str, data: bytes) -> Iterator[tuple]:
    root = ElementTree.fromstring(data)
    if root.tag != "resources":
        raise ValueError("no resources element")
    language = values_language(path.split("/")[-2] if "/" in path else "")
    for item in root:
        name, translatable = item.get("name", ""), item.get("translatable") != "false"
        if item.tag == "string":
            yield language, name, "singular", "".join(item.itertext()), "translated", False, translatable
        elif item.tag == "plurals":
            yield language, name, "plural" if len(item) else "empty", None, "translated", False, translatable


def parse(path: str, data: bytes) -> tuple[str, list[tuple]] | None:
    """Format and entries of a file, or None if it is no localization file. Raises ValueError for a broken one."""
    name = path.rsplit("/", 1)[-1]
    try:
        if name.endswith(".xcstrings"):
            return "xcstrings", list(catalog(data))
        if name.endswith(".stringsdict"):
            return "stringsdict", list(stringsdict(path, data))
        if name.endswith(".strings") and data.startswith(b"bplist"):
            return None  # compiled
        if name.endswith(".strings"):
            return "strings", list(strings(path, data))
        if name.endswith(".xml") and re.search(r"(^|/)res/values[^/]*/[^/]+$", path):
            return "android", list(android_values(path, data))
    except (ValueError, KeyError, AttributeError, TypeError, ElementTree.ParseError, plistlib.InvalidFileException) as e:
        raise ValueError(f"{type(e).__name__}: {e}") from e
    return None


def declared_source(path: str, data: bytes) -> str:
    """The source language that a string catalog names; empty for other files."""
    return json.loads(data).get("sourceLanguage", "") if path.endswith(".xcstrings") else ""


def localization_entries(files: DataFrame) -> DataFrame:
    """files (path, content) -> entries; a broken file gives one row with its error, other files none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    found = parse(path, content or b"")
                    named = declared_source(path, content or b"") if found else ""
                    rows += [(path, found[0], named, *e, i, None) for i, e in enumerate(found[1])] if found else []
                except ValueError as e:
                    rows.append((path, *(None,) * 10, str(e)))
            columns = list(zip(*rows, strict=True)) or [()] * 12
            kinds = [pa.string()] * 8 + [pa.bool_(), pa.bool_(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=_COLUMNS)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def has_integrity_fields(data: bytes) -> bool:
    """Whether JSON says digests of other files anywhere; what is no JSON counts as if."""
    try:
        doc = json.loads(data)
    except ValueError:
        return True

    def look(x) -> bool:
        if isinstance(x, list):
            return any(map(look, x))
        if not isinstance(x, dict):
            return False
        names = {k.lower(): v for k, v in x.items()}
        if any(names.get(k) for k in ("md5", "sha1", "sha256", "integrity", "md5assetsmap")):
            return True
        return bool("hash" in names and {"path", "file", "filename", "url"} & set(names)) or any(map(look, x.values()))

    return look(doc)

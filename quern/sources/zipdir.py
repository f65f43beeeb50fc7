"""ZIP central directories and bounded archive inspection, as rows."""

from __future__ import annotations

import io
import struct
import unicodedata
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.operators.archive import MAX_ENTRIES, MAX_ENTRY, MAX_INPUT, MAX_TOTAL


def central_directory(data: bytes) -> dict[str, int]:
    """Entry name -> compressed size; the last of equal names counts. Raises ValueError for what is no plain ZIP."""
    if len(data) < 22 or (end := data.rfind(b"PK\x05\x06", max(0, len(data) - 22 - 65_535), len(data) - 18)) < 0:
        raise ValueError("not a zip archive")
    count, _, at = struct.unpack("<HII", data[end + 10 : end + 20])
    if count == 0xFFFF or at == 0xFFFFFFFF:
        raise ValueError("zip64 archives are not supported")
    out: dict[str, int] = {}
    for _ in range(count):
        head = data[at : at + 46]
        if len(head) < 46 or head[:4] != b"PK\x01\x02":
            raise ValueError("bad central directory")
        size = struct.unpack("<I", head[20:24])[0]
        name, extra, note = struct.unpack("<HHH", head[28:34])
        raw = data[at + 46 : at + 46 + name]
        if len(raw) < name:
            raise ValueError("truncated zip record")
        out[raw.decode("utf-8", "replace")] = size
        at += 46 + name + extra + note
    return out


def inspect(data: bytes) -> list[tuple[str, bool, int, int]]:
    """(name, directory, bytes, compressed) of a safe archive within limits. Raises ValueError with the reason otherwise."""
    if len(data) > MAX_INPUT:
        raise ValueError("input too large")
    ends = [i for i in range(max(0, len(data) - 65_557), len(data) - 21) if data[i : i + 4] == b"PK\x05\x06" and i + 22 + int.from_bytes(data[i + 20 : i + 22], "little") == len(data)]
    if not ends:
        raise ValueError("no end record")
    disk, first, here, count = struct.unpack("<4H", data[ends[-1] + 4 : ends[-1] + 12])
    if disk or first or here != count:
        raise ValueError("several disks")
    if count > MAX_ENTRIES:
        raise ValueError("too many entries")
    try:
        infos = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except (zipfile.BadZipFile, NotImplementedError) as e:
        raise ValueError(str(e)) from e
    if len(infos) != count:
        raise ValueError("entries differ from their count")
    seen: set[str] = set()
    total = 0
    for i in infos:
        if not i.flag_bits & 0x800 and any(ord(c) > 127 for c in i.orig_filename):
            try:
                i.filename = i.orig_filename.encode("cp437").decode("utf-8")
            except UnicodeError as e:
                raise ValueError("name is not UTF-8") from e
        name = i.filename.removesuffix("/")
        if not name or len(name.encode()) > 1024 or any(c in "\\:" or unicodedata.category(c) == "Cc" for c in name) or {"", ".", ".."} & set(name.split("/")):
            raise ValueError("unsafe entry name")
        if name.lower() in seen:
            raise ValueError("duplicate entry name")
        seen.add(name.lower())
        if (i.external_attr >> 16) & 0o170000 == 0o120000:
            raise ValueError("symlink entry")
        if i.flag_bits & 1:
            raise ValueError("encrypted entry")
        if i.file_size > MAX_ENTRY:
            raise ValueError("entry too large")
        total += i.file_size
        if total > MAX_TOTAL:
            raise ValueError("archive too large")
    folders = {"/".join(n.split("/")[:k]) for n in seen for k in range(1, n.count("/") + 1)}
    if any(not i.is_dir() and i.filename.lower() in folders for i in infos):
        raise ValueError("file and folder of one name")
    return [(i.filename, i.is_dir(), i.file_size, i.compress_size) for i in infos]


def read_entry(data: bytes, name: str) -> bytes:
    """Content of an entry, within the limit and with the size and checksum that the directory says. Raises ValueError otherwise."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
        info = archive.getinfo(name)
        if info.file_size > MAX_ENTRY:
            raise ValueError("entry too large")
        with archive.open(info) as f:
            out = f.read(info.file_size + 1)
    except (zipfile.BadZipFile, KeyError, NotImplementedError, RuntimeError, EOFError, zlib.error) as e:
        raise ValueError(str(e)) from e
    if len(out) != info.file_size:
        raise ValueError("size differs from directory")
    return out


def archive_entries(files: DataFrame) -> DataFrame:
    """files (path, content) -> (archive, name, directory, bytes, compressed, error): entries of each safe archive, or one row with the reason why it is refused."""
    return _per_file(files, lambda content: inspect(content), "archive string, name string, directory boolean, bytes long, compressed long, error string")


def package_entries(files: DataFrame) -> DataFrame:
    """files (path, content) -> (package, name, compressed_bytes, error): entries of each package, or one row with its error."""
    return _per_file(files, lambda content: list(central_directory(content).items()), "package string, name string, compressed_bytes long, error string")


def _per_file(files: DataFrame, read: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """A row for each tuple that read() gives for a file, between its path and a null error; one row with the error if it raises ValueError."""
    types = {"string": pa.string(), "boolean": pa.bool_(), "long": pa.int64()}
    names, kinds = zip(*[c.split() for c in schema.split(", ")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows += [(path, *entry, None) for entry in read(content or b"")]
                except ValueError as e:
                    rows.append((path, *[None] * (len(names) - 2), str(e)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, t in zip(columns, kinds, strict=True)], names=list(names))

    return files.select("path", "content").mapInArrow(run, schema)

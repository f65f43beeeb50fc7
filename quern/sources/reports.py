"""Reports, plans, journals and policies as files: readers with checks, and writers."""

from __future__ import annotations

import json
import os
import tempfile
import tomllib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import IO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.candidates import AnalysisOptions, BatchPolicy
from quern.operators.report import html_safe_json

def _nested(fields: str) -> str:
    """Top-level schema text as that of a struct."""
    return ", ".join(f.strip().replace(" ", ": ", 1) for f in fields.split(";"))


_CANDIDATE = _nested("format string; lossy boolean; bytes long; savings_bytes long; artifact string; valid boolean; rejection string; warnings array<string>; sha256 string; score double")
_RESOURCE = _nested("path string; bytes long; kind string; format string; status string; exclusion string; format_lock string; extension_mismatch boolean; sha256 string; smallest_candidate int")
REPORT = f"schema_version int, root string, resources array<struct<{_RESOURCE}, candidates: array<struct<{_CANDIDATE}>>>>"
PLAN = "schema_version int, backend string, root string, candidates array<struct<path: string, original_sha256: string, optimized_sha256: string, original_bytes: long, optimized_bytes: long, contents_path: string, contents_sha256: string>>"
MAX_INPUT = 64 << 20


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A report's resources (index, ...) and candidates (resource, candidate, ...). Raises ValueError for another schema, a relative root, or artifacts outside the candidates folder."""
    report = spark.read.schema(REPORT).option("multiLine", True).json(path)
    head = report.select("schema_version", "root").take(2)
    if len(head) != 1 or head[0]["schema_version"] not in (1, 2):
        raise ValueError("unsupported analysis schema")
    if not (head[0]["root"] or "").startswith("/"):
        raise ValueError("project root must be absolute")
    rows = report.select(F.posexplode("resources").alias("index", "r")).select("index", "r.*")
    candidates = rows.select(F.col("index").alias("resource"), F.posexplode("candidates").alias("candidate", "c")).select("resource", "candidate", "c.*")
    if candidates.where(F.col("artifact").isNotNull() & ~F.col("artifact").startswith("candidates/")).limit(1).count():
        raise ValueError("invalid artifact directory")
    return rows.drop("candidates"), candidates


def report_rows(resources: DataFrame, candidates: DataFrame) -> DataFrame:
    """resources (index, ...), candidates (resource, candidate, ...) -> (index, json): each resource's part of a report, with its candidates in order."""
    fields = [c for c in candidates.columns if c not in ("resource", "candidate")]
    own = candidates.groupBy(F.col("resource").alias("index")).agg(F.transform(F.sort_array(F.collect_list(F.struct("candidate", F.struct(*fields).alias("c")))), lambda x: x["c"]).alias("candidates"))
    rows = resources.join(own, "index", "left")
    return rows.select("index", F.to_json(F.struct(*[c for c in rows.columns if c != "index"])).alias("json"))


def _head(root: str) -> str:
    return json.dumps({"schema_version": 2, "root": root})[:-1] + ', "resources": ['


def write_report(resources: DataFrame, candidates: DataFrame, root: str, directory: str) -> None:
    """analysis.json and report.html in a directory that the driver can write.

    The document is one file by its format: its rows are sorted by the cluster and streamed into it one partition after
    another, so neither the driver nor a task holds it whole. What has no size bound belongs in a table; use the DataFrames themselves there.
    """
    os.makedirs(directory, exist_ok=True)
    rows = report_rows(resources, candidates).orderBy("index").select("json")
    path = os.path.join(directory, "analysis.json")
    with replacing(path) as f:
        f.write(_head(root).encode())
        for n, r in enumerate(rows.toLocalIterator()):
            f.write((",\n" * bool(n) + r["json"]).encode())
        f.write(b"]}")
    refresh_report(directory)


def refresh_report(directory: str) -> None:
    """report.html anew from analysis.json; the analysis stays as it is."""
    with open(os.path.join(directory, "analysis.json"), encoding="utf-8") as f:
        text = f.read()
    json.loads(text)
    page = f'<!doctype html><meta charset="utf-8"><title>Resource report</title><pre id="view"></pre><script id="data" type="application/json">{safe_in_html(text)}</script><script>document.getElementById("view").textContent=JSON.stringify(JSON.parse(document.getElementById("data").textContent),null,1)</script>'
    replace_file(os.path.join(directory, "report.html"), page.encode())


def safe_in_html(text: str) -> str:
    """JSON text that can stand inside a script element; the same as html_safe_json() on a Column."""
    for char in "<>&  ":
        text = text.replace(char, f"\\u{ord(char):04x}")
    return text


@contextmanager
def replacing(path: str, new: bool = False) -> Iterator[IO[bytes]]:
    """A file's new content to write to, whole or unchanged; its permissions stay. new: FileExistsError if there is one."""
    handle, made = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".tmp-")
    try:
        with os.fdopen(handle, "wb") as f:
            yield f
            f.flush()
            os.fsync(f.fileno())
        if new:
            os.link(made, path)
            return
        os.chmod(made, os.stat(path).st_mode & 0o7777 if os.path.exists(path) else 0o644)
        os.replace(made, path)
    finally:
        if os.path.exists(made):
            os.unlink(made)


def create_file(path: str, data: bytes) -> None:
    """A new file, whole or not at all; FileExistsError if there is one."""
    with replacing(path, new=True) as f:
        f.write(data)


def replace_file(path: str, data: bytes) -> None:
    with replacing(path) as f:
        f.write(data)


def plan_problems(candidates: DataFrame) -> DataFrame:
    """(path, problem) of a plan's candidates: a path that is there twice, a digest that is none, sizes that can't be."""
    digest = lambda c: F.coalesce(F.col(c).rlike("^[0-9a-f]{64}$"), F.lit(False))
    twice = candidates.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("duplicate candidate path").alias("problem"))
    sizes = (F.col("optimized_bytes") < F.col("original_bytes")) & (F.col("original_bytes") <= MAX_INPUT)
    wrong = F.when(~(digest("original_sha256") & digest("optimized_sha256") & digest("contents_sha256")), "invalid SHA-256 digest").when(~F.coalesce(sizes, F.lit(False)), "invalid candidate sizes")
    return twice.union(candidates.select("path", wrong.alias("problem")).where("problem is not null"))


def read_plan(spark: SparkSession, path: str, backend: str) -> DataFrame:
    """A plan's candidates. Raises ValueError for another schema or backend, or the first problem by path."""
    plan = spark.read.schema(PLAN).option("multiLine", True).json(path)
    head = plan.select("schema_version", "backend", "root").take(2)
    if len(head) != 1 or head[0]["schema_version"] != 1:
        raise ValueError("unsupported plan schema version")
    if head[0]["backend"] != backend:
        raise ValueError("unsupported optimization backend")
    if not (head[0]["root"] or "").startswith("/"):
        raise ValueError("project root must be absolute")
    rows = plan.select(F.explode("candidates").alias("c")).select("c.*")
    problem = plan_problems(rows).orderBy("path", "problem").first()
    if problem:
        raise ValueError(f"{problem['problem']}: {problem['path']}")
    return rows


def plan_order(candidates: DataFrame) -> DataFrame:
    """Largest savings first, then by path parts."""
    return candidates.orderBy(F.desc(F.col("original_bytes") - F.col("optimized_bytes")), F.split("path", "/"))


def write_plan(candidates: DataFrame, blobs: DataFrame, root: str, backend: str, directory: str) -> None:
    """A plan as a new folder: `blobs` (sha256, content) once each as a table by the first two digits of the hash, and `plan.json`, whose rows the cluster sorts and the driver streams into the file."""
    once = blobs.select("sha256", "content").dropDuplicates(["sha256"]).withColumn("prefix", F.substring("sha256", 1, 2))
    once.write.partitionBy("prefix").mode("errorifexists").parquet(os.path.join(directory, "blobs"))
    head = json.dumps({"schema_version": 1, "backend": backend, "root": root})[:-1] + ', "candidates": ['
    with replacing(os.path.join(directory.removeprefix("file://"), "plan.json"), new=True) as f:
        f.write(head.encode())
        for n, r in enumerate(plan_order(candidates).select(F.to_json(F.struct("*")).alias("json")).toLocalIterator()):
            f.write(("," * bool(n) + r["json"]).encode())
        f.write(b"]}")


def append_journal(events: DataFrame, directory: str) -> None:
    """events (path, event, ...) as JSON lines after those that are there."""
    events.write.mode("append").json(directory)


def read_journal(spark: SparkSession, directory: str) -> DataFrame:
    """(path, started, completed): how often each path's change was begun and ended."""
    events = spark.read.schema("path string, event string").json(directory)
    return events.groupBy("path").agg(F.count_if(F.col("event") == "started").alias("started"), F.count_if(F.col("event") == "completed").alias("completed"))


def read_policy(path: str) -> tuple[AnalysisOptions, BatchPolicy]:
    """Options and batch policy of a TOML file: top-level keys and those of [batch]. Raises ValueError for an unknown key or a value out of range."""
    with open(path, "rb") as f:
        doc = tomllib.load(f)
    batch = doc.pop("batch", {})
    tuples = lambda d: {k: tuple(v) if isinstance(v, list) else v for k, v in d.items()}
    try:
        return AnalysisOptions(**tuples(doc)), BatchPolicy(**tuples(batch))
    except TypeError as e:
        raise ValueError(str(e)) from e


def rows_as_json(rows: DataFrame) -> DataFrame:
    """One column `json`, safe inside HTML, for each row."""
    return rows.select(html_safe_json(F.struct("*")).alias("json"))


def rows_as_text(rows: DataFrame) -> DataFrame:
    """One column `line` of tab-separated values for each row; null is empty."""
    return rows.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("line"))


def media_info(probes: DataFrame) -> DataFrame:
    """probes (path, json: what ffprobe prints) -> (path, seconds, bit_rate, width, height, video_codec, audio_codec, error)."""
    schema = "format struct<duration: string, bit_rate: string>, streams array<struct<codec_type: string, codec_name: string, width: int, height: int>>"
    doc = probes.select("path", F.from_json("json", schema).alias("d"))
    first = lambda kind: F.get(F.filter("d.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    video, audio = first("video"), first("audio")
    none = F.col("d").isNull() | (F.col("d.streams").isNull() & F.col("d.format").isNull())
    return doc.select("path", F.col("d.format.duration").try_cast("double").alias("seconds"), F.col("d.format.bit_rate").try_cast("long").alias("bit_rate"), video["width"].alias("width"), video["height"].alias("height"), video["codec_name"].alias("video_codec"), audio["codec_name"].alias("audio_codec"), F.when(none, "ffprobe_output_invalid").alias("error"))

"""Names, paths and texts as Column expressions: normal paths, artifact names, URLs, sizes, shares, locales, frame rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Folders of generated artifacts, and the longest name of one.
FOLDERS = ["previews", "candidates", "originals"]
LONGEST = 96
# Metadata of a PNG that a conversion to another format drops.
PNG_METADATA = ["iCCP", "sRGB", "gAMA", "cHRM", "pHYs", "eXIf", "tEXt", "zTXt", "iTXt", "tIME", "bKGD", "sBIT"]
# Frame rate of an animation that says none, and the most that is drawn.
DEFAULT_RATE, TOP_RATE = 20, 120


def normal_path(path: Column) -> Column:
    """A relative path without `.` and `..`; null if it is absolute or leads out of its root."""
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("kept"))

    def step(s, part):
        up = part == ".."
        ok = s["ok"] & ~(up & (F.size(s["kept"]) == 0))
        kept = F.when(up, F.slice(s["kept"], 1, F.greatest(F.size(s["kept"]) - 1, F.lit(0)))).when(part.isin("", "."), s["kept"]).otherwise(F.array_append(s["kept"], part))
        return F.struct(ok.alias("ok"), kept.alias("kept"))

    done = F.aggregate(F.split(path, "/"), start, step)
    return F.when(~path.startswith("/"), F.when(done["ok"], F.array_join(done["kept"], "/")))


def artifact_path(route: Column) -> Column:
    """The report file that a route names: the analysis itself, or a generated artifact in its folder; null for anything else."""
    folder, name = F.regexp_extract(route, "^/([^/]*)/", 1), F.regexp_extract(route, "^/[^/]*/([^/]*)$", 1)
    made = name.rlike(r"^[0-9][A-Za-z0-9.-]*$") & (F.length(name) <= LONGEST) & ~name.contains("..")
    return F.when(route == "/analysis.json", "analysis.json").when(folder.isin(FOLDERS) & made, F.concat_ws("/", folder, name))


def safe_template(template: Column) -> Column:
    """Whether a cache entry's file template is of a known folder, with the place for the row's number first."""
    return template.rlike(r"^(candidates|previews)/\{i\}-[A-Za-z0-9.-]*$") & ~template.contains("..")


def template_of(path: Column, index: Column) -> Column:
    """The template of an artifact written for a row, or null if its name does not begin with the row's number."""
    folder, name = F.regexp_extract(path, "^([^/]*)/", 1), F.regexp_extract(path, "^[^/]*/([^/]*)$", 1)
    mark = F.concat(index.cast("string"), F.lit("-"))
    return F.when(name.startswith(mark), F.concat(folder, F.lit("/{i}-"), F.substring(name, F.length(mark) + 1, F.length(name))))


def asset_url(path: Column) -> Column:
    """A generated artifact's path as a relative URL, or null for any other path."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    bad = F.exists(parts, lambda p: p.isin("", ".", "..") | p.rlike(r"[\x00-\x1F:]"))
    # URLs keep what form encoding would change: a blank is %20, and these marks stay as they are
    quoted = F.transform(parts, lambda p: _unquote(F.url_encode(p)))
    return F.when(parts[0].isin(FOLDERS) & (F.size(parts) > 1) & ~bad, F.array_join(quoted, "/"))


def _unquote(text: Column) -> Column:
    for code, mark in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        text = F.replace(text, F.lit(code), F.lit(mark))
    return text


def size_text(size: Column) -> Column:
    """Bytes in binary units with one or two decimals; a dash for what is no size."""
    out = F.when(size.isNull() | (size < 0), "—").when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    units = ["KiB", "MiB", "GiB", "TiB", "PiB"]
    for n, unit in enumerate(units, 1):
        text = F.regexp_replace(F.format_number(size / float(1024**n), 2), "0$|,", "")
        text = F.concat(text, F.lit(f" {unit}"))
        out = out.when(size < 1024 ** (n + 1), text) if n < len(units) else out.otherwise(text)
    return out


def percent_text(ratio: Column) -> Column:
    """A share in per cent with one decimal; a dash for what is no finite number."""
    finite = ratio.isNotNull() & ~F.isnan(ratio) & (F.abs(ratio) < F.lit(float("inf")))
    return F.when(finite, F.concat(F.regexp_replace(F.format_number(ratio * 100, 1), ",", ""), F.lit("%"))).otherwise("—")


def translated_share(translated: Column, keys: Column) -> Column:
    """Share of a table's keys that a language translates, 1 at most; null without keys."""
    return F.when(keys > 0, F.least(F.coalesce(translated, F.lit(0)) / keys, F.lit(1.0)))


def pick_locale(wanted: Column, offered: list[str]) -> Column:
    """The first wanted locale that is offered, by its whole tag in any case or else by its language; the first offered if none is."""
    low = {o.lower(): o for o in offered}
    by_language = {o.lower().split("-")[0]: o for o in reversed(offered)}
    exact = F.create_map(*[F.lit(x) for kv in low.items() for x in kv])
    loose = F.create_map(*[F.lit(x) for kv in by_language.items() for x in kv])
    found = F.transform(wanted, lambda w: F.coalesce(exact[F.lower(w)], loose[F.get(F.split(F.lower(w), "-"), F.lit(0))]))
    return F.coalesce(F.get(F.array_compact(found), F.lit(0)), F.lit(offered[0]))


def fill_text(template: Column, values: Column) -> Column:
    """A text with {0}, {1}, ... replaced by an array's values; places without a value stay."""
    numbered = F.transform(values, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    return F.aggregate(numbered, template, lambda s, x: F.replace(s, F.concat(F.lit("{"), x["i"].cast("string"), F.lit("}")), x["v"]))


def export_names(files: DataFrame) -> DataFrame:
    """files (seq, path) -> (seq, path, name): names of an export, each once in any case: cleaned, with .png, and repeated ones numbered in front, from 2."""
    from quern.operators.usage import file_name

    clean = F.regexp_replace(F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", ""), r"[^\w.-]+", "-")
    base = F.concat(F.when(clean == "", "image").otherwise(clean), F.lit(".png"))
    n = F.row_number().over(Window.partitionBy(F.lower(base)).orderBy("seq"))
    return files.select("seq", "path", F.when(n == 1, base).otherwise(F.concat(n.cast("string"), F.lit("-"), base)).alias("name"))


def dropped_metadata(chunk_names: Column) -> Column:
    """Names of the metadata chunks that a conversion drops, each once, in file order."""
    return F.array_intersect(chunk_names, F.array(*map(F.lit, PNG_METADATA)))


def frame_rate(rate: Column) -> Column:
    return F.when(rate.isNull() | (rate <= 0), DEFAULT_RATE).otherwise(F.least(rate, F.lit(TOP_RATE)))


def output_size(width: Column, height: Column, cap: Column) -> Column:
    """Struct (width, height) scaled down so that neither side is over cap, each side 1 at least."""
    scale = F.least(F.lit(1.0), cap / F.greatest(width, height))
    side = lambda s: F.greatest(F.floor(s * scale + 0.5).cast("int"), F.lit(1))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def codec_identity(os_name: str, version: str, codecs: dict[str, str]) -> str:
    """What encoders a result depends on, as a part of its key."""
    return "; ".join([f"{os_name} {version}", *[f"{k}/{v}" for k, v in sorted(codecs.items())]])

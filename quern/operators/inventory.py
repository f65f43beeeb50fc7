"""The inventory of a project: files of a tree, classified and joined with what asset catalogs say of them.

files: path, bytes, header, content, as the tree source gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import classify
from quern.operators.usage import file_name
from quern.sources.tree import DEPENDENCIES, EXCLUDED

# Directories whose files count as resources whatever their names; formats that are looked into beside those that can be made smaller.
RESOURCE_DIRECTORIES = ["resources", "resource", "assets", "res"]
INSPECTED = ["zip", "mp4", "vap", "pag", "tcmp4"]
DECODABLE = ["png", "webp"]
CONTENTS = "images array<struct<filename: string, resizing: string>>"


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def _has_extension(path: Column, ext: str) -> Column:
    return F.exists(_parts(path), lambda p: p.rlike(rf"[^/]\.{ext}$"))


def catalog_of(path: Column) -> Column:
    """The outermost asset catalog that a path lies in; null outside of catalogs, and where a folder above is never entered."""
    parts = _parts(path)
    inside = F.slice(parts, 1, F.size(parts) - 1)
    first = F.array_position(F.transform(inside, lambda p: p.rlike(r"[^/]\.xcassets$")), True)
    above = F.slice(inside, 1, F.greatest(first - 1, F.lit(0)).cast("int"))
    barred = F.exists(above, lambda p: p.isin(sorted(EXCLUDED | DEPENDENCIES)))
    return F.when((first > 0) & ~barred, F.array_join(F.slice(parts, 1, first.cast("int")), "/"))


def plain_files(files: DataFrame) -> DataFrame:
    """files less symlinks and what can't be read, where a column `entry` tells."""
    return files.where("entry = 'file'") if "entry" in files.columns else files


def catalogs(files: DataFrame) -> DataFrame:
    """(catalog, entries, refused): every asset catalog, with how many entries are in it.

    A catalog with a symlink or something unreadable anywhere below is refused whole, as parsing it might leave the tree.
    files may have a column entry (file, symlink, unreadable); without it all are files.
    """
    odd = F.col("entry") != "file" if "entry" in files.columns else F.lit(False)
    return files.select(catalog_of(F.col("path")).alias("catalog"), odd.alias("odd")).where("catalog is not null").groupBy("catalog").agg(F.count("*").alias("entries"), F.bool_or("odd").alias("refused"))


def _sets(files: DataFrame) -> DataFrame:
    """(contents_path, folder, contents_sha256, images) of the sets of catalogs that are not refused."""
    plain = plain_files(files)
    refused = catalogs(files).where("refused").select("catalog")
    sets = plain.where(file_name(F.col("path")) == "Contents.json").withColumn("catalog", catalog_of(F.col("path"))).where("catalog is not null").join(refused, "catalog", "left_anti")
    return sets.select(F.col("path").alias("contents_path"), classify.parent(F.col("path")).alias("folder"), F.sha2("content", 256).alias("contents_sha256"), F.from_json(F.col("content").cast("string"), CONTENTS)["images"].alias("images"))


def _plain_name(name: Column) -> Column:
    return (name != "") & ~name.isin(".", "..") & ~name.rlike(r"[/\\:\x00-\x1F]")


def renditions(files: DataFrame) -> DataFrame:
    """Images that the sets of asset catalogs name: (path, bytes, eligible, reason, contents_path, contents_sha256), one row a path.

    A set is a folder of a catalog (see catalog_of() and catalogs()) with a Contents.json; its images must be plain file names of files that are there.
    App icons, sets with resizing and images other than PNG are not eligible. Where several renditions use one file, the
    first that is not eligible counts, else the last, in order of set and place.
    """
    special = F.when(F.col("folder").rlike(r"\.appiconset$"), "app_icon").when(F.exists("images", lambda i: i["resizing"].isNotNull()), "resizing")
    named = _sets(files).select("contents_path", "folder", "contents_sha256", special.alias("special"), F.posexplode("images").alias("place", "image")).where("image.filename is not null")
    name = F.col("image.filename")
    reason = F.coalesce("special", F.when(classify.extension_of(name) != "png", "unsupported_format"))
    rows = named.where(_plain_name(name)).select(F.concat_ws("/", "folder", name).alias("path"), reason.isNull().alias("eligible"), reason.alias("reason"), "contents_path", "contents_sha256", "place")
    spot = F.struct(F.split("contents_path", "/").alias("at"), "place")
    picked = rows.groupBy("path").agg(F.min_by(F.struct("eligible", "reason", "contents_path", "contents_sha256"), F.when(~F.col("eligible"), spot)).alias("bad"), F.max_by(F.struct("eligible", "reason", "contents_path", "contents_sha256"), spot).alias("last"))
    return picked.select("path", F.coalesce("bad", "last").alias("r")).join(plain_files(files).select("path", "bytes"), "path").select("path", "bytes", "r.*")


def unsafe_renditions(files: DataFrame) -> DataFrame:
    """(contents_path, filename): images of catalog sets that are no plain file names, or whose files are not there."""
    named = _sets(files).select("contents_path", F.explode("images").alias("image")).where("image.filename is not null").select("contents_path", "image.filename")
    known = renditions(files).select("path")
    return named.withColumn("path", F.concat_ws("/", classify.parent(F.col("contents_path")), "filename")).join(known, "path", "left_anti").select("contents_path", "filename")


def catalog_diagnostics(files: DataFrame) -> DataFrame:
    """(path, problem) of a catalog scan: refused catalogs, sets without readable contents, images with unsafe names, images that are not there."""
    refused = catalogs(files).where("refused").select(F.col("catalog").alias("path"), F.lit("symlinks_or_unreadable_entries").alias("problem"))
    broken = _sets(files).where("images is null and contents_sha256 is null").select(F.col("contents_path").alias("path"), F.lit("unreadable_contents").alias("problem"))
    odd = unsafe_renditions(files)
    name = F.col("filename")
    problem = F.when(_plain_name(name), "rendition_not_found").otherwise("unsafe_rendition_filename")
    return refused.union(broken).union(odd.select(F.concat_ws("/", classify.parent(F.col("contents_path")), name).alias("path"), problem.alias("problem")))


def can_optimize(kind: Column, fmt: Column) -> Column:
    return ((kind == "image") & fmt.isin(DECODABLE)) | ((kind == "animation") & (fmt == "svga")) | ((kind == "archive") & (fmt == "zip"))


def is_tooling(path: Column, header: Column) -> Column:
    """Whether a file is source, tooling or plain JSON, which the inventory leaves out: JSON anywhere unless it is a Lottie animation, the others outside catalogs and resource directories."""
    ext = classify.extension_of(path)
    resource = F.exists(_parts(path), lambda p: F.lower(p).isin(RESOURCE_DIRECTORIES)) | _has_extension(path, "xcassets")
    json = (ext == "json") & ~classify.looks_like_lottie(header.cast("string"))
    return json | (~resource & classify.is_source_or_tooling(file_name(path), ext))


def inventory(files: DataFrame) -> DataFrame:
    """files -> one row a resource, in order of path parts: path, bytes, kind, format, extension, extension_mismatch, origin, exclusion, format_lock, android, support."""
    path, header = F.col("path"), F.substring("header", 1, 512)
    rows = plain_files(files).where(~is_tooling(path, header)).select("path", "bytes", header.alias("header"), classify.extension_of(path).alias("extension"))
    lottie = F.col("extension") == "json"
    by_name = classify.extension_format(F.col("extension"))
    fmt = F.when(lottie, "lottie").otherwise(F.coalesce(classify.actual_format(F.col("header")), by_name))
    rows = rows.withColumn("format", fmt).withColumn("kind", classify.kind(F.col("format")))
    said = renditions(files).select("path", F.lit(True).alias("referenced"), F.col("reason").alias("said"))
    rows = rows.join(said, "path", "left").withColumn("android", classify.android(path))
    origin = F.when(F.col("referenced"), "catalog_rendition").when(_has_extension(path, "xcassets"), "catalog_file").otherwise("loose_file")
    exclusion = F.when(_has_extension(path, "appiconset"), "app_icon").when(F.col("said") == "resizing", "resizing")
    rows = rows.withColumn("exclusion", exclusion)
    support = F.when(F.col("exclusion").isNotNull(), "excluded").when(can_optimize(F.col("kind"), F.col("format")), "optimizable").otherwise("unsupported")
    mismatch = (F.col("kind") == "image") & (by_name != F.col("format"))
    out = rows.select("path", "bytes", "kind", "format", "extension", mismatch.alias("extension_mismatch"), origin.alias("origin"), "exclusion", classify.format_lock(F.col("android")).alias("format_lock"), "android", support.alias("support"))
    return out.orderBy(_parts(path))


def skipped(files: DataFrame) -> DataFrame:
    """One row: how many files the inventory leaves out as source or tooling."""
    return plain_files(files).agg(F.count_if(is_tooling(F.col("path"), F.substring("header", 1, 512))).alias("skipped_source_or_tooling_files"))


def project_kinds(files: DataFrame, resources: DataFrame) -> DataFrame:
    """One row: the kinds of project that a tree holds, in order; `directory` if none. Folders count by the files in them."""
    parts = _parts(F.col("path"))
    name = file_name(F.col("path"))
    seen = files.agg(
        F.coalesce(F.bool_or(F.exists(parts, lambda p: p.rlike(r"\.(xcodeproj|xcworkspace)$"))), F.lit(False)).alias("xcode"), F.coalesce(F.bool_or(name == "Package.swift"), F.lit(False)).alias("swift"),
        F.coalesce(F.bool_or(name == "AndroidManifest.xml"), F.lit(False)).alias("manifest"), F.coalesce(F.bool_or(_has_extension(F.col("path"), "xcassets")), F.lit(False)).alias("catalog"),
    )
    mobile = resources.agg(F.coalesce(F.bool_or(F.col("android").isNotNull()), F.lit(False)).alias("res"))  # one row
    both = seen.crossJoin(F.broadcast(mobile))
    kinds = F.array_compact(F.array(F.when(F.col("manifest") | F.col("res"), "android"), F.when(F.col("swift"), "swift_package"), F.when(F.col("xcode") | (F.col("catalog") & ~F.col("swift")), "xcode")))
    return both.select(F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("directory"))).alias("project_kinds"))


def is_media() -> Column:
    return F.col("kind").isin("audio", "video") & F.col("exclusion").isNull()


def is_localization() -> Column:
    """Whether a resource's file may hold translations: string tables, and XML of a values directory."""
    values = (F.col("extension") == "xml") & F.coalesce((F.col("android.area") == "res") & (F.col("android.res_type") == "values"), F.lit(False))
    return F.col("exclusion").isNull() & (F.col("format").isin("xcstrings", "strings", "stringsdict") | values)


def route(resources: DataFrame, probe_only: bool = False, media_probe: bool = False) -> DataFrame:
    """Adds route: localization, work or settled."""
    work = (F.col("support") == "optimizable") | F.col("format").isin(INSPECTED) | ((F.col("kind") == "image") & F.lit(probe_only)) | (is_media() & F.lit(media_probe))
    return resources.withColumn("route", F.when(is_localization(), "localization").when(work, "work").otherwise("settled"))


def work_order(routed: DataFrame) -> DataFrame:
    """Settled rows first, in path order; then the rest, largest first."""
    rank = F.when(F.col("route") == "settled", 0).when(F.col("route") == "work", 1).otherwise(2)
    return routed.orderBy(rank, F.when(F.col("route") == "work", -F.col("bytes")), _parts(F.col("path")))


def settled_rows(routed: DataFrame, media_probe: bool = False) -> DataFrame:
    """(path, status, issues) of rows that need no decoding: excluded with its reason, or unsupported with what is missing."""
    decoding = F.when(F.col("kind") == "image", F.concat("format", F.lit("_decoding_requires_macos_imageio"))).otherwise(F.concat("kind", F.lit("_optimization_backend_not_implemented")))
    probe = F.when(is_media() & F.lit(not media_probe), "ffprobe_not_installed")
    excluded = F.col("exclusion").isNotNull()
    issues = F.when(excluded, F.array("exclusion")).otherwise(F.array_compact(F.array(probe, decoding)))
    return routed.where(F.col("route") == "settled").select("path", F.when(excluded, "excluded").otherwise("unsupported").alias("status"), issues.alias("issues"))


def mark_cancelled(rows: DataFrame, resources: DataFrame) -> DataFrame:
    """Rows (path, status, ...) of an analysis that was stopped, and a row `not_analyzed` for each resource that has none."""
    rest = resources.select("path").join(rows.select("path"), "path", "left_anti").withColumn("status", F.lit("not_analyzed"))
    return rows.unionByName(rest, allowMissingColumns=True)

"""Whole tasks on a project's folder, as functions that return DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import classify
from quern.operators import candidates as c
from quern.operators import diff, inventory, localization, similarity, usage
from quern.operators import report as reports
from quern.sources import l10n, media, zipdir
from quern.sources.tree import TreeSource


def tree(spark: SparkSession, root: str, include_ignored: bool = False, links: bool = False) -> DataFrame:
    """Files of a project: path, entry, bytes, header, content; with links, symlinks and unreadable entries too."""
    spark.dataSource.register(TreeSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("quern_tree").options(include_ignored=str(include_ignored).lower(), links=str(links).lower(), push_filters=push).load(root)


def catalogs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The images that a project's asset catalogs name, and what is wrong with catalogs."""
    files = tree(spark, root, links=True)
    return inventory.renditions(files), inventory.catalog_diagnostics(files)


def scan(spark: SparkSession, root: str, include_ignored: bool = False) -> DataFrame:
    """The project's inventory, with the way that each resource takes."""
    return inventory.route(inventory.inventory(tree(spark, root, include_ignored)))


def _pngs(files: DataFrame, resources: DataFrame) -> DataFrame:
    return files.where("entry = 'file' and content is not null").join(resources.where("kind = 'image' and format = 'png' and exclusion is null").select("path"), "path", "left_semi")


def fingerprints(files: DataFrame, resources: DataFrame) -> DataFrame:
    """(path, width, height, frames, luma, alpha, red, green, blue, detailed, error) of a project's PNG images: grids in hex."""
    seen = media.images(_pngs(files, resources))
    prints = similarity.fingerprint(seen.where("error is null").select(F.col("path").alias("id"), "width", "height", "rgba"))
    return seen.drop("rgba").join(prints.withColumnRenamed("id", "path"), "path", "left").select("path", "width", "height", "frames", "luma", "alpha", "red", "green", "blue", "detailed", "error")


def analyze(spark: SparkSession, root: str, options: c.AnalysisOptions | None = None, include_ignored: bool = False) -> tuple[DataFrame, DataFrame]:
    """From a project's files to its report's tables: resources with their status and fingerprint, and candidates with their verdict.

    PNG images are recompressed; other encoders are not part of this library, so what needs one stays as the inventory says.
    status: candidates_available, inspected (decoded, nothing smaller), failed (could not be decoded), excluded, unsupported, inventory_only.
    """
    files = tree(spark, root, include_ignored, links=True)
    resources = inventory.route(inventory.inventory(files))
    made = media.recompressed(_pngs(files, resources))
    first = made.where("new_bytes is not null").select(F.col("path").alias("resource"), F.lit(0).alias("candidate"), F.lit("png").alias("format"), F.lit(False).alias("lossy"), F.col("new_bytes").cast("long").alias("bytes"), (F.col("bytes") - F.col("new_bytes")).cast("long").alias("savings_bytes"), F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("alpha_error"), F.lit(False).alias("transparency_changed"))
    candidates = c.verdicts(first, options or c.AnalysisOptions())
    settled = inventory.settled_rows(resources).select("path", F.col("status").alias("settled"), "issues")
    best = c.recommended(candidates).select(F.col("resource").alias("path"), F.col("savings_bytes").alias("savings"))
    rows = resources.join(fingerprints(files, resources), "path", "left").join(settled, "path", "left").join(best, "path", "left")
    decoded = F.when(F.col("error").isNotNull(), "failed").when(F.col("width").isNotNull(), "inspected")
    status = F.coalesce(F.when(F.col("savings").isNotNull(), "candidates_available"), decoded, "settled", F.lit("inventory_only"))
    return rows.select(*resources.columns, "width", "height", "frames", "luma", "alpha", "red", "green", "blue", "detailed", status.alias("status"), "issues", F.coalesce("savings", F.lit(0).cast("long")).alias("savings"), "error"), candidates


def report(spark: SparkSession, root: str) -> DataFrame:
    """How many resources of a project have each status, and what their recommended candidates save."""
    return reports.status_counts(analyze(spark, root)[0])


def similar_groups(spark: SparkSession, root: str) -> DataFrame:
    """(path, reference): groups of images of a project that are the same or look alike, around the largest, first by path."""
    files = tree(spark, root, links=True)
    resources = inventory.inventory(files)
    prints = fingerprints(files, resources).where("error is null")
    known = prints.join(_pngs(files, resources).select("path", F.sha2("content", 256).alias("sha256")), "path").join(resources.select("path", "bytes"), "path")
    grid = lambda n: similarity.decode_grid(F.col(n)).alias(n)
    entries = known.select(F.split("path", "/").alias("id"), "bytes", classify.variant_key(F.col("path")).alias("variant"), "frames", "width", "height", grid("luma"), grid("alpha"), "red", "green", "blue", "detailed", "sha256")
    groups = similarity.image_groups(entries)
    return groups.select(F.array_join("id", "/").alias("path"), F.array_join("reference", "/").alias("reference"))


def min_sdk(spark: SparkSession, root: str) -> DataFrame:
    files = tree(spark, root).where(usage.file_name(F.col("path")).isin(usage.CATALOG, *usage.BUILDS))
    return usage.min_sdk(files.select("path", F.col("content").cast("string").alias("text")))


def translations(spark: SparkSession, root: str) -> DataFrame:
    """Coverage of every localization table of a project."""
    return localization.table_coverage(localization.tables(l10n.localization_entries(tree(spark, root))))


def android_usage(spark: SparkSession, root: str) -> DataFrame:
    """Where the project's Android resources are used."""
    files = tree(spark, root)
    named = inventory.inventory(files).where("android.area = 'res' and android.name is not null").select(F.col("android.res_type").alias("type"), F.col("android.name").alias("name")).distinct()
    return usage.usage(named, files.select("path", F.col("content").cast("string").alias("text")))


def package_diff(spark: SparkSession, before: str, after: str) -> DataFrame:
    """Entries whose compressed size differs between two ZIP packages, largest difference first. Raises ValueError if either is no package."""
    sides = []
    for path in (before, after):
        entries = zipdir.package_entries(spark.read.format("binaryFile").load(path).select("path", "content"))
        bad = entries.where("error is not null").first()
        if bad:
            raise ValueError(f"{path}: {bad['error']}")
        sides.append(entries.select("name", "compressed_bytes"))
    return diff.largest_first(diff.package_diff(*sides))


def plan_batch(resources: DataFrame, candidates: DataFrame, policy: c.BatchPolicy) -> tuple[DataFrame, DataFrame]:
    """What a policy would apply, and why other resources are left out."""
    items = c.batch_items(resources, candidates, policy)
    return items, c.exclusion_reasons(resources, candidates, items, policy)

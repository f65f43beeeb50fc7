"""Archive checks over entries (archive, name, directory, bytes, compressed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of an archive that is looked into.
MAX_INPUT, MAX_ENTRIES, MAX_ENTRY, MAX_TOTAL, PREVIEWS = 64 << 20, 10_000, 64 << 20, 256 << 20, 32


def totals(entries: DataFrame) -> DataFrame:
    """For each archive its entries, sums and the first limit it breaks. A sum that 64 bits don't hold is null and a problem, not an error of the query."""
    out = entries.groupBy("archive").agg(F.count("*").alias("entries"), F.try_sum("bytes").alias("expanded_bytes"), F.try_sum("compressed").alias("compressed_bytes"), F.max("bytes").alias("largest"), F.count("bytes").alias("sized"))
    over = F.col("expanded_bytes").isNull() & (F.col("sized") > 0)
    problem = F.when(F.col("entries") > MAX_ENTRIES, "too_many_entries").when(F.col("largest") > MAX_ENTRY, "entry_too_large").when(over, "archive_size_overflow").when(F.col("expanded_bytes") > MAX_TOTAL, "archive_too_large")
    return out.withColumn("problem", problem).drop("sized")


def largest_entries(entries: DataFrame, n: int = PREVIEWS) -> DataFrame:
    """The n largest entries of each archive, ties by name, with their rank."""
    w = Window.partitionBy("archive").orderBy(F.desc("bytes"), "name")
    return entries.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def prefix_conflicts(entries: DataFrame) -> DataFrame:
    """(archive, name): files whose name is a folder of another entry, in any case. Each name gives its ancestors once; the join is on equality."""
    parts = F.split(F.lower("name"), "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    folders = entries.where(F.size(parts) > 1).select("archive", F.explode(above).alias("folder")).distinct()
    files = entries.where(~F.col("name").endswith("/")).select("archive", "name", F.lower("name").alias("folder")).distinct()
    return files.join(folders, ["archive", "folder"], "left_semi").select("archive", "name")


def entry_filter(entries: DataFrame, query: str = "", fmt: str | None = None) -> DataFrame:
    """Entries (path, format, ...) whose path has the query in it, in any case, and that are of the format, if one is given."""
    out = entries.where(F.lower("path").contains(query.strip().lower()))
    return out.where(F.col("format") == fmt) if fmt else out


def _packed(sha256: Column) -> Column:
    """A hash in hex as half as many bytes, after a mark; any other text as it is, after another. Equal for equal texts only. Out of an array of one, so that the hash is worked out once."""

    def pack(h: Column) -> Column:
        hexed = F.lower(F.hex(F.unhex(h))) == h
        return F.when(hexed, F.concat(F.lit(b"\x01"), F.unhex(h))).otherwise(F.concat(F.lit(b"\x00"), h.cast("binary")))

    return F.get(F.transform(F.array(sha256), pack), F.lit(0))


def _unpacked(packed: Column) -> Column:
    rest = F.substring(packed, 2, 1 << 30)
    return F.when(F.substring(packed, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def compare_archives(before: DataFrame, after: DataFrame, contracts: DataFrame | None = None, pictures: DataFrame | None = None) -> DataFrame:
    """Whether archives were rewritten with nothing but their pictures' encoding changed: (archive, verdict, position).

    before, after: (archive, position, comment, meta, sha256, png, metadata, integrity): an entry's place, its archive's
    comment, what is compared as it is (a struct or string), its payload's hash, whether that is a PNG, whether the entry
    is metadata, and whether its JSON holds hashes of others. contracts (archive): archives that only their publisher may
    change. pictures (sha256, other, same): payloads that were decoded and compared, each pair of contents once; see
    changed_pictures(), which gives the pairs to decode. One that is missing there counts as changed.

    verdict is null for a sound archive, else the first thing wrong: the contract, the structure (a place that is missing or
    taken twice, another comment, one side missing), then by position the entry's metadata, a hash contract, a payload
    that is no picture, pixels. Sides meet in an outer join on archive and position, by hashes; no payload is shuffled.
    """
    rows = lambda df, n: df.where("archive is not null").groupBy("archive", "position").agg(F.count("*").alias(f"n_{n}"), F.first(F.struct("comment", "meta", _packed(F.col("sha256")).alias("sha256"), "png", "metadata", "integrity")).alias(n))
    both = rows(before, "a").join(rows(after, "b"), ["archive", "position"], "full")
    torn = F.col("a").isNull() | F.col("b").isNull() | (F.coalesce("n_a", F.lit(0)) != 1) | (F.coalesce("n_b", F.lit(0)) != 1) | ~F.col("a.comment").eqNullSafe(F.col("b.comment"))
    differs = ~F.col("a.sha256").eqNullSafe(F.col("b.sha256"))
    picture = F.coalesce(F.col("a.png") & ~F.col("a.metadata"), F.lit(False))
    fault = (
        F.when(~F.col("a.meta").eqNullSafe(F.col("b.meta")), "archive_entry_metadata_changed")
        .when(F.coalesce(F.col("a.integrity") & ~F.col("a.metadata"), F.lit(False)), "archive_integrity_contract_requires_publisher")
        .when(differs & ~picture, "archive_non_image_payload_changed")
        .when(differs, "archive_image_pixels_changed")
    )
    both = both.select("archive", "position", torn.alias("torn"), fault.alias("fault"), F.col("a.sha256").alias("_a"), F.col("b.sha256").alias("_b"))
    pixels = F.coalesce(F.col("fault") == "archive_image_pixels_changed", F.lit(False))
    judge = lambda df: df.groupBy("archive").agg(F.bool_or("torn").alias("torn"), F.min(F.when(F.col("fault").isNotNull(), F.struct("position", "fault"))).alias("first"))
    if pictures is None:
        judged = judge(both)
    else:
        # Only entries that pixels decide meet the pictures, and of an archive's others one row goes on from each task.
        pictures = pictures.select(_packed(F.col("sha256")).alias("sha256"), _packed(F.col("other")).alias("other"), "same")
        known = pictures.where("same").select(F.col("sha256").alias("_a"), F.col("other").alias("_b")).join(pictures.where("not same or same is null").select(F.col("sha256").alias("_a"), F.col("other").alias("_b")), ["_a", "_b"], "left_anti").distinct()
        open_ = both.where(pixels).join(known, ["_a", "_b"], "left_anti")
        rest = both.withColumn("fault", F.when(~pixels, F.col("fault")))
        judged = judge(rest.select("archive", "position", "torn", "fault").union(open_.select("archive", "position", "torn", "fault")))
    held = contracts.select("archive", F.lit(True).alias("held")).distinct() if contracts is not None else None
    judged = judged.join(held, "archive", "left") if held is not None else judged.withColumn("held", F.lit(False))
    whole = F.when(F.coalesce("held", F.lit(False)), "archive_integrity_contract_requires_publisher").when(F.col("torn"), "archive_structure_changed")
    return judged.select("archive", F.coalesce(whole, F.col("first.fault")).alias("verdict"), F.when(whole.isNull(), F.col("first.position")).alias("position"))


def changed_pictures(before: DataFrame, after: DataFrame) -> DataFrame:
    """(sha256, other): the pairs of PNG contents that stand at one place of an archive before and after and differ, each once."""
    a = before.where("png and not metadata and archive is not null").select("archive", "position", _packed(F.col("sha256")).alias("sha256"))
    b = after.select("archive", "position", _packed(F.col("sha256")).alias("other"))
    found = a.join(b, ["archive", "position"]).where("sha256 <> other").select("sha256", "other").distinct()
    return found.select(_unpacked(F.col("sha256")).alias("sha256"), _unpacked(F.col("other")).alias("other"))

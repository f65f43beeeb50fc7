"""Where resource names are used, and the lowest API level of a project's builds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_FILES = 20
# Names of a build's setting, and catalog keys that stand for it where no build sets it.
SETTINGS = ["minSdk", "minSdkVersion"]
FALLBACKS = ["minsdk", "minsdkversion", "androidminsdk"]
CATALOG, BUILDS = "libs.versions.toml", ["build.gradle", "build.gradle.kts"]


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def references(files: DataFrame) -> DataFrame:
    """files (path, text) -> (type, name, path, xml, code): how often each file names each resource.

    XML names one as @type/name, @+type/name or @android:type/name, Kotlin and Java as R.type.name, with or without white
    space around the dots. A name is a run of letters, digits and low lines. Other files don't count.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    xml, code = ext == "xml", ext.isin("kt", "java")
    none = F.array().cast("array<string>")
    found = F.when(xml, F.regexp_extract_all("text", F.lit(r"(@(?:\+|android:)?[a-z]+/\w+)"), F.lit(1))).when(code, F.regexp_extract_all("text", F.lit(r"\b(R\s*\.\s*[a-z]+\s*\.\s*\w+)"), F.lit(1))).otherwise(none)
    hits = files.select("path", xml.alias("xml"), F.explode(found).alias("token"))
    words = F.regexp_extract_all("token", F.lit(r"(\w+)"), F.lit(1))
    hits = hits.select("path", "xml", F.element_at(words, -2).alias("type"), F.element_at(words, -1).alias("name"))
    return hits.groupBy("type", "name", "path").agg(F.count_if("xml").alias("xml"), F.count_if(~F.col("xml")).alias("code"))


def usage(names: DataFrame, files: DataFrame) -> DataFrame:
    """names (type, name), files (path, text) -> (type, name, xml_references, code_references, files, dynamic_lookup_files).

    files lists the first 20 paths, by their parts. Kotlin and Java files with getIdentifier( are counted over the
    project, whatever the name. The join is on equality, after each file's counts; only 20 paths of a name are gathered.
    """
    per = references(files).join(names.select("type", "name").distinct(), ["type", "name"])
    sums = per.groupBy("type", "name").agg(F.sum("xml").alias("xml_references"), F.sum("code").alias("code_references"))
    order = Window.partitionBy("type", "name").orderBy(F.split("path", "/"))
    first = per.withColumn("n", F.row_number().over(order)).where(F.col("n") <= MAX_FILES)
    first = first.groupBy("type", "name").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "path"))), lambda x: x["path"]).alias("files"))
    code = F.lower("path").rlike(r"\.(kt|java)$")
    dynamic = files.agg(F.count_if(code & F.col("text").contains("getIdentifier(")).alias("dynamic_lookup_files"))
    out = names.join(sums, ["type", "name"], "left").join(first, ["type", "name"], "left").crossJoin(F.broadcast(dynamic))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("type", "name", zero("xml_references"), zero("code_references"), F.coalesce("files", F.array().cast("array<string>")).alias("files"), "dynamic_lookup_files")


def catalog_key(name: Column) -> Column:
    """A version catalog's name without case and marks."""
    return F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.explode(F.split("text", r"\r?\n")).alias("line"))


def catalog_levels(files: DataFrame) -> DataFrame:
    """Version catalogs (path, text) -> (key, level, source): entries whose value is a quoted whole number of up to three digits; the last path's counts."""
    sides = F.split("line", "=", 2)
    name, value = F.trim(sides[0]), F.split(F.trim(F.get(sides, F.lit(1))), '"')
    after = F.trim(F.get(value, F.lit(2)))
    plain = name.rlike(r"^[\w.-]+$") & (F.get(value, F.lit(0)) == "") & F.get(value, F.lit(1)).rlike(r"^\d{1,3}$") & (F.size(value) > 2) & ((after == "") | after.startswith("#"))
    entries = _lines(files).where(plain).select("path", catalog_key(name).alias("key"), value[1].cast("int").alias("level"))
    return entries.groupBy("key").agg(F.max_by(F.struct("level", F.col("path").alias("source")), F.split("path", "/")).alias("c")).select("key", "c.*")


def build_settings(files: DataFrame) -> DataFrame:
    """Build files (path, text) -> (source, level, key): what lines that begin with the setting's name assign: a number, or a lookup in a version catalog.

    A line is read as words and marks: the name, an equals sign or bracket or neither, and the number. A lookup may
    stand anywhere after the name.
    """
    words = F.regexp_extract_all("line", F.lit(r"(\w+|[^\w\s])"), F.lit(1))
    lines = _lines(files).withColumn("words", words).where(F.get("words", F.lit(0)).isin(SETTINGS))
    second = F.get("words", F.lit(1))
    number = F.when(second.isin("=", "("), F.get("words", F.lit(2))).otherwise(second)
    level = F.when(number.rlike(r"^\d{1,3}$"), number.cast("int"))
    tails = F.transform(F.slice(F.split("line", r"libs\.versions\."), 2, 1000), lambda t: F.when(t.contains(".get()"), F.substring_index(t, ".get()", 1)))
    lookup = F.get(F.filter(tails, lambda t: t.rlike(r"^[\w.]+$")), F.lit(0))
    return lines.select(F.col("path").alias("source"), level.alias("level"), catalog_key(lookup).alias("key")).where("level is not null or key is not null")


def min_sdk(files: DataFrame) -> DataFrame:
    """files (path, text) of a project -> one row (level, source): the lowest minSdk that its builds set, ties by path.

    Literals count, and lookups of a version catalog; if there are neither, catalog entries named like it. Levels outside
    1 to 99 are left out. An empty result where nothing is said.
    """
    name = file_name(F.col("path"))
    catalog = catalog_levels(files.where(name == CATALOG))
    set_by = build_settings(files.where(name.isin(BUILDS)))
    literal = set_by.where("level is not null").select("level", "source")
    lookup = set_by.where("key is not null").select("key").join(catalog, "key").select("level", "source")
    found = literal.union(lookup).withColumn("rank", F.lit(0)).union(catalog.where(F.col("key").isin(FALLBACKS)).select("level", "source", F.lit(1)))
    best = found.agg(F.min("rank").alias("best"))  # one row
    found = found.crossJoin(F.broadcast(best)).where("rank = best and level between 1 and 99")
    return found.agg(F.min(F.struct("level", "source")).alias("m")).where("m is not null").select("m.*")


def uniqueness(paths: DataFrame) -> DataFrame:
    """paths (path) -> (path, basename_unique, lookup_unique): whether no other path has its file name, in any ASCII case, and no other image file its lookup name."""
    from quern.functions.classify import ascii_lower, extension_of, lookup_name

    image = extension_of(F.col("path")).isin("png", "jpg", "jpeg", "heic", "heif", "webp", "gif", "imageset")
    rows = paths.select("path", ascii_lower(file_name(F.col("path"))).alias("base"), lookup_name(F.col("path")).alias("lookup"), image.alias("image"))
    bases = rows.groupBy("base").agg(F.count("*").alias("same_base"))
    lookups = rows.where("image").groupBy("lookup").agg(F.count("*").alias("same_lookup"))
    out = rows.join(bases, "base").join(lookups, "lookup", "left")
    others = F.coalesce("same_lookup", F.lit(0)) - F.col("image").cast("int")
    return out.select("path", (F.col("same_base") == 1).alias("basename_unique"), (others == 0).alias("lookup_unique"))

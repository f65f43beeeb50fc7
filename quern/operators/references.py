"""References to resources in a project's texts, resolved against the paths that are there. Nothing is rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.classify import ascii_lower, extension_of, parent
from quern.functions.naming import normal_path
from quern.operators.usage import file_name

# Extensions of files whose texts are read, and of what counts as an image.
TEXTS = ["swift", "kt", "kts", "java", "gradle", "m", "mm", "h", "pbxproj", "plist", "storyboard", "xib", "json", "html", "htm", "css", "scss", "js", "ts", "jsx", "tsx", "md", "xml", "yaml", "yml"]
IMAGES = ["png", "jpg", "jpeg", "heic", "heif", "webp", "gif"]


def literals(files: DataFrame) -> DataFrame:
    """files (path, text) -> (path, value, n): quoted strings, url(...) and ](...) targets, and text of XML strings that end like an image's name, with how often each occurs."""
    marks = [r"[\"]([^\"\r\n]*)[\"]", r"[']([^'\r\n]*)[']", r"[`]([^`\r\n]*)[`]", r"(?:url\(|\]\()\s*([^\s\"'()]+)\s*\)", r"<string>([^<>]*)</string>"]
    found = F.concat(*[F.regexp_extract_all("text", F.lit(m), F.lit(1)) for m in marks])
    rows = files.where(extension_of(F.col("path")).isin(TEXTS)).select("path", F.explode(found).alias("value"))
    ends = "|".join(IMAGES)
    return rows.where(F.col("value").rlike(rf"(?i)\.({ends})([?#]|$)")).groupBy("path", "value").agg(F.count("*").alias("n"))


def resolve(references: DataFrame, paths: DataFrame) -> DataFrame:
    """references (path: the file, value), paths (path: all resources) -> (path, value, source, how), one row for each resource that a reference may mean.

    how: `local`, from the file's own folder, which hides every other reading; `exact`, from the root; `suffix`, the end of a path whose
    file name is the only one of its kind, in any ASCII case; `ambiguous`, the end of a path with a name that others have
    too; `missing`, `escaped` (with a backslash) and `outside` (URLs, data, absolute paths) have no source. What follows ? or # is not
    looked at. Suffixes are found by equality: each path gives one row for each of its ends, and the longest reading is
    the only one that a reference can equal.
    """
    refs = references.select("path", "value").distinct()
    target = F.regexp_extract("value", r"^[^?#]*", 0)
    outside = F.col("value").contains("://") | F.col("value").startswith("data:") | F.col("value").startswith("/")
    refs = refs.withColumn("target", target).withColumn("state", F.when(outside, "outside").when(F.col("target").contains("\\"), "escaped"))
    settled = refs.where("state is not null").select("path", "value", F.lit(None).cast("string").alias("source"), F.col("state").alias("how"))
    live = refs.where("state is null")
    known = paths.select(F.col("path").alias("source")).distinct()
    here = F.when(parent(F.col("path")) == "", F.col("target")).otherwise(F.concat_ws("/", parent(F.col("path")), "target"))
    local = live.withColumn("source", normal_path(here)).join(known, "source").select("path", "value", "source", F.lit("local").alias("how"))
    rest = live.join(local.select("path", "value"), ["path", "value"], "left_anti")
    exact = rest.withColumn("source", normal_path(F.col("target"))).join(known, "source").select("path", "value", "source", F.lit("exact").alias("how"))
    parts = F.split("source", "/")
    ends = known.select("source", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("end"))
    names = known.groupBy(ascii_lower(file_name(F.col("source"))).alias("name")).agg(F.count("*").alias("same"))
    clean = F.regexp_replace(F.regexp_replace("target", "/+", "/"), "(?<=.)/$", "")
    suffix = rest.withColumn("end", clean).join(ends, "end").join(exact.select("path", "value", "source"), ["path", "value", "source"], "left_anti")
    suffix = suffix.withColumn("name", ascii_lower(file_name(F.col("source")))).join(names, "name")
    suffix = suffix.select("path", "value", "source", F.when(F.col("same") == 1, "suffix").otherwise("ambiguous").alias("how"))
    found = local.union(exact).union(suffix)
    missing = live.join(found.select("path", "value").distinct(), ["path", "value"], "left_anti").select("path", "value", F.lit(None).cast("string").alias("source"), F.lit("missing").alias("how"))
    return found.union(missing).union(settled)

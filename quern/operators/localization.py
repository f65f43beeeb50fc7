"""Localization coverage and placeholder checks.

entries: language, key, value_kind (singular, plural, empty), value, status, stale, translatable, seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.storage import checkpoint, save, workspace

# Fixed value: a printf token; a space after the sign is prose.
TOKEN = r"%%|%(?:\d+\$)?[-+#0]*\d*(?:\.\d+)?(?:hh|h|ll|l|q|z|t|j|L)?[@diouxXeEfFgGaAcCsSp]"
MAX_ISSUES, MAX_TEXT = 500, 160
LANGUAGES = 10_000


def signature(value: Column) -> Column:
    """Arguments (place, letter) in order of place. Unnumbered ones count by occurrence; an object counts as a string."""
    tokens = F.filter(F.regexp_extract_all(value, F.lit(f"({TOKEN})"), F.lit(1)), lambda t: t != "%%")

    def one(token: Column, i: Column) -> Column:
        place, letter = F.regexp_extract(token, r"^%(\d+)\$", 1), F.right(token, F.lit(1))
        return F.struct(F.when(place != "", place.cast("int")).otherwise(i + 1).alias("place"), F.when(letter == "@", "s").otherwise(letter).alias("letter"))

    return F.array_sort(F.transform(tokens, one))


def arguments(value: Column) -> Column:
    """Argument classes in order of position, as `1d` `2s`: whole numbers are d, broken ones f."""

    def kind(letter: Column) -> Column:
        low = F.lower(letter)
        return F.when(low.isin("d", "i", "u", "o", "x"), "d").when(low.isin("f", "e", "g", "a"), "f").otherwise(low)

    return F.transform(signature(value), lambda a: F.concat(a["place"].cast("string"), kind(a["letter"])))


def display(value: Column) -> Column:
    """Arguments as they are shown in issues: `%1$d`."""
    return F.transform(signature(value), lambda a: F.concat(F.lit("%"), a["place"].cast("string"), F.lit("$"), a["letter"]))


def argument_mismatch(expected: Column, found: Column) -> Column:
    """placeholder_type when only classes differ, placeholder_count when positions do, null when equal."""
    places = lambda a: F.transform(a, lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return F.when(expected == found, None).when(places(expected) == places(found), "placeholder_type").otherwise("placeholder_count")


def shortened(text: Column) -> Column:
    return F.when(F.length(text) > MAX_TEXT, F.concat(F.substring(text, 1, MAX_TEXT), F.lit("…"))).otherwise(text)


def last_wins(entries: DataFrame) -> DataFrame:
    """One entry for each language and key: the one of greatest seq."""
    rest = [c for c in entries.columns if c not in ("language", "key")]
    return entries.groupBy("language", "key").agg(F.max_by(F.struct(*rest), "seq").alias("e")).select("language", "key", "e.*")


def source_language(entries: DataFrame, declared: str | None = None) -> DataFrame:
    """One row: the declared language, whether it has entries or not, else Base, default or en if there, else the one of most entries (ties to the smaller name)."""
    counts = entries.groupBy("language").agg(F.count("*").alias("n"))
    first = F.when(F.col("language") == "Base", 1).when(F.col("language") == "default", 2).when(F.col("language") == "en", 3).otherwise(4)
    best = F.min_by("language", F.struct(first.alias("p"), F.when(first == 4, -F.col("n")).otherwise(0).alias("n"), "language"))
    return counts.agg((F.lit(declared) if declared else best).alias("language"))


def checked_keys(entries: DataFrame, source: str) -> DataFrame:
    """Keys to compare: not marked as untranslatable in any language, and in the source language if that has entries."""
    barred = entries.where(~F.col("translatable")).select("key").distinct()
    held = entries.where(F.col("language") == source).select("key").distinct()
    keys = entries.select("key").distinct().join(barred, "key", "left_anti")
    return keys.join(held, "key", "left_semi") if held.limit(1).count() else keys


def cells(entries: DataFrame, source: str, key_is_text: bool = False) -> DataFrame:
    """One row for each language and checked key: outcome (translated, missing, empty), needs_review, issue kind, text.

    Languages are counted first and broadcast, as a corpus has some hundreds at most; with more than LANGUAGES of them
    Spark chooses how to build the product. Entries and source values join by key.
    """
    keys, languages = checked_keys(entries, source), entries.select("language").distinct()
    few = languages.limit(LANGUAGES + 1).count() <= LANGUAGES
    grid = keys.crossJoin(F.broadcast(languages)) if few else keys.crossJoin(languages)  # the result itself has a row for each language and key
    own = entries.select("language", "key", "value_kind", "value", "status", F.lit(True).alias("here"))
    origin = entries.where((F.col("language") == source) & (F.col("value_kind") == "singular")).select("key", F.col("value").alias("original"))
    out = grid.join(own, ["language", "key"], "left").join(origin, "key", "left")
    text = F.col("value_kind") == "singular"
    outcome = F.when(F.col("here").isNull(), "missing").when(text & (F.col("value") == ""), "empty").when(text | (F.col("value_kind") == "plural"), "translated")
    outcome = outcome.when(F.lit(key_is_text) & (F.col("language") == source), "translated").otherwise("missing")
    out = out.withColumn("outcome", outcome).withColumn("expected", arguments(F.col("original"))).withColumn("found", arguments(F.col("value")))
    compare = (F.col("outcome") == "translated") & text & (F.col("language") != source) & F.col("original").isNotNull()
    issue = F.when(F.col("outcome") == "empty", "empty_value").when(compare, argument_mismatch(F.col("expected"), F.col("found")))
    review = (F.col("outcome") == "translated") & F.coalesce(F.col("status").isin("needs_review", "stale"), F.lit(False))
    return out.select("language", "key", "outcome", review.alias("needs_review"), issue.alias("issue"), "expected", "found", "value", "original")


def coverage(entries: DataFrame, source: str, key_is_text: bool = False) -> DataFrame:
    """A row for each language: translated, missing, empty, needs_review, extra and issues."""
    count = lambda cond, name: F.count_if(cond).alias(name)
    done = cells(entries, source, key_is_text).groupBy("language").agg(*[count(F.col("outcome") == o, o) for o in ("translated", "missing", "empty")], count(F.col("needs_review"), "needs_review"), count(F.col("issue").isNotNull(), "issues"))
    extra = extra_keys(entries, source).groupBy("language").agg(F.count("*").alias("extra"))
    return done.join(extra, "language", "left").withColumn("extra", F.coalesce("extra", F.lit(0)))


def extra_keys(entries: DataFrame, source: str) -> DataFrame:
    """Keys of other languages that the source lacks and nobody marks as untranslatable; none if the source has no entry."""
    held = entries.where(F.col("language") == source).select("key").distinct()
    barred = entries.where(~F.col("translatable")).select("key").distinct()
    if not held.limit(1).count():
        return entries.select("language", "key").limit(0)
    return entries.where(F.col("language") != source).select("language", "key").join(held, "key", "left_anti").join(barred, "key", "left_anti").select("language", "key")


def issues(entries: DataFrame, source: str, key_is_text: bool = False) -> DataFrame:
    """(kind, key, language, expected, found, text): mismatches show both sides' arguments, empty values neither."""
    wrong = F.col("issue") != "empty_value"
    shown = lambda c: F.when(wrong, F.array_join(display(F.col(c)), " ")).otherwise("").alias(c)
    rows = cells(entries, source, key_is_text).where(F.col("issue").isNotNull()).select(F.col("issue"), "key", "language", F.col("original").alias("expected"), F.col("value").alias("found"), "value")
    return rows.select(F.col("issue").alias("kind"), "key", "language", shown("expected"), shown("found"), shortened(F.coalesce("value", F.lit(""))).alias("text"))


def issue_filter(rows: DataFrame, query: str = "", kind: str | None = None) -> DataFrame:
    """Issues of a kind, if one is given, that have all words of the query in key, language, text, expected or found, in any case."""
    from quern.operators.report import all_words

    rows = rows.where(F.col("kind") == kind) if kind else rows
    return rows.where(all_words(F.concat_ws(" ", "key", "language", "text", "expected", "found"), query))


def stale_keys(entries: DataFrame, source: str) -> DataFrame:
    """One row: checked keys marked stale in any language."""
    stale = entries.where("stale").select("key").distinct()
    return checked_keys(entries, source).join(stale, "key", "left_semi").agg(F.count("*").alias("stale_keys"))


def distinguish_shared(files: DataFrame) -> DataFrame:
    """files (table, language, folder): languages that several files of a table claim get their folder added."""
    n = files.groupBy("table", "language").agg(F.count("*").alias("n"))
    named = F.when(F.col("n") > 1, F.concat("language", F.lit(" ("), "folder", F.lit(")"))).otherwise(F.col("language"))
    return files.join(n, ["table", "language"]).select("table", "folder", named.alias("language"))


def non_locale_qualifiers(directory: Column) -> Column:
    """Qualifiers of a values directory other than its locale: the first language, a region right after it, and b+ tags go."""
    tokens = F.slice(F.split(directory, "-"), 2, F.greatest(F.size(F.split(directory, "-")) - 1, F.lit(0)))
    start = F.struct(F.lit(False).alias("seen"), F.lit(False).alias("region"), F.array().cast("array<string>").alias("kept"))

    def step(s, token):
        language = ~s["seen"] & token.rlike("^[a-z]{2,3}$") & (token != "car")
        region = s["region"] & token.rlike("^r[A-Z0-9]{2,}$")
        tag = token.startswith("b+")
        kept = F.when(language | region | tag, s["kept"]).otherwise(F.array_append(s["kept"], token))
        return F.struct((s["seen"] | language | tag).alias("seen"), language.alias("region"), kept.alias("kept"))

    return F.array_join(F.aggregate(tokens, start, step, lambda s: s["kept"]), "-")


def identity(path: Column, fmt: Column, language: Column) -> Column:
    """Struct (format, table, group, language) of a localization file; files of one group are the languages of a table.

    A string catalog is a group of its own and holds its languages itself. String tables of an .lproj folder go together by
    bundle and file name, others stand alone; Android values by resource folder, other qualifiers and file name.
    """
    name, folder = F.regexp_extract(path, "([^/]*)$", 1), F.regexp_extract(path, "(?:^|/)([^/]*)/[^/]*$", 1)
    above = F.regexp_extract(path, "^(.*)/[^/]*/[^/]*$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    none = F.lit(None).cast("string")
    join = lambda *parts: F.concat_ws("\0", *parts)
    make = lambda f, table, group, lang: F.struct(f.alias("format"), table.alias("table"), group.alias("group"), lang.alias("language"))
    project = F.regexp_extract(folder, r"^(.+)\.lproj$", 1)
    apple = F.when(project != "", make(fmt, stem, join(fmt, above, name), project)).otherwise(make(fmt, stem, join(fmt, path), none))
    android = make(F.lit("android_strings"), name, join(F.lit("android"), above, non_locale_qualifiers(folder), name), language)
    return F.when(fmt == "xcstrings", make(fmt, stem, join(fmt, path), none)).when(fmt.isin("strings", "stringsdict"), apple).otherwise(android)


def _large(df: DataFrame) -> DataFrame:
    """df to be joined by sorting: it grows with the tables, and short rows that look small when written would fill the driver if broadcast."""
    return df.hint("merge")


def tables(entries: DataFrame) -> DataFrame:
    """Entries of files (path, format, language, declared, key, ...) as read from disk -> the same with group, table and label.

    label is the language that an entry counts for: an entry's own in a catalog, else its file's, with the folder where
    two files of a table claim one language. A file that gave an error has no entry here.
    """
    fmt = F.when(F.col("format") == "android", "xml").otherwise(F.col("format"))
    rows = entries.where("error is null").withColumn("i", identity(F.col("path"), fmt, F.col("language")))
    rows = rows.withColumn("group", F.col("i.group")).withColumn("table", F.col("i.table")).withColumn("file_language", F.col("i.language")).drop("i")
    files = rows.where("file_language is not null").select("group", "path", "file_language").distinct()
    claims = files.groupBy("group", "file_language").agg(F.count("*").alias("claims"))
    folder = F.regexp_extract("path", "(?:^|/)([^/]*)/[^/]*$", 1)
    shared = F.when(F.col("claims") > 1, F.concat("file_language", F.lit(" ("), folder, F.lit(")"))).otherwise(F.col("file_language"))
    rows = rows.join(_large(claims), ["group", "file_language"], "left")
    return rows.withColumn("label", F.coalesce(shared, "language")).drop("claims", "file_language")


def table_sources(rows: DataFrame) -> DataFrame:
    """tables() -> (group, source): the declared source language of a catalog, else Base, default or en if there, else the label of most entries, ties to the smaller name."""
    counts = rows.groupBy("group", "label").agg(F.count("*").alias("n"), F.max(F.when(F.col("declared") != "", F.col("declared"))).alias("declared"))
    first = F.when(F.col("label") == "Base", 1).when(F.col("label") == "default", 2).when(F.col("label") == "en", 3).otherwise(4)
    best = F.min_by("label", F.struct(first.alias("p"), F.when(first == 4, -F.col("n")).otherwise(0).alias("n"), "label"))
    return counts.groupBy("group").agg(F.coalesce(F.max("declared"), best).alias("source"))


def table_cells(rows: DataFrame) -> DataFrame:
    """tables() of any number of groups -> (group, table, language, key, outcome, needs_review, issue, original, value): cells() for every table at once, in equi-joins on group and key."""
    last = rows.groupBy("group", "label", "key").agg(F.max_by(F.struct("value_kind", "value", "status", "stale", "translatable"), "seq").alias("e")).select("group", F.col("label").alias("language"), "key", "e.*")
    source = table_sources(rows)
    names = rows.groupBy("group").agg(F.first("table").alias("table"), F.bool_or(F.col("format") == "xcstrings").alias("key_is_text"))
    head = source.join(_large(names), "group")
    told = last.join(_large(head), "group")
    barred = last.where(~F.col("translatable")).select("group", "key").distinct()
    held = told.where("language = source").select("group", "key").distinct()
    with_source = held.select("group").distinct().withColumn("has_source", F.lit(True))
    keys = last.select("group", "key").distinct().join(_large(barred), ["group", "key"], "left_anti").join(_large(held.withColumn("in_source", F.lit(True))), ["group", "key"], "left").join(_large(with_source), "group", "left")
    keys = keys.where("has_source is null or in_source").select("group", "key")
    labels = last.select("group", "language").distinct()
    grid = keys.join(_large(labels), "group").join(_large(head), "group")
    original = told.where("language = source and value_kind = 'singular'").select("group", "key", F.col("value").alias("original"))
    out = grid.join(_large(last.withColumn("here", F.lit(True))), ["group", "language", "key"], "left").join(_large(original), ["group", "key"], "left")
    text = F.col("value_kind") == "singular"
    outcome = F.when(F.col("here").isNull(), "missing").when(text & (F.col("value") == ""), "empty").when(text | (F.col("value_kind") == "plural"), "translated")
    outcome = outcome.when(F.col("key_is_text") & (F.col("language") == F.col("source")), "translated").otherwise("missing")
    out = out.withColumn("outcome", outcome)
    compare = (F.col("outcome") == "translated") & text & (F.col("language") != F.col("source")) & F.col("original").isNotNull()
    issue = F.when(F.col("outcome") == "empty", "empty_value").when(compare, argument_mismatch(arguments(F.col("original")), arguments(F.col("value"))))
    review = (F.col("outcome") == "translated") & F.coalesce(F.col("status").isin("needs_review", "stale"), F.lit(False))
    return out.select("group", "table", "source", "language", "key", "outcome", review.alias("needs_review"), issue.alias("issue"), "original", "value")


def table_coverage(rows: DataFrame) -> DataFrame:
    """tables() -> (group, table, source, language, keys, translated, missing, empty, needs_review, extra, issues, share): a row for each table and language, the source first by source_first.

    rows are saved first, as they are read many times and may come out of files that are parsed.
    """
    with workspace(rows.sparkSession):
        return checkpoint(save(_table_coverage(save(rows))))


def _table_coverage(rows: DataFrame) -> DataFrame:
    found = table_cells(rows)
    count = lambda cond, name: F.count_if(cond).alias(name)
    done = found.groupBy("group", "table", "source", "language").agg(F.count("*").alias("keys"), *[count(F.col("outcome") == o, o) for o in ("translated", "missing", "empty")], count(F.col("needs_review"), "needs_review"), count(F.col("issue").isNotNull(), "issues"))
    last = rows.select("group", F.col("label").alias("language"), "key", "translatable").distinct()
    source = table_sources(rows)
    barred = last.where(~F.col("translatable")).select("group", "key").distinct()
    held = last.join(_large(source), "group").where("language = source").select("group", "key").distinct()
    extra = last.select("group", "language", "key").distinct().join(_large(held.select("group").distinct()), "group", "left_semi").join(_large(held), ["group", "key"], "left_anti").join(_large(barred), ["group", "key"], "left_anti")
    extra = extra.groupBy("group", "language").agg(F.count("*").alias("extra"))
    out = done.join(_large(extra), ["group", "language"], "left").withColumn("extra", F.coalesce("extra", F.lit(0).cast("long")))
    return out.withColumn("share", F.when(F.col("keys") > 0, F.least(F.col("translated") / F.col("keys"), F.lit(1.0))))

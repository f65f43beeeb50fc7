"""Reports: status counts, facets, search, sorted pages and operation states."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def status_counts(rows: DataFrame) -> DataFrame:
    """rows (status, savings) -> a count and recommended savings for each status."""
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("savings"), F.lit(0)).alias("savings"))


def modes() -> dict[str, Column]:
    """Predicates of the views over rows (savings, warnings: number of warning candidates, in_group, state, kind, issues: null without translations, status)."""
    return {
        "candidates": F.col("savings") > 0, "warnings": F.col("warnings") > 0, "duplicates": F.col("in_group"), "applied": F.col("state") == "applied", "images": F.col("kind") == "image",
        "translations": F.col("issues").isNotNull(), "unsupported": F.col("status").isin("unsupported", "inventory_only"), "failed": F.col("status") == "failed", "all": F.lit(True),
    }


def facet_counts(rows: DataFrame, predicates: Mapping[str, Column]) -> DataFrame:
    """One row, one pass: how many rows each predicate holds for."""
    return rows.agg(*[F.count_if(test).alias(name) for name, test in predicates.items()])


def summary(rows: DataFrame) -> DataFrame:
    """One row over rows as for modes(), with format, bytes and applied_savings: counts of all modes, sums, and the formats in order."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    return rows.agg(
        *[F.count_if(test).alias(name) for name, test in modes().items()], total("bytes").alias("bytes"), total(F.when(F.col("savings") > 0, F.col("savings"))).alias("recommended_savings"),
        total(F.when(F.col("state") == "applied", F.col("applied_savings"))).alias("applied_total"), F.array_sort(F.collect_set("format")).alias("formats"),
    )


def view(rows: DataFrame, mode: str, query: str = "", fmt: str | None = None, sort: str = "savings") -> DataFrame:
    """Rows of a mode, with all words of the query in path, format and kind, of a format if one is given, in the order asked for: savings (issues in the translations view), size, name or score; ties by path in any case, then as it is."""
    found = rows.where(modes()[mode]).where(all_words(F.concat_ws(" ", "path", "format", "kind"), query))
    found = found.where(F.col("format") == fmt) if fmt else found
    name = F.lower(F.regexp_extract("path", "([^/]*)$", 1))
    orders = {"savings": F.desc("issues") if mode == "translations" else F.desc("savings"), "size": F.desc("bytes"), "name": name.asc(), "score": F.col("lowest_score").asc_nulls_last()}
    return found.orderBy(orders[sort], F.lower("path"), "path")


def group_view(groups: DataFrame, sort: str = "savings") -> DataFrame:
    """groups (reference, path, redundant_bytes, bytes, low, rank) in the order asked for; groups without a score come first by score; ties by rank."""
    name = F.lower(F.regexp_extract("path", "([^/]*)$", 1))
    orders = {"savings": F.desc("redundant_bytes"), "size": F.desc("bytes"), "name": name.asc(), "score": F.coalesce("low", F.lit(-1.0)).asc()}
    return groups.orderBy(orders[sort], "rank")


def group_ranks(members: DataFrame, ranks: DataFrame) -> DataFrame:
    """members (id, reference), ranks (reference, rank) -> (id, rank): each member's place among the groups."""
    return members.join(ranks.select("reference", "rank"), "reference").select("id", "rank")


def own_language(files: DataFrame) -> DataFrame:
    """files (table, path, language, source_language) -> (table, path, own): the language that a file of a table of several files answers for; null for the source's and for single files."""
    n = files.groupBy("table").agg(F.count("*").alias("n"))
    own = F.when((F.col("n") > 1) & (F.col("language") != F.col("source_language")), F.col("language"))
    return files.join(n, "table").select("table", "path", own.alias("own"))


def issue_totals(files: DataFrame, languages: DataFrame) -> DataFrame:
    """files as own_language(), languages (table, language, issues) -> (table, path, issues): its own language's issues, or the whole table's."""
    own = own_language(files)
    totals = languages.groupBy("table").agg(F.sum("issues").alias("total"))
    out = own.join(totals, "table", "left").join(languages.withColumnRenamed("language", "own").select("table", "own", "issues"), ["table", "own"], "left")
    return out.select("table", "path", F.coalesce(F.when(F.col("own").isNull(), F.col("total")).otherwise(F.col("issues")), F.lit(0).cast("long")).alias("issues"))


def first_of_each(rows: DataFrame, group: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group in that order."""
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= most).drop("_n")


def all_words(text: Column, query: str) -> Column:
    """Whether all words of the query occur in the text, in any case."""
    out = F.lit(True)
    for word in query.lower().split():
        out = out & F.lower(text).contains(word)
    return out


def groups_with_match(rows: DataFrame, group: str, test: Column) -> DataFrame:
    """All rows of the groups in which some row passes."""
    return rows.join(rows.where(test).select(group).distinct(), group, "left_semi")


def page(rows: DataFrame, order: list, size: int, number: int) -> DataFrame:
    """A page of sorted rows, numbered from 0."""
    return rows.orderBy(*order).offset(size * number).limit(size)


def results_page(rows: DataFrame, after: int, size: int = 500) -> DataFrame:
    """The next rows (seq, ...) of a feed from a cursor on."""
    return rows.where(F.col("seq") >= after).orderBy("seq").limit(size)


def missing(resources: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return resources.join(present, key, "left_anti")


def operation_state(resources: DataFrame, journal: DataFrame) -> DataFrame:
    """resources (resource), journal (resource, applied, total) -> state: original, applied, partial, or conflict."""
    state = F.when(F.col("applied").isNull() | (F.col("applied") == 0), "original").when(F.col("applied") == F.col("total"), "applied").when(F.col("applied") < F.col("total"), "partial").otherwise("conflict")
    return resources.join(journal, "resource", "left").select("resource", state.alias("state"))


def html_safe_json(row: Column) -> Column:
    """JSON that can stand inside a script element."""
    out = F.to_json(row)
    for char, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out

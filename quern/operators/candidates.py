"""Candidate verdicts, choice of a candidate for each resource, batch plans and trials.

candidates: resource, candidate (index), format, lossy, bytes, savings_bytes, score, alpha_error, transparency_changed.
resources: resource, bytes, format, extension_mismatch, status, exclusion, format_lock, area, state, missing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rejections that an explicit policy may accept.
WARNINGS = ["alpha_error_exceeds_policy", "transparency_presence_changed", "quality_below_policy"]


@dataclass(frozen=True)
class AnalysisOptions:
    """Thresholds of the analysis; checked before any job."""

    min_savings_bytes: int = 1
    max_alpha_error: float = 1 / 255 + 1e-6
    min_score: float = 80.0
    qualities: tuple[int, ...] = (75, 85, 95)

    def __post_init__(self):
        if not 0 <= self.min_score <= 100 or not 0 <= self.max_alpha_error <= 1:
            raise ValueError("thresholds out of range")
        if len(set(self.qualities)) != len(self.qualities) or not all(1 <= q <= 100 for q in self.qualities):
            raise ValueError("qualities must be distinct and from 1 to 100")


@dataclass(frozen=True)
class BatchPolicy:
    """What a batch may choose."""

    lossless: bool = True
    lossy: bool = False
    cross_format: bool = False
    min_score: float | None = None
    formats: tuple[str, ...] = ()
    accept_warnings: tuple[str, ...] = field(default=())

    def __post_init__(self):
        if not (self.lossless or self.lossy):
            raise ValueError("a policy must allow lossless or lossy candidates")
        if self.min_score is not None and not 0 <= self.min_score <= 100:
            raise ValueError("min_score out of range")
        if not set(self.accept_warnings) <= set(WARNINGS):
            raise ValueError("unknown warning")


def verdicts(candidates: DataFrame, options: AnalysisOptions) -> DataFrame:
    """Adds smaller, warnings (in order), rejection (the first), valid and artifact. A lossy candidate without a score passes."""
    smaller = F.col("savings_bytes") >= max(options.min_savings_bytes, 1)
    checks = [
        F.when(F.col("alpha_error") > options.max_alpha_error, WARNINGS[0]),
        F.when(F.col("transparency_changed"), WARNINGS[1]),
        F.when(F.col("lossy") & (F.col("score") < options.min_score), WARNINGS[2]),
    ]
    out = candidates.withColumn("smaller", smaller).withColumn("warnings", F.when(F.col("smaller"), F.array_compact(F.array(*checks))).otherwise(F.array().cast("array<string>")))
    rejection = F.when(~F.col("smaller"), "not_smaller").otherwise(F.get("warnings", F.lit(0)))
    return out.withColumn("rejection", rejection).withColumn("valid", F.col("rejection").isNull()).withColumn("artifact", F.col("smaller"))


def is_warning() -> Column:
    """Whether a candidate may be accepted in spite of its verdict."""
    return ~F.col("valid") & F.col("lossy") & F.col("artifact") & F.col("rejection").isin(WARNINGS)


def smallest_candidate(candidates: DataFrame) -> DataFrame:
    """(resource, smallest, smallest_bytes): the smallest valid candidate, ties to the lower index; null if none is valid."""
    key = F.when(F.col("valid") & F.col("artifact"), F.struct("bytes", "candidate"))
    return candidates.groupBy("resource").agg(F.min(key).alias("k")).select("resource", F.col("k.candidate").alias("smallest"), F.col("k.bytes").alias("smallest_bytes"))


def crossing() -> Column:
    return (F.col("format") != F.col("resource_format")) | F.col("extension_mismatch")


def allows(policy: BatchPolicy) -> Column:
    """Whether a policy allows a candidate joined with its resource (format as resource_format)."""
    accepted = is_warning() & F.forall("warnings", lambda w: w.isin(*policy.accept_warnings) if policy.accept_warnings else F.lit(False))
    out = F.col("artifact") & (F.col("valid") | accepted) & F.when(F.col("lossy"), policy.lossy).otherwise(policy.lossless)
    if not policy.cross_format:
        out = out & ~crossing()
    out = out & ~(crossing() & (F.col("format_lock").isNotNull() | F.coalesce(F.col("area") == "assets", F.lit(False))))
    if policy.formats:
        out = out & F.col("format").isin(*policy.formats)
    if policy.min_score is not None:
        out = out & (~F.col("lossy") | F.coalesce(F.col("score") >= policy.min_score, F.lit(False)))
    return out


def eligible() -> Column:
    """Whether a batch may touch a resource."""
    return ~F.col("missing") & (F.col("status") == "candidates_available") & F.col("exclusion").isNull() & (F.col("state") == "original")


def _joined(resources: DataFrame, candidates: DataFrame) -> DataFrame:
    res = resources.where(eligible()).select("resource", F.col("format").alias("resource_format"), "extension_mismatch", "format_lock", "area", F.col("bytes").alias("original_bytes"))
    return candidates.join(res, "resource")


def batch_items(resources: DataFrame, candidates: DataFrame, policy: BatchPolicy) -> DataFrame:
    """The smallest allowed candidate of each eligible resource (ties to the lower index): largest savings first in order_key."""
    chosen = _joined(resources, candidates).where(allows(policy)).withColumn("crossing", crossing()).withColumn("warning", F.when(is_warning(), F.col("rejection")))
    pick = F.min_by(F.struct("candidate", "format", "lossy", "warning", "original_bytes", "savings_bytes", "crossing"), F.struct("bytes", "candidate"))
    return chosen.groupBy("resource").agg(pick.alias("c")).select("resource", "c.*")


def batch_totals(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count("*").alias("items"), F.coalesce(F.sum("savings_bytes"), F.lit(0)).alias("savings_bytes"), F.count_if("lossy").alias("lossy_items"),
        F.count_if(F.col("warning").isNotNull()).alias("warning_items"), F.count_if("crossing").alias("cross_format_items"),
    )


def exclusion_reasons(resources: DataFrame, candidates: DataFrame, items: DataFrame, policy: BatchPolicy) -> DataFrame:
    """resources outside the plan -> (resource, reasons): why.

    `applied` if it already is; `unavailable` if nothing can be chosen: the file is gone, not analysed to the end or
    excluded, or no candidate is valid or a warning. Else the switches that its candidate of fewest misses, in order
    lossy or lossless, cross_format, warnings, score; `unavailable` again where the policy would allow it (a lock).
    """
    accepted = list(policy.accept_warnings)
    refused = F.exists("warnings", lambda w: ~w.isin(*accepted)) if accepted else F.size("warnings") > 0
    floor = F.lit(False) if policy.min_score is None else F.col("lossy") & ~F.coalesce(F.col("score") >= policy.min_score, F.lit(False))
    missed = [
        F.when(F.col("lossy") & F.lit(not policy.lossy), "lossy").when(~F.col("lossy") & F.lit(not policy.lossless), "lossless"),
        F.when(crossing() & F.lit(not policy.cross_format), "cross_format"),
        F.when(is_warning() & refused, "warnings"),
        F.when(floor, "score"),
    ]
    left = resources.join(items.select("resource"), "resource", "left_anti")
    open_ = ~F.col("missing") & (F.col("status") == "candidates_available") & F.col("exclusion").isNull() & (F.col("state") != "applied")
    res = left.where(open_).select("resource", F.col("format").alias("resource_format"), "extension_mismatch")
    offers = candidates.where(F.col("artifact") & (F.col("valid") | is_warning())).join(res, "resource").withColumn("reasons", F.array_compact(F.array(*missed)))
    best = offers.groupBy("resource").agg(F.min(F.struct(F.size("reasons").alias("n"), "candidate", "reasons")).alias("k"))
    told = F.array_join("k.reasons", ",")
    out = left.select("resource", "state", "missing").join(best, "resource", "left")
    applied = ~F.col("missing") & (F.col("state") == "applied")
    return out.select("resource", F.when(applied, "applied").when(told != "", told).otherwise("unavailable").alias("reasons"))


def recommended(candidates: DataFrame) -> DataFrame:
    """(resource, candidate, savings_bytes): the smallest valid candidate of each resource that has one, and what it saves."""
    key = F.when(F.col("valid") & F.col("artifact"), F.struct("bytes", "candidate"))
    best = candidates.groupBy("resource").agg(F.min_by(F.struct("candidate", "savings_bytes"), key).alias("c"), F.min(key).alias("k")).where("k is not null")
    return best.select("resource", "c.candidate", F.greatest("c.savings_bytes", F.lit(0)).alias("savings_bytes"))


def preferred(resources: DataFrame, candidates: DataFrame, warnings_view: bool = False) -> DataFrame:
    """resources (resource, state, applied_candidate) -> (resource, candidate): the one to show first.

    The applied one; in the warnings view the smallest warning (ties to the lower index); the smallest valid; the first warning; the first.
    """
    by_size = F.struct("bytes", "candidate")
    ok, warned = F.col("valid") & F.col("artifact"), is_warning()
    picks = candidates.groupBy("resource").agg(F.min(F.when(ok, by_size)).alias("valid"), F.min(F.when(warned, by_size)).alias("warned"), F.min(F.when(warned, F.col("candidate"))).alias("first_warned"), F.min("candidate").alias("first"))
    view = [F.col("warned.candidate")] if warnings_view else []
    applied = F.when(F.col("state") == "applied", F.col("applied_candidate"))
    return resources.join(picks, "resource", "left").select("resource", F.coalesce(applied, *view, "valid.candidate", "first_warned", "first").alias("candidate"))


def required_warnings() -> Column:
    """All limits that a warning candidate misses; reports from before warnings were listed name the rejection only. Unknown names are left out."""
    known = F.filter("warnings", lambda w: w.isin(WARNINGS))
    return F.when(~is_warning(), F.array().cast("array<string>")).when(F.size(known) > 0, known).otherwise(F.array("rejection"))


def batch_status(outcomes: DataFrame) -> DataFrame:
    """outcomes (resource, outcome, savings_bytes) -> one row: applied, failed and cancelled items, and what the applied ones save."""
    count = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    saved = F.coalesce(F.sum(F.when(F.col("outcome") == "applied", F.col("savings_bytes"))), F.lit(0).cast("long"))
    return outcomes.agg(count("applied"), count("failed"), count("cancelled"), saved.alias("savings_bytes"))


def selection(resources: DataFrame, wanted: DataFrame) -> DataFrame:
    """The resources of a selection (resource, ...), each once, and whether they are known."""
    return wanted.select("resource").distinct().join(resources.select("resource", F.lit(True).alias("known")), "resource", "left").select("resource", F.coalesce("known", F.lit(False)).alias("known"))


def thresholds(rows: DataFrame, min_input: int, min_bytes: int, min_percent: float) -> DataFrame:
    """rows (path, bytes, new_bytes) -> with savings and the reason why the entry is not planned, or null."""
    saved = F.greatest(F.col("bytes") - F.col("new_bytes"), F.lit(0))
    reason = F.when(F.col("bytes") < min_input, "input_too_small").when(F.col("new_bytes") >= F.col("bytes"), "not_smaller").when((saved < min_bytes) | (saved * 100.0 / F.col("bytes") < min_percent), "savings_too_small")
    return rows.withColumn("savings", saved).withColumn("reason", reason)


#: Rows of the trial list that is broadcast.
MOST_TRIALS = 1_000


def trials(resources: DataFrame, qualities: DataFrame) -> DataFrame:
    """resources (resource, locked, alpha, catalog, android, min_sdk) x the fixed trial list (format, lossy, quality): those to try, and why not."""
    from quern.functions.classify import webp_compatibility

    if qualities.limit(MOST_TRIALS + 1).count() > MOST_TRIALS:
        raise ValueError(f"more than {MOST_TRIALS} trials")
    both = resources.crossJoin(F.broadcast(qualities))  # a few rows, counted
    webp = F.when(F.col("catalog"), "catalog_has_no_webp").when(F.col("android"), webp_compatibility(F.col("min_sdk"), ~F.col("lossy"), F.col("alpha")))
    reason = F.when((F.col("format") == "png") & ~F.col("lossy"), None).when(F.col("locked"), "format_locked").when((F.col("format") == "jpeg") & F.col("alpha"), "jpeg_has_no_alpha").when(F.col("format") == "webp", webp)
    return both.withColumn("reason", reason)


# Fixed value: the quality of a HEIC trial that is all but lossless.
NEAR_LOSSLESS = 100


@dataclass(frozen=True)
class TrialOptions:
    """Which encodings are tried."""

    qualities: tuple[int, ...] = (75, 85, 95)
    lossy_png: bool = False
    webp: bool = True
    encoder: bool = True
    near_lossless: bool = False


def trial_lists(resources: DataFrame, options: TrialOptions) -> DataFrame:
    """resources (resource, format, lock, alpha, catalog, android, min_sdk) -> (resource, trials: array of (format, quality), issues: array), in the order in which they are tried.

    A PNG is tried as it is; a lock rules out all else and is the one issue. Lossy PNG keeps the format. With an encoder,
    Android files stay JPEG if they are, others may become JPEG if opaque and HEIC, near-lossless too if that is asked for and no
    quality of the list. WebP, outside of catalogs: lossy, and lossless for a PNG, where the platform's lowest level reads
    them; each reason once. Trials are arrays of a row, so nothing is joined.
    """
    from quern.functions.classify import webp_compatibility

    kind = "array<struct<format: string, quality: int>>"
    none = F.array().cast(kind)
    trial = lambda fmt, q: F.struct(F.lit(fmt).alias("format"), F.lit(q).cast("int").alias("quality"))
    lossy = lambda fmt: F.array(*[trial(fmt, q) for q in sorted(options.qualities)]).cast(kind)
    one = lambda fmt, q=None: F.array(trial(fmt, q)).cast(kind)
    png, android, alpha = F.col("format") == "png", F.coalesce("android", F.lit(False)), F.coalesce("alpha", F.lit(False))
    open_, target = F.col("lock").isNull(), ~F.coalesce("catalog", F.lit(False))
    own = F.when(png, one("png")).otherwise(none)
    same = F.when(open_ & png & F.lit(options.lossy_png), lossy("png")).otherwise(none)
    jpeg = F.when(open_ & F.lit(options.encoder) & ((android & (F.col("format") == "jpeg")) | (~android & ~alpha)), lossy("jpeg")).otherwise(none)
    near = one("heic", NEAR_LOSSLESS) if options.near_lossless and NEAR_LOSSLESS not in options.qualities else none
    heic = F.when(open_ & F.lit(options.encoder) & ~android, F.concat(lossy("heic"), near)).otherwise(none)
    gate = lambda lossless: F.when(android, webp_compatibility(F.col("min_sdk"), F.lit(lossless), alpha))
    tried = open_ & target & F.lit(options.webp)
    webp = F.when(tried & gate(False).isNull(), lossy("webp")).otherwise(none)
    whole = F.when(tried & png & gate(True).isNull(), one("webp")).otherwise(none)
    issues = F.array(
        F.col("lock"), F.when(open_ & target & F.lit(not options.webp) & (android | (F.col("format") == "webp")), "webp_candidates_disabled"),
        F.when(tried, gate(False)), F.when(tried & png, gate(True)),
    )
    return resources.select("resource", F.concat(own, same, jpeg, heic, webp, whole).alias("trials"), F.array_distinct(F.array_compact(issues)).alias("issues"))


def skip_dominated(trial_rows: DataFrame, margin: float = 1.05, top_margin: float = 1.25) -> DataFrame:
    """trial_rows (resource, format, quality, bytes, limit) -> (resource, format, quality, skipped, by_quality).

    In ascending quality of a format, a trial is skipped when one that was encoded before it overshot limit * margin
    (top_margin before heic 100). The first trial that overshoots is always encoded, and all after it are skipped, so
    that only its size ever matters: a skipped trial has no size. One aggregate and a join back.
    """
    over = trial_rows.where(F.col("bytes") > F.col("limit") * margin).groupBy("resource", "format").agg(F.min(F.struct("quality", "bytes")).alias("over"))
    top = (F.col("format") == "heic") & (F.col("quality") == 100)
    skipped = F.coalesce((F.col("over.quality") < F.col("quality")) & (~top | (F.col("over.bytes") > F.col("limit") * top_margin)), F.lit(False))
    out = trial_rows.join(over, ["resource", "format"], "left").withColumn("skipped", skipped)
    return out.select("resource", "format", "quality", "skipped", F.when(F.col("skipped"), F.col("over.quality")).alias("by_quality"))


def plan_token(items: DataFrame, policy: str) -> DataFrame:
    """One row: SHA-256 over the policy's text and the digests of the chosen items, in order of resource.

    Items are digested in ranges of 10,000 resources and the digests in their order, so no row holds all items.
    """
    part = items.withColumn("part", F.floor(F.col("resource") / 10_000)).groupBy("part").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("resource", "candidate")))), 256).alias("h"))
    return part.agg(F.sha2(F.concat(F.lit(policy), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda p: p["h"]), "")), 256).alias("token"))

"""Connected components and bucket linking with DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import forget, save, scratch, small


#: Members of a bucket that one task tests against the bucket's others; larger buckets are split.
MEMBERS = 2_000
#: A cheap test of two nodes, from two functions that give a payload column of either.
Near = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: each node sends its neighbours (large: the greater ones; else itself and the smaller ones) to the least of them."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(least, "a").where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).union(least.select(F.col("a").alias("x"), F.col("m").alias("y")))
    return out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any integer ids -> (id, component) for every id on an edge; component is the least id reachable.

    Alternating large and small stars: rounds grow with the logarithm of the component size, each is a partial
    aggregation and an equi-join (splittable when a node is hot), and no component is ever gathered in one task.
    Null ids and self links are left out; an empty input gives an empty result.
    """
    edges = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = _state(edges)
    while was[0]:
        new = save(_stars(_stars(edges, True), False), "edges")
        now = _state(new)
        forget(edges)
        edges = new
        if now == was:
            break
        was = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    out = save(edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots), "components")
    forget(edges)
    return out


def linked_components(buckets: DataFrame, payload: list[str], near: Near, verify: Callable[[DataFrame], DataFrame], refine: Callable[[DataFrame], tuple[DataFrame, Near]] | None = None, crowd: int = 1_000, rounds: int = 3) -> DataFrame:
    """buckets (key, id, *payload) -> (id, component) over all verified links between ids that share a key.

    First each bucket's least id is paired with its other members; what verifies is joined up. Members of one component
    need no further test. Buckets of more than `crowd` members that still hold several components then go through at most
    `rounds` rounds, in which each bucket's members meet one of them, chosen by a hash, and what verifies is joined up again, until few do; this
    only makes components larger. Then, in buckets that still hold several components, all pairs across components that pass
    the cheap test `near` on payloads are tried, so no link is lost and groups of copies never expand into all pairs.
    `verify` takes distinct (a, b) with a < b and returns those that are linked. `refine` may give those few ids a finer
    payload (id, ...) and a test on it, so that hardly any pair that is not linked is put forward. Each pair is put forward in
    the first bucket that has both, at the cost of an id's lesser keys in each of its rows.
    """
    least = buckets.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("key", "lead")
    kept = save(buckets.join(least, "key"), "buckets")
    lead = kept.where("id = lead").select("key", *[F.col(c).alias(f"{c}_0") for c in payload])
    stars = kept.where("id > lead").join(lead, "key")
    tried = save(stars.where(near(lambda c: F.col(f"{c}_0"), F.col)).select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    with scratch() as made:
        links = made.keep(save(verify(tried), "links"))
    part = _parts(kept, connected_components(links), payload)
    forget(kept)
    for turn in range(rounds):
        with scratch() as made:
            met = made.keep(save(_leads(part, payload, near, crowd, turn).join(tried, ["a", "b"], "left_anti"), "met"))
            if met.isEmpty():
                break
            new = made.keep(save(verify(met), "new"))
        tried, links, was = tried.union(met), links.union(new), part
        if new.count() * 10 <= met.count():
            break
        part = _parts(was, connected_components(links), payload)
        forget(was)
    with scratch() as made:
        rest = made.keep(save(_across(part, near, refine).join(tried, ["a", "b"], "left_anti"), "rest"))
    forget(part)
    with scratch() as made:
        more = made.keep(save(verify(rest), "more"))
    return connected_components(links.union(more))


def _parts(members: DataFrame, components: DataFrame, payload: list[str]) -> DataFrame:
    """(key, id, part, *payload) of the buckets that hold several components."""
    part = members.select("key", "id", *payload).join(components, "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"), *payload)
    mixed = part.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("key")
    return save(part.join(mixed, "key", "left_semi"), "mixed")


def _leads(part: DataFrame, payload: list[str], near: Near, crowd: int, turn: int) -> DataFrame:
    """Distinct pairs (a, b) of each crowded bucket's members with one of them, another each turn, across parts."""
    first = F.struct(F.xxhash64(F.lit(turn), "key", "id").alias("at"), "id", "part", *payload)
    lead = part.groupBy("key").agg(F.count("*").alias("members"), F.min(first).alias("it")).where(F.col("members") > crowd)
    lead = lead.select("key", F.col("it.id").alias("lead"), F.col("it.part").alias("of"), *[F.col(f"it.{c}").alias(f"{c}_0") for c in payload])
    pairs = part.join(lead, "key").where((F.col("part") != F.col("of")) & near(lambda c: F.col(f"{c}_0"), F.col))
    return pairs.select(F.least("lead", "id").alias("a"), F.greatest("lead", "id").alias("b")).distinct()


def _across(part: DataFrame, near: Near, refine: Callable | None) -> DataFrame:
    """Distinct pairs (a, b) of linked_components() across the parts of a bucket. The join makes each in the first of its buckets only, which is asked before the finer test."""
    x_of, y_of = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    shares = part.groupBy("key").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("shares"))
    shares = save(shares.where("shares > 1"), "shares")
    close = near(x_of, y_of) & ~F.arrays_overlap("x.before", "y.before")
    payload = [c for c in part.columns if c not in ("key", "id")]
    part = part.groupBy("id").agg(*[F.first(c).alias(c) for c in payload], F.array_sort(F.collect_set("key")).alias("keys"))
    if refine:
        finer, nearer = refine(part.select("id"))
        part = part.join(finer, "id")
        close = close & nearer(x_of, y_of)
    part = part.select("*", F.posexplode("keys").alias("at", "key")).withColumn("before", F.slice("keys", 1, F.col("at"))).drop("keys", "at")
    part = part.join(small(shares, shares.count()), "key", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    x = part.withColumn("share", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("shares")).cast("int"))
    y = part.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    rest = x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.share") == F.col("y.share")) & (F.col("x.part") < F.col("y.part")) & close)
    return rest.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()

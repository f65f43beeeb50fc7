"""Palettes of many images at once: boxes of colours are cut at their means, then centres move to the means of what is nearest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.storage import checkpoint, save, workspace

# Weight of opacity against colour, rounds in which centres move, low bits that colours may lose, most colours that are told apart.
ALPHA_WEIGHT, ROUNDS, BITS, MOST = 2.0, 6, 4, 60_000
AXES = ["p0", "p1", "p2", "p3"]


def histograms(pixels: DataFrame, most: int = MOST) -> DataFrame:
    """pixels (image, red, green, blue, alpha: 0 to 255[, n]) -> the different colours of each image with their number n.

    An image with more than `most` colours loses low bits of red, green and blue, one at a time, four at most. All images
    are counted in one pass; the counts of those that have too many are then made coarser by themselves.
    """
    n = F.sum("n") if "n" in pixels.columns else F.count("*")
    counts = pixels.groupBy("image", "red", "green", "blue", "alpha").agg(n.alias("n"))
    for bits in range(1, BITS + 1):
        many = counts.groupBy("image").count().where(F.col("count") > most).select("image", F.lit(bits).alias("bits"))
        low = counts.join(many, "image", "left")
        coarse = [F.when(F.col("bits").isNull(), F.col(c)).otherwise(F.shiftleft(F.shiftright(F.col(c).cast("int"), bits), bits)).cast(counts.schema[c].dataType).alias(c) for c in ("red", "green", "blue")]
        counts = low.select("image", *coarse, "alpha", "n").groupBy("image", "red", "green", "blue", "alpha").agg(F.sum("n").alias("n"))
    return counts


def _boxes(points: DataFrame) -> DataFrame:
    """(image, box, error, axis, cut) of the boxes of points: summed squared error along the axis where it is greatest, the first of equals, and the mean there."""
    stats = [f(F.col(a)).alias(f"{n}_{a}") for a in AXES for n, f in (("s", lambda c: F.sum(c * F.col("w"))), ("q", lambda c: F.sum(c * c * F.col("w"))), ("l", F.min), ("h", F.max))]
    sums = points.groupBy("image", "box").agg(F.sum("w").alias("w"), *stats)
    error = lambda a: F.when(F.col(f"l_{a}") < F.col(f"h_{a}"), F.greatest(F.col(f"q_{a}") - F.col(f"s_{a}") * F.col(f"s_{a}") / F.col("w"), F.lit(0.0))).otherwise(0.0)
    best = F.array_max(F.array(*[F.struct(error(a).alias("error"), F.lit(-i).alias("axis"), (F.col(f"s_{a}") / F.col("w")).alias("cut")) for i, a in enumerate(AXES)]))
    return sums.select("image", "box", best.alias("b")).select("image", "box", "b.error", (-F.col("b.axis")).alias("axis"), "b.cut")


def _along(axis: Column) -> Column:
    return F.get(F.array(*AXES), axis)


def _first(nodes: DataFrame, most: int) -> DataFrame:
    """The boxes that are cut: those of greatest error, a box before what is in it."""
    order = Window.partitionBy("image").orderBy(F.desc("error"), F.length("box"), "box")
    return nodes.where("error > 0").withColumn("place", F.row_number().over(order)).where(F.col("place") < most).drop("place")


def boxes(points: DataFrame, most: int) -> DataFrame:
    """points (image, p0 to p3, w) -> the same with `box`: at most `most` boxes an image, always cutting the one of greatest error at its mean.

    No box has a greater error than the one it was cut from, so those that are cut are the most - 1 of greatest error
    among all boxes. Each round cuts every box that is among them so far, in all images at once; the rounds are as many as
    the tree of boxes is deep, not as there are colours.
    """
    with workspace(points.sparkSession):
        return checkpoint(_cut(points, most))


def _cut(points: DataFrame, most: int) -> DataFrame:
    points = save(points.select("image", *AXES, "w", F.lit("r").alias("box")))
    nodes = save(_boxes(points).withColumn("open", F.lit(True)))
    while True:
        now = _first(nodes, most).where("open").select("image", "box", "axis", "cut")
        if not now.limit(1).count():
            break
        side = F.when(F.col("axis").isNull(), "").when(_along(F.col("axis")) <= F.col("cut"), "0").otherwise("1")
        points = save(points.join(now, ["image", "box"], "left").select("image", *AXES, "w", F.concat("box", side).alias("box")))
        done = nodes.join(now.select("image", "box", F.lit(True).alias("cut_now")), ["image", "box"], "left")
        done = done.select("image", "box", "error", "axis", "cut", (F.col("open") & F.col("cut_now").isNull()).alias("open"))
        fresh = points.join(now.select("image", F.col("box").alias("above")), (points["image"] == now["image"]) & (F.expr("substring(box, 1, length(box) - 1)") == F.col("above"))).select(points["image"], *AXES, "w", points["box"])
        nodes = save(done.union(_boxes(fresh).withColumn("open", F.lit(True))))
    # A box that was cut early may have been overtaken since: what is in it belongs to it.
    cut = _first(nodes, most).select("image", F.col("box").alias("above"), F.lit(True).alias("is_cut"))
    ends = points.select("image", "box").distinct()
    heads = ends.select("image", "box", F.explode(F.transform(F.sequence(F.lit(1), F.length("box")), lambda k: F.substring("box", F.lit(1), k))).alias("above"))
    leaf = heads.join(cut, ["image", "above"], "left").where("is_cut is null").groupBy("image", "box").agg(F.min_by("above", F.length("above")).alias("leaf"))
    return points.join(leaf, ["image", "box"]).select("image", *AXES, "w", F.col("leaf").alias("box"))


def centres(points: DataFrame, most: int, rounds: int = ROUNDS) -> DataFrame:
    """points (image, p0 to p3, w) -> (image, centres: array of at most `most` points): the boxes' means, then moved `rounds` times to the means of the points nearest to them, the first of equals; one without points stays."""
    with workspace(points.sparkSession):
        own = save(_cut(points, most))
        mean = lambda: [(F.sum(F.col(a) * F.col("w")) / F.sum("w")).alias(a) for a in AXES]
        made = own.groupBy("image", "box").agg(*mean())
        arrays = made.groupBy("image").agg(F.transform(F.sort_array(F.collect_list(F.struct("box", *AXES))), lambda c: F.struct(*[c[a].alias(a) for a in AXES])).alias("centres"))  # at most `most` an image
        for _ in range(rounds):
            arrays = save(arrays)
            gap = lambda c: sum(((F.col(a) - c[a]) * (F.col(a) - c[a]) for a in AXES[1:]), (F.col("p0") - c["p0"]) * (F.col("p0") - c["p0"]))
            near = F.array_min(F.transform("centres", lambda c, i: F.struct(gap(c).alias("gap"), i.alias("i"))))["i"]
            moved = own.join(arrays, "image").select("image", *AXES, "w", near.alias("i")).groupBy("image", "i").agg(*mean())
            moved = moved.groupBy("image").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct(*AXES)))).alias("moved"))
            arrays = arrays.join(moved, "image").select("image", F.transform("centres", lambda c, i: F.coalesce(F.try_element_at("moved", i), c)).alias("centres"))
        return checkpoint(arrays)


def palettes(colors: DataFrame, most: int, rounds: int = ROUNDS) -> DataFrame:
    """colors (image, red, green, blue, alpha, n) as histograms() gives them -> (image, red, green, blue, alpha): the palette of each image, each colour once.

    Colours are compared scaled by their opacity, beside opacity with its weight.
    """
    share = F.col("alpha") / 255
    points = colors.select("image", *[(F.col(c) * share).alias(a) for a, c in zip(AXES, ("red", "green", "blue"), strict=False)], (F.col("alpha") * ALPHA_WEIGHT).alias("p3"), F.col("n").cast("double").alias("w"))
    c = centres(points, most, rounds).select("image", F.explode("centres").alias("c"))
    alpha = F.least(F.greatest(F.col("c.p3") / ALPHA_WEIGHT, F.lit(0.0)), F.lit(255.0))
    level = lambda v: F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("int")
    own = [F.when(alpha > 0, level(F.col(f"c.{a}") / (alpha / 255))).otherwise(0).alias(n) for a, n in zip(AXES, ("red", "green", "blue"), strict=False)]
    return c.select("image", *own, level(alpha).alias("alpha")).distinct()

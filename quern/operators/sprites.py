"""Sprites of animations: which image each draws, which matte masks it, and the shape of each frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: what the image key of a sprite that only masks others ends with.
MATTE = ".matte"


def image_name(key: Column) -> Column:
    """The image that a key means: a matte's key less its ending."""
    return F.when(key.endswith(MATTE), F.substring(key, F.lit(1), F.length(key) - len(MATTE))).otherwise(key)


def resolve(sprites: DataFrame, images: DataFrame) -> DataFrame:
    """sprites (movie, sprite: place from 0, image_key, matte_key), images (movie, key, drawable) -> (movie, sprite, role, matte, image).

    role: `matte`; `masked` for one whose matte_key is the image_key of a matte, of which the last in the movie counts (its
    place is in `matte`); else `plain`. image: the place of its image among the movie's drawable ones, by first use; null for
    images without a name, that are not there or can't be drawn. Null keys are empty. Places of images are counted over a
    movie's distinct images only, each found by its first sprite.
    """
    key = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = sprites.select("movie", "sprite", key("image_key"), key("matte_key"))
    rows = rows.withColumn("name", image_name(F.col("image_key")))
    mattes = rows.where(F.col("image_key").endswith(MATTE)).groupBy("movie", F.col("image_key").alias("matte_key")).agg(F.max("sprite").alias("matte"))
    used = rows.where("name <> ''").groupBy("movie", "name").agg(F.min("sprite").alias("first"))
    drawn = used.join(images.where("drawable").select("movie", F.col("key").alias("name")).distinct(), ["movie", "name"])
    placed = drawn.withColumn("image", (F.row_number().over(Window.partitionBy("movie").orderBy("first")) - 1).cast("int")).select("movie", "name", "image")
    out = rows.join(mattes, ["movie", "matte_key"], "left").join(placed, ["movie", "name"], "left")
    own = F.col("image_key").endswith(MATTE)
    return out.select("movie", "sprite", F.when(own, "matte").when(F.col("matte").isNotNull(), "masked").otherwise("plain").alias("role"), F.when(~own, F.col("matte")).alias("matte"), "image")


def frame_shapes(frames: DataFrame, shapes: DataFrame) -> DataFrame:
    """frames (movie, sprite, frame), shapes (movie, sprite, frame, shape) -> frames with the shape that holds: the latest set at or before, the last of those set at one frame by `seq`.

    An as-of join in one pass: both tables meet in the order of frames, within each sprite, and shapes are carried forward.
    """
    marks = shapes.select("movie", "sprite", "frame", F.lit(0).alias("kind"), "seq", "shape")
    asks = frames.select("movie", "sprite", "frame", F.lit(1).alias("kind"), F.lit(None).cast(shapes.schema["seq"].dataType).alias("seq"), F.lit(None).cast(shapes.schema["shape"].dataType).alias("shape"))
    over = Window.partitionBy("movie", "sprite").orderBy("frame", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    held = marks.union(asks).withColumn("held", F.last(F.when(F.col("kind") == 0, F.struct("shape")), ignorenulls=True).over(over))
    return held.where("kind = 1").select("movie", "sprite", "frame", F.col("held.shape").alias("shape"))

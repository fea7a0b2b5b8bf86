"""Detections in images: clipping, choice of frames, best and fused labels, views of marks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clipped(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """Boxes ``x0, y0, x1, y1`` cut to ``[0, width] x [0, height]``; those left without area are dropped, nulls too."""
    cut = boxes.withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(float(most)), F.col(c))) for c, most in (("x0", width), ("x1", width), ("y0", height), ("y1", height))})
    return cut.filter("x1 > x0 AND y1 > y0")


def wanted(boxes: DataFrame, label: str, score: str, classes: list[str], threshold: float) -> DataFrame:
    """Boxes of the wanted classes with at least ``threshold``."""
    return boxes.filter(F.col(label).isin(*classes) & (F.col(score) >= threshold))


def without_labels(boxes: DataFrame, label: str, ignored: list[str]) -> DataFrame:
    """Boxes whose label, trimmed and lower-cased, is none of ``ignored``; a null label stays."""
    return boxes.filter(~F.coalesce(F.lower(F.trim(label)).isin(*[x.strip().lower() for x in ignored]), F.lit(False)))


def hits(frames: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """One row per element of arrays that belong together; ``fields`` names each array and its element.
    A frame whose first array is null or empty has none, whatever the others hold; else all must be equally long."""
    names = list(fields)
    n = F.size(names[0])
    uneven = reduce(lambda a, b: a | b, [F.coalesce(F.size(c), F.lit(-1)) != n for c in names[1:]], F.lit(False))
    checked = F.when(uneven, F.raise_error(F.lit("boxes and what belongs to them differ in number"))).otherwise(F.arrays_zip(*names))
    return frames.filter(n > 0).select(*keys, F.explode(checked).alias("h")).select(*keys, *[F.col(f"h.{a}").alias(c) for a, c in fields.items()])


def keyframes(frames: DataFrame, key: str, order: str, stride: int) -> DataFrame:
    """``key, order, place`` of every ``stride``-th frame of each key from its first, and of its last."""
    if stride < 1:
        raise ValueError("stride must be at least 1")
    place = F.expr(f"row_number() OVER (PARTITION BY `{key}` ORDER BY `{order}`) - 1")
    last = F.expr(f"count(*) OVER (PARTITION BY `{key}`) - 1")
    return frames.select(key, order, place.alias("place"), last.alias("_last")).filter((F.col("place") % stride == 0) | (F.col("place") == F.col("_last"))).drop("_last")


def strided(frames: DataFrame, key: str, order: str, stride: int, most: int) -> DataFrame:
    """``key, order, place``: every ``stride``-th frame of each key, the first ``most`` of these."""
    place = F.expr(f"row_number() OVER (PARTITION BY `{key}` ORDER BY `{order}`) - 1")
    return frames.select(key, order, place.alias("place")).filter((F.col("place") % stride == 0) & (F.col("place") < stride * most))


def drawn_frames(frames: DataFrame, key: str, order: str, k: int, seed: int) -> DataFrame:
    """``key, order``: ``k`` frames of each key drawn by a hash of ``seed``, key and order (all where there are fewer)."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key), F.col(order).cast("string")))
    ranked = frames.select(key, order, draw.alias("draw")).withColumn("n", F.expr(f"row_number() OVER (PARTITION BY `{key}` ORDER BY draw, `{order}`)"))
    return ranked.filter(F.col("n") <= k).select(key, order)


def best_per(df: DataFrame, keys: list[str], score: str, order: str, keep: list[str]) -> DataFrame:
    """Per key the row of the highest score, the first in ``order`` among equals; null scores count as none.
    The best of parts' bests is the best of the whole, so passes may be merged in any grouping."""
    top = df.filter(F.col(score).isNotNull()).groupBy(*keys).agg(F.min(F.struct((-F.col(score)).alias("s"), order, *keep)).alias("m"))
    return top.select(*keys, (-F.col("m.s")).alias(score), F.col(f"m.{order}").alias(order), *[F.col(f"m.{c}").alias(c) for c in keep])


def composed(pixels: DataFrame, keys: list[str], label: str, logit: str) -> DataFrame:
    """``keys, label, logit``: the label of the highest logit of each pixel, the smallest among equals; null where
    none is positive."""
    best = best_per(pixels.filter(F.col(label).isNotNull()), keys, logit, label, [])
    return best.select(*keys, F.when(F.col(logit) > 0, F.col(label)).alias(label), logit)


def quad_quality(corners: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """Mean side and least interior angle (degrees) of a quad; the angle is null where a side has no length."""
    sides = [F.hypot(corners[(i + 1) % 4][0] - corners[i][0], corners[(i + 1) % 4][1] - corners[i][1]) for i in range(4)]
    angles = []
    for i in range(4):
        (x, y), (px, py), (nx, ny) = corners[i], corners[i - 1], corners[(i + 1) % 4]
        cosine = F.try_divide((px - x) * (nx - x) + (py - y) * (ny - y), sides[i - 1] * sides[i])
        angles.append(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))
    return sum(sides[1:], sides[0]) / 4, F.least(*angles)


def mark_tracks(views: DataFrame, scene: str, image: str, mark: str, *, least_views: int = 2) -> DataFrame:
    """``scene, mark, n_views, first_image, last_image, usable``: in how many images each mark was seen.  A mark seen twice in
    one image is ambiguous there, and that image doesn't count for it."""
    once = views.groupBy(scene, image, mark).agg(F.count("*").alias("n")).filter("n = 1")
    t = once.groupBy(scene, mark).agg(F.count("*").alias("n_views"), F.min(image).alias("first_image"), F.max(image).alias("last_image"))
    return t.withColumn("usable", F.col("n_views") >= least_views)


def seen_fractions(images: DataFrame, views: DataFrame, scene: str, image: str, *, fallback_below: float) -> DataFrame:
    """``scene, n_images, n_with, fraction, fallback``: images with any mark among all images of a scene; 0 without images."""
    n = images.groupBy(scene).agg(F.count_distinct(image).alias("n_images"))
    w = views.join(images.select(scene, image).distinct(), [scene, image], "left_semi").groupBy(scene).agg(F.count_distinct(image).alias("n_with"))
    j = n.join(w, scene, "left").withColumn("n_with", F.coalesce("n_with", F.lit(0).cast("bigint")))
    share = F.coalesce(F.try_divide("n_with", "n_images"), F.lit(0.0))
    return j.withColumn("fraction", share).withColumn("fallback", share < fallback_below)

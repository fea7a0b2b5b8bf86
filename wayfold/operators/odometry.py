"""Motion from poses, integrals between instants, and scores against measured truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.frames import wrapped


def pose_motions(poses: DataFrame, key: str, t: str) -> DataFrame:
    """``key, t, speed_mps, yaw_rate_radps`` from successive planar poses ``x, y, yaw``: the motion in the earlier pose's
    frame over the time between.  The first pose copies the second's motion; a single one has zeros."""
    over = f"OVER (PARTITION BY `{key}` ORDER BY `{t}`)"
    p = poses.select(key, t, "x", "y", "yaw", *[F.expr(f"lag(`{c}`) {over}").alias(f"_{n}") for n, c in (("t", t), ("x", "x"), ("y", "y"), ("a", "yaw"))])
    dt = (F.col(t) - F.col("_t")) / 1e9
    ahead = F.cos("_a") * (F.col("x") - F.col("_x")) + F.sin("_a") * (F.col("y") - F.col("_y"))
    m = p.select(key, t, F.try_divide(ahead, dt).alias("v"), F.try_divide(wrapped(F.col("yaw") - F.col("_a")), dt).alias("w"))
    zero = F.lit(0.0)
    return m.select(key, t, *[F.coalesce(F.col(c), F.expr(f"lead({c}) {over}"), zero).alias(n) for c, n in (("v", "speed_mps"), ("w", "yaw_rate_radps"))])


def drift(ends: DataFrame) -> DataFrame:
    """Adds ``displacement_m, endpoint_error_m, drift_frac, heading_error_deg`` to rows with the first and last estimated pose
    (``ex0, ey0, ea0, ex1, ey1, ea1``) and the true ones (``tx0`` and so on); the share is null without displacement."""
    def seen(p: str):
        dx, dy, a = F.col(f"{p}x1") - F.col(f"{p}x0"), F.col(f"{p}y1") - F.col(f"{p}y0"), F.col(f"{p}a0")
        return F.cos(a) * dx + F.sin(a) * dy, F.cos(a) * dy - F.sin(a) * dx

    (ex, ey), (tx, ty) = seen("e"), seen("t")
    out = ends.withColumns({"displacement_m": F.hypot(tx, ty), "endpoint_error_m": F.hypot(ex - tx, ey - ty)})
    turn = wrapped((F.col("ea1") - F.col("ea0")) - (F.col("ta1") - F.col("ta0")))
    return out.withColumn("drift_frac", F.try_divide("endpoint_error_m", "displacement_m")).withColumn("heading_error_deg", F.degrees(turn))


def running_integral(samples: DataFrame, grid: DataFrame, key: str, t: str, rate: str) -> DataFrame:
    """``key, t, integral, below, upto, sum_below, sum_upto`` at each grid instant: the integral of a rate that is linear between its samples and
    held beyond them, from the first sample; and the number and sum of samples before, and up to and at, the instant.

    Differences of two rows are the integral, number and sum between two instants, so no interval is joined
    with its samples.  Several samples at one instant count by their mean.  A key without samples has nulls.
    """
    over = f"OVER (PARTITION BY `{key}` ORDER BY `{t}`)"
    s = samples.filter(F.col(t).isNotNull() & F.col(rate).isNotNull()).groupBy(key, t).agg(F.avg(rate).alias("_r"))
    s = s.select(key, t, "_r", F.expr(f"coalesce((_r + lag(_r) {over}) / 2 * (`{t}` - lag(`{t}`) {over}) / 1e9D, 0D)").alias("_part"))
    both = s.select(key, t, "_r", "_part", F.lit(False).alias("_grid")).unionAll(grid.select(key, t, F.lit(None).cast("double").alias("_r"), F.lit(0.0).alias("_part"), F.lit(True).alias("_grid")))
    upto, before = f"(PARTITION BY `{key}` ORDER BY `{t}` RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", f"(PARTITION BY `{key}` ORDER BY `{t}` RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    item = f"CASE WHEN _r IS NOT NULL THEN struct(`{t}` AS t, _r AS r) END"
    met = both.select(
        key, t, "_grid", F.expr(f"last({item}, true) OVER {upto}").alias("_p"), F.expr(f"sum(_part) OVER {upto}").alias("_i"), F.expr(f"count(_r) OVER {upto}").alias("upto"), F.expr(f"count(_r) OVER {before}").alias("below"),
        F.expr(f"coalesce(sum(_r) OVER {upto}, 0D)").alias("sum_upto"), F.expr(f"coalesce(sum(_r) OVER {before}, 0D)").alias("sum_below"),
        F.expr(f"last({item}, true) OVER (PARTITION BY `{key}` ORDER BY `{t}` DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)").alias("_q"),
    ).filter("_grid")
    here = F.when(F.col("_p").isNull(), F.col("_q.r")).when(F.col("_q").isNull() | (F.col("_q.t") == F.col("_p.t")), F.col("_p.r")).otherwise(F.col("_p.r") + (F.col("_q.r") - F.col("_p.r")) * (F.col(t) - F.col("_p.t")) / (F.col("_q.t") - F.col("_p.t")))
    met = met.withColumn("_here", here)
    inside = F.when(F.col("_p").isNull(), F.col("_here") * (F.col(t) - F.col("_q.t")) / 1e9).otherwise(F.col("_i") + (F.col("_p.r") + F.col("_here")) / 2 * (F.col(t) - F.col("_p.t")) / 1e9)
    return met.select(key, t, inside.alias("integral"), "below", "upto", "sum_below", "sum_upto")


def turn_axis(samples: DataFrame, key: str, w: list[str], rate: str) -> DataFrame:
    """``key, ax, ay, az``: the unit axis ``a`` that fits ``w = rate * a`` best; null for a key that never turns."""
    s = samples.groupBy(key).agg(*[F.sum(F.col(rate) * F.col(c)).alias(f"s{i}") for i, c in enumerate(w)], F.sum(F.col(rate) * F.col(rate)).alias("rr")).filter("rr > 0")
    size = F.sqrt(F.col("s0") * F.col("s0") + F.col("s1") * F.col("s1") + F.col("s2") * F.col("s2"))
    return s.select(key, *[F.try_divide(f"s{i}", size).alias(f"a{c}") for i, c in enumerate("xyz")])


def nearest_found(truth: DataFrame, seen: DataFrame, frames: DataFrame, scene: str, frame: str, gate: float) -> DataFrame:
    """``scene, id, range_m, n_frames, n_found, median_error_m, median_signed_m``: each true place against what was seen.

    ``truth`` has ``scene, id, tx, ty``; ``seen`` ``scene, frame, x, y, ord``; ``frames`` all frames of a scene, also those in which
    nothing was seen.  In each frame the nearest sighting (the first ``ord`` among equals) counts if it is within
    ``gate``; its errors are the distance, and its range less the true one, both from the origin.
    """
    n = frames.select(scene, frame).distinct().groupBy(scene).agg(F.count("*").alias("n_frames"))
    met = truth.join(seen, scene).withColumn("d", F.hypot(F.col("x") - F.col("tx"), F.col("y") - F.col("ty"))).filter(F.col("d") <= gate)
    best = met.groupBy(scene, "id", frame).agg(F.min(F.struct("d", "ord", (F.hypot("x", "y") - F.hypot("tx", "ty")).alias("s"))).alias("m"))
    errors = best.groupBy(scene, "id").agg(F.count("*").alias("n_found"), F.percentile("m.d", 0.5).alias("median_error_m"), F.percentile("m.s", 0.5).alias("median_signed_m"))
    zero = F.lit(0).cast("bigint")
    out = truth.select(scene, "id", F.hypot("tx", "ty").alias("range_m")).join(n, scene, "left").join(errors, [scene, "id"], "left")
    return out.select(scene, "id", "range_m", F.coalesce("n_frames", zero).alias("n_frames"), F.coalesce("n_found", zero).alias("n_found"), "median_error_m", "median_signed_m")

"""Swept clearance: how near components of a moving vehicle come to obstacles, and when they touch.

Frames, components and obstacles meet by joins; a numpy kernel measures whole batches of pairs at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import settings as S
from wayfold.sources.shipping import ship_package

# Footprints of the components, as x, y and z ranges in the vehicle frame.
COMPONENTS = [
    ("rear_bumper", -1.00, -0.70, 0.40, -0.85, 0.70, 0.75),
    ("rear_right_bumper_corner", -1.00, -1.00, 0.40, -0.85, -0.70, 0.75),
    ("rear_left_bumper_corner", -1.00, 0.70, 0.40, -0.85, 1.00, 0.75),
    ("front_bumper", 3.85, -1.00, 0.40, 4.00, 1.00, 0.75),
    ("right_mirror", 2.40, -1.25, 1.40, 2.60, -1.00, 1.60),
    ("left_mirror", 2.40, 1.00, 1.40, 2.60, 1.25, 1.60),
    ("rear_right_wheel", -0.35, -1.00, 0.00, 0.35, -0.80, 0.70),
    ("rear_left_wheel", -0.35, 0.80, 0.00, 0.35, 1.00, 0.70),
    ("front_right_wheel", 2.65, -1.00, 0.00, 3.35, -0.80, 0.70),
    ("front_left_wheel", 2.65, 0.80, 0.00, 3.35, 1.00, 0.70),
    ("front_door_right", 1.00, -1.00, 0.50, 2.60, -0.95, 1.90),
    ("underbody", 0.00, -0.78, 0.25, 3.00, 0.78, 0.30),
]
TTC_TOLERANCE = 0.005
#: Distance of the farthest corner of any component from the vehicle's origin.
FARTHEST = max(np.hypot(x, y) for _, x0, y0, _, x1, y1, _ in COMPONENTS for x in (x0, x1) for y in (y0, y1))


def component_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMPONENTS, "component string, xmin double, ymin double, zmin double, xmax double, ymax double, zmax double")


def _corners(x0, y0, x1, y1) -> np.ndarray:
    return np.stack([np.stack([x0, y0], -1), np.stack([x1, y0], -1), np.stack([x1, y1], -1), np.stack([x0, y1], -1)], -2)


def _to_segments(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least distance of the corners ``p`` to the sides of ``q``."""
    a, b = q[..., None, :, :], np.roll(q, -1, axis=-2)[..., None, :, :]
    d, side = p[..., :, None, :] - a, b - a
    share = np.clip((d * side).sum(-1) / np.maximum((side * side).sum(-1), 1e-18), 0, 1)
    return np.sqrt(((d - share[..., None] * side) ** 2).sum(-1)).min((-1, -2))


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether a side of ``p`` parts the two convex shapes."""
    side = np.roll(p, -1, axis=-2) - p
    normal = np.stack([side[..., 1], -side[..., 0]], -1)
    mine, theirs = np.einsum("...ik,...jk->...ij", normal, p), np.einsum("...ik,...jk->...ij", normal, q)
    return ((theirs.min(-1) > mine.max(-1)) | (theirs.max(-1) < mine.min(-1))).any(-1)


def gaps(box: np.ndarray, obstacle: np.ndarray, curvature: np.ndarray, way: np.ndarray) -> np.ndarray:
    """Gap of each component, moved along its curve by ``way``, to its obstacle; 0 where they overlap."""
    a = curvature * way
    small = np.abs(a) < 1e-4
    k = np.where(small, 1.0, curvature)
    x = np.where(small, way * (1 - a * a / 6), np.sin(a) / k)
    y = np.where(small, way * (a / 2 - a**3 / 24), (1 - np.cos(a)) / k)
    c, s = np.cos(a)[..., None], np.sin(a)[..., None]
    moved = np.stack([c * box[..., 0] - s * box[..., 1] + x[..., None], s * box[..., 0] + c * box[..., 1] + y[..., None]], -1)
    d = np.minimum(_to_segments(moved, obstacle), _to_segments(obstacle, moved))
    parted = _apart(moved, obstacle) | _apart(obstacle, moved)
    return np.maximum(np.where(parted, d, 0.0) - S.COMPONENT_MARGIN - S.OBSTACLE_MARGIN, 0.0)


def _measure(pdf: pd.DataFrame) -> pd.DataFrame:
    col = {c: pdf[c].to_numpy(dtype=float) for c in ("xmin", "ymin", "xmax", "ymax", "ox0", "oy0", "ox1", "oy1", "speed", "curvature", "t_max")}
    box, obstacle = _corners(col["xmin"], col["ymin"], col["xmax"], col["ymax"]), _corners(col["ox0"], col["oy0"], col["ox1"], col["oy1"])
    ts = np.minimum(np.arange(round(S.HORIZON_S / S.STEP_S) + 1) * S.STEP_S, col["t_max"][:, None])
    n, m = ts.shape
    wide = lambda x: np.broadcast_to(x[:, None], (n, m, *x.shape[1:]))
    g = gaps(wide(box), wide(obstacle), wide(col["curvature"]), col["speed"][:, None] * ts)
    best = g.argmin(1)
    least, when = g[np.arange(n), best], ts[np.arange(n), best]
    touch = (g <= 0).any(1)
    first = (g <= 0).argmax(1)
    hi, lo = ts[np.arange(n), first], ts[np.arange(n), np.maximum(first - 1, 0)]
    while touch.any() and (hi - lo)[touch].max() > TTC_TOLERANCE:
        mid = (lo + hi) / 2
        closed = gaps(box, obstacle, col["curvature"], col["speed"] * mid) <= 0
        hi, lo = np.where(closed, mid, hi), np.where(closed, lo, mid)
    return pdf[["pass_id", "t_ns", "component", "obstacle_id"]].assign(min_distance_m=np.where(touch, 0.0, least), ttc_s=np.where(touch, hi, np.nan), t_closest_s=np.where(touch, hi, when))


def clearances(pairs: DataFrame) -> DataFrame:
    """``pass_id, t_ns, component, obstacle_id, min_distance_m, ttc_s, t_closest_s`` for each pair.

    ``pairs`` has component and obstacle boxes, ``speed``, ``curvature`` and ``t_max``.  Shapes are widened by
    their margins (the gap is shortened by both).  The time to contact is null without one; with one the
    distance is 0.  Else the earliest time of the least gap is given, in steps of ``STEP_S``.
    """
    ship_package(pairs.sparkSession)
    out = "pass_id string, t_ns bigint, component string, obstacle_id bigint, min_distance_m double, ttc_s double, t_closest_s double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 2000):
                yield _measure(batch.iloc[a : a + 2000])

    done = pairs.mapInPandas(run, out)
    return done.withColumn("ttc_s", F.when(~F.isnan("ttc_s"), F.col("ttc_s")))


def swept_pairs(ego: DataFrame, obstacles: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs that can matter: same pass and instant, overlapping heights, within reach of the horizon.

    ``ego`` has ``pass_id, t_ns, speed, curvature``; ``obstacles`` ``pass_id, t_ns, obstacle_id``, centre
    ``x, y, z`` and size ``sx, sy, sz``.  A vehicle that doesn't move is judged where it stands.
    The components are a fixed few, so they are broadcast.
    """
    o = obstacles.select("pass_id", "t_ns", "obstacle_id", *[(F.col(c) + sign * F.col(f"s{c}") / 2).alias(f"o{c}{i}") for c in "xyz" for i, sign in ((0, -1), (1, 1))])
    moving = F.abs("speed") >= S.LEAST_SPEED
    e = ego.select("pass_id", "t_ns", F.when(moving, F.col("speed")).otherwise(0.0).alias("speed"), "curvature", F.when(moving, S.HORIZON_S).otherwise(0.0).alias("t_max"))
    met = e.join(o, ["pass_id", "t_ns"]).join(F.broadcast(components), F.expr("zmax >= oz0 AND oz1 >= zmin"))
    # No point of the vehicle moves by more than its way plus the turn times its distance from the origin.
    way = F.abs("speed") * F.col("t_max")
    reach = way * (1 + F.abs("curvature") * float(FARTHEST)) + S.REPORT_DISTANCE + S.COMPONENT_MARGIN + S.OBSTACLE_MARGIN
    dx = F.greatest(F.lit(0.0), F.col("ox0") - F.col("xmax"), F.col("xmin") - F.col("ox1"))
    dy = F.greatest(F.lit(0.0), F.col("oy0") - F.col("ymax"), F.col("ymin") - F.col("oy1"))
    return met.filter(F.hypot(dx, dy) <= reach)


def best_per_component(found: DataFrame, report: float = S.REPORT_DISTANCE) -> DataFrame:
    """The obstacle that matters most to each component of a frame: a contact first, the earliest, then the
    nearest, then the smallest number; only within ``report``."""
    order = F.struct(F.col("ttc_s").isNull().alias("a"), F.coalesce("ttc_s", F.lit(0.0)).alias("b"), F.col("min_distance_m").alias("c"), "obstacle_id", "ttc_s", "t_closest_s")
    best = found.groupBy("pass_id", "t_ns", "component").agg(F.min(order).alias("m"))
    out = best.select("pass_id", "t_ns", "component", F.col("m.obstacle_id").alias("obstacle_id"), F.col("m.c").alias("min_distance_m"), F.col("m.ttc_s").alias("ttc_s"), F.col("m.t_closest_s").alias("t_closest_s"))
    return out.filter(F.col("min_distance_m") <= report)


def reachable(pairs: DataFrame) -> DataFrame:
    """Clearances up to the first contact of each frame: those of the whole horizon, and where any component
    touches within it, measured again with the horizon cut just after the first contact."""
    whole = best_per_component(clearances(pairs))
    first = whole.groupBy("pass_id", "t_ns").agg(F.min("ttc_s").alias("_first"))
    touched = first.filter("_first IS NOT NULL")
    cut = pairs.join(touched, ["pass_id", "t_ns"]).withColumn("t_max", F.least("t_max", F.col("_first") + TTC_TOLERANCE)).drop("_first")
    return whole.join(touched, ["pass_id", "t_ns"], "left_anti").unionByName(best_per_component(clearances(cut)))

"""Labelled points: fits, votes, clean-up, voxels, extents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.components import connected_components
from wayfold.operators.medians import exact_quantiles
from wayfold.operators.occupancy import within_radius
from wayfold.sources.checkpoints import cut
from wayfold.sources.shipping import ship_package


def planar_fit(pairs: DataFrame, key: str) -> DataFrame:
    """``key, n, yaw, dx, dy``: the least-squares planar motion that takes ``x, y`` to ``u, v``, in closed form from
    centred sums; null where a key has no spread."""
    c = pairs.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m{a}") for a in "xyuv"])
    d = pairs.join(c, F.col(key) == F.col("_key"))
    x, y, u, v = (F.col(a) - F.col(f"m{a}") for a in "xyuv")
    s = d.groupBy(key).agg(F.sum(x * v - y * u).alias("cr"), F.sum(x * u + y * v).alias("dt"), *[F.first(a).alias(a) for a in ("n", "mx", "my", "mu", "mv")])
    yaw = F.when((F.col("cr") != 0) | (F.col("dt") != 0), F.atan2("cr", "dt"))
    out = s.select(key, "n", yaw.alias("yaw"), "mx", "my", "mu", "mv")
    dx = F.col("mu") - (F.cos("yaw") * F.col("mx") - F.sin("yaw") * F.col("my"))
    dy = F.col("mv") - (F.sin("yaw") * F.col("mx") + F.cos("yaw") * F.col("my"))
    return out.select(key, "n", "yaw", dx.alias("dx"), dy.alias("dy"))


def long_axis(points: DataFrame, key: str) -> DataFrame:
    """``key, n, cx, cy, heading``: centre and direction of the greatest spread in plan."""
    m = points.groupBy(key).agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.covar_pop("x", "y").alias("xy"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"))
    return m.select(key, "n", "cx", "cy", (0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))).alias("heading"))


def slice_widths(points: DataFrame, key: str, width: float) -> DataFrame:
    """``key, n_slices, median_width``: points are cut into slices along x, from the key's least x; a slice counts with two points."""
    start = points.groupBy(F.col(key).alias("_key")).agg(F.min("x").alias("_x0"))
    s = points.join(start, F.col(key) == F.col("_key")).groupBy(key, F.floor((F.col("x") - F.col("_x0")) / width).alias("i")).agg(F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("w")).filter("n >= 2")
    return s.groupBy(key).agg(F.count("*").alias("n_slices"), F.expr("median(w)").alias("median_width"))


def voxel_volumes(points: DataFrame, key: str, edge: float) -> DataFrame:
    """``key, n_voxels, volume``: the voxels that hold any point."""
    cells = points.select(key, *[F.floor(F.col(c) / edge).alias(c) for c in "xyz"]).distinct()
    return cells.groupBy(key).agg(F.count("*").alias("n_voxels")).withColumn("volume", F.col("n_voxels") * edge**3)


def vote_labels(votes: DataFrame, point: str, label: str, least: int, least_share: float) -> DataFrame:
    """``point, label, n_votes, share``: the label with most votes (the smallest among equals); null where it has
    under ``least`` votes in all or under ``least_share`` of them.  Null votes count as none."""
    n = votes.filter(F.col(label).isNotNull()).groupBy(point, label).agg(F.count("*").alias("n"))
    w = n.groupBy(point).agg(F.sum("n").alias("n_votes"), F.min(F.struct((-F.col("n")).alias("n"), label)).alias("m"))
    share = -F.col("m.n") / F.col("n_votes")
    return w.select(point, F.when((F.col("n_votes") >= least) & (share >= least_share), F.col(f"m.{label}")).alias(label), "n_votes", share.alias("share"))


def clean_labels(points: DataFrame, keys: list[str], point: str, label: str, *, eps: float, least_cluster: int, radius: float, least_votes: int) -> DataFrame:
    """``point, label, stray, new_label``: points of a label in a cluster under ``least_cluster`` that isn't the
    label's largest are strays; each takes the majority label of the kept points around it, null without enough.

    Clusters are points of one label joined within ``eps``; neighbours are found by cells and components by
    joins, so neither a dense place nor a large cluster sits in one task.  Unlabelled points stay as they are.
    """
    named = points.filter(F.col(label).isNotNull())
    pairs = within_radius(named.withColumnRenamed(point, "_u"), named.withColumnRenamed(point, "_v"), [*keys, label], ["x", "y", "z"], eps, "_u", "_v").filter("_u < _v")
    roots = connected_components(pairs, "_u", "_v")
    held = named.join(roots, named[point] == roots["node"], "left").select(*keys, point, label, "x", "y", "z", F.coalesce("root", point).alias("root"))
    sizes = held.groupBy(*keys, label, "root").agg(F.count("*").alias("size"))
    top = sizes.groupBy(*keys, label).agg(F.min(F.struct((-F.col("size")).alias("s"), "root"))["root"].alias("top"))
    marked = held.join(sizes, [*keys, label, "root"]).join(top, [*keys, label]).withColumn("stray", (F.col("size") < least_cluster) & (F.col("root") != F.col("top")))
    around = within_radius(marked.filter("stray").withColumnRenamed(point, "_s"), marked.filter("NOT stray").withColumnRenamed(point, "_k"), keys, ["x", "y", "z"], radius, "_s", "_k")
    votes = around.join(marked.select(F.col(point).alias("_k"), label), "_k")
    won = vote_labels(votes, "_s", label, least_votes, 0.0).select(F.col("_s").alias(point), F.col(label).alias("_won"))
    return marked.select(point, label, "stray").join(won, point, "left").select(point, label, "stray", F.when(F.col("stray"), F.col("_won")).otherwise(F.col(label)).alias("new_label"))


def exposed_faces(points: DataFrame, key: str, edge: float) -> DataFrame:
    """``key, n_voxels, n_faces, area``: the faces of the voxels that hold a point and have no such voxel behind them."""
    cells = points.select(key, *[F.floor(F.col(c) / edge).alias(c) for c in "xyz"]).distinct()
    sides = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))])
    faces = cells.select(key, F.explode(sides).alias("s"), "x", "y", "z").select(key, *[(F.col(c) + F.col(f"s.{d}")).alias(c) for c, d in zip("xyz", "abc")])
    bare = faces.join(cells, [key, "x", "y", "z"], "left_anti").groupBy(key).agg(F.count("*").alias("n_faces"))
    n = cells.groupBy(key).agg(F.count("*").alias("n_voxels"))
    return n.join(bare, key).withColumn("area", F.col("n_faces") * edge**2)


def nearest_spacing(points: DataFrame, key: str, row: str, *, cell: float = 0.5, grow: float = 4.0, most: float = 1e4) -> DataFrame:
    """``key, row, spacing``: the distance of each distinct place to the nearest other one of its key; a key with one place has none.

    Places meet in their own and the adjoining cells; a neighbour within a cell's width is certainly the nearest.
    Places without one are looked at again with cells ``grow`` times as wide, up to ``most``.
    """
    places = cut(points.groupBy(key, "x", "y", "z").agg(F.min(row).alias("p")))
    left, found, width = places, None, cell
    while width <= most:
        pairs = within_radius(left.withColumnRenamed("p", "p1"), places.withColumnRenamed("p", "p2"), [key], ["x", "y", "z"], width, "p1", "p2").filter("p1 <> p2")
        near = cut(pairs.groupBy("p1").agg(F.min("distance").alias("spacing")))
        found = near if found is None else found.unionAll(near)
        left = cut(left.join(near, F.col("p") == F.col("p1"), "left_anti"))
        if not left.take(1):
            break
        width *= grow
    return places.join(found, F.col("p") == F.col("p1")).select(key, F.col("p").alias(row), "spacing")


def vehicle_frames(points: DataFrame, key: str, context: str, *, overhang: float, slice_m: float, trim: float) -> DataFrame:
    """``key, heading, ox, oy, length, width, full_width, height``: a frame laid through each key's points on level ground.

    Its axis is that of greatest spread, turned to where x rises; lengths are trimmed by exact percentiles, the width
    is the median over slices along the axis that hold two points, and the origin lies ``overhang`` ahead of the rear end.
    """
    axis = long_axis(points, key).select(F.col(key).alias("_k"), "cx", "cy", "heading")
    turned = points.join(axis, F.col(key) == F.col("_k")).withColumns({"ux": F.cos("heading"), "uy": F.sin("heading")})
    st = turned.select(key, context, "heading", "cx", "cy", "z", ((F.col("x") - F.col("cx")) * F.col("ux") + (F.col("y") - F.col("cy")) * F.col("uy")).alias("s"), ((F.col("y") - F.col("cy")) * F.col("ux") - (F.col("x") - F.col("cx")) * F.col("uy")).alias("t"))
    ends = exact_quantiles(st, [key], context, "s", {"rear": trim / 100, "front": 1 - trim / 100}).select(F.col(key).alias("_e"), "rear", "front")
    tops = exact_quantiles(st, [key], context, "z", {"height": 1 - trim / 100}).select(F.col(key).alias("_h"), "height")
    span = st.groupBy(F.col(key).alias("_w"), "heading", "cx", "cy").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    sliced = st.join(ends, F.col(key) == F.col("_e")).filter("s >= rear AND s < rear + ceil((front - rear) / {0}D) * {0}D".format(slice_m))
    wide = sliced.groupBy(key, F.floor((F.col("s") - F.col("rear")) / slice_m).alias("i")).agg((F.max("t") - F.min("t")).alias("w"), F.count("*").alias("n")).filter("n >= 2").groupBy(F.col(key).alias("_s")).agg(F.median("w").alias("width"))
    j = span.join(ends, F.expr("_w = _e")).join(tops, F.expr("_w = _h")).join(wide, F.expr("_w = _s"))
    along, mid = F.col("rear") + overhang, (F.col("t0") + F.col("t1")) / 2
    ox, oy = F.col("cx") + along * F.cos("heading") - mid * F.sin("heading"), F.col("cy") + along * F.sin("heading") + mid * F.cos("heading")
    return j.select(F.col("_w").alias(key), "heading", ox.alias("ox"), oy.alias("oy"), F.expr("front - rear").alias("length"), "width", F.expr("t1 - t0").alias("full_width"), "height")


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, in order around it."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points
    halves = []
    for side in (points, points[::-1]):
        chain: list[np.ndarray] = []
        for p in side:
            while len(chain) > 1 and _turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        halves += chain[:-1]
    return np.array(halves)


def _corners(key: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(pdf[["x", "y"]].to_numpy(dtype=float))
        return pd.DataFrame({key: pdf[key].iloc[0], "x": hull[:, 0], "y": hull[:, 1]})

    return run


def _least_box(key: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = _hull(pdf[["x", "y"]].to_numpy(dtype=float))
        side = np.roll(hull, -1, axis=0) - hull
        angles = np.unique(np.mod(np.arctan2(side[:, 1], side[:, 0]), np.pi / 2)) if len(hull) > 1 else np.zeros(1)
        best = None
        for a in angles:
            c, s = np.cos(a), np.sin(a)
            u, v = hull @ np.array([c, s]), hull @ np.array([-s, c])
            w, d, mu, mv = np.ptp(u), np.ptp(v), (u.min() + u.max()) / 2, (v.min() + v.max()) / 2
            if best is None or w * d < best[0] - 1e-12:
                best = (w * d, a, c * mu - s * mv, s * mu + c * mv, w, d)
        return pd.DataFrame([(pdf[key].iloc[0], len(hull), *best)], columns=[key, "n_corners", "area", "angle", "x", "y", "along", "across"])

    return run


def enclosing_boxes(points: DataFrame, key: str, row: str, *, parts: int = 64) -> DataFrame:
    """``key, n_corners, area, angle, x, y, along, across``: the rectangle of least area around each key's places in plan (``key``
    a string, not null).  Hulls are taken of ``parts`` hash parts first, then of their corners: no task holds a key's places."""
    ship_package(points.sparkSession)
    there = points.filter(f"`{key}` IS NOT NULL AND abs(x) < 1e15D AND abs(y) < 1e15D").select(key, "x", "y", F.pmod(F.xxhash64(row), F.lit(parts)).alias("part"))
    corners = there.groupBy(key, "part").applyInPandas(_corners(key), f"`{key}` string, x double, y double")
    return corners.groupBy(key).applyInPandas(_least_box(key), f"`{key}` string, n_corners bigint, area double, angle double, x double, y double, along double, across double")

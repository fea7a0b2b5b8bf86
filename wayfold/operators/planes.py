"""Planes and planar motions through points, by least squares and by samples."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.clouds import planar_fit
from wayfold.sources.checkpoints import cut


def least_spread(m: DataFrame) -> DataFrame:
    """Adds ``low``, the least variance in any direction, to rows with the covariances ``cxx, cyy, czz, cxy, cxz, cyz``: the least
    root of their characteristic cubic, by its trigonometric solution."""
    m = m.withColumn("_mean", F.expr("(cxx + cyy + czz) / 3")).withColumns({f"_{c}": F.expr(f"c{c}{c} - _mean") for c in "xyz"})
    m = m.withColumns({"_p": F.expr("sqrt((_x * _x + _y * _y + _z * _z + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6)"), "_det": F.expr("_x * (_y * _z - cyz * cyz) - cxy * (cxy * _z - cyz * cxz) + cxz * (cxy * cyz - _y * cxz)")})
    m = m.withColumn("_turn", F.expr("acos(greatest(-1D, least(1D, try_divide(_det, 2 * _p * _p * _p)))) / 3"))
    return m.withColumn("low", F.col("_mean") + 2 * F.col("_p") * F.cos(F.col("_turn") + 2 * math.pi / 3)).drop("_mean", "_x", "_y", "_z", "_p", "_det", "_turn")


def fitted_planes(points: DataFrame, key: str) -> DataFrame:
    """``key, n, nx, ny, nz, d, spread``: the total least-squares plane of each key's ``x, y, z``, its normal upwards;
    ``spread`` is the variance across it.  Keys under 3 points, or spread the same in all directions, have a null normal."""
    m = points.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")])
    # One row per key by now; the cut keeps the long formulas below from being written into one another.
    m = cut(least_spread(m).withColumns({f"e{c}": F.expr(f"c{c}{c} - low") for c in "xyz"}))
    rows = [[F.col(c) for c in r] for r in (("ex", "cxy", "cxz"), ("cxy", "ey", "cyz"), ("cxz", "cyz", "ez"))]
    for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        v = [rows[i][a] * rows[j][b] - rows[i][b] * rows[j][a] for a, b in ((1, 2), (2, 0), (0, 1))]
        m = m.withColumns({f"v{n}{k}": v[k] for k in range(3)}).withColumn(f"s{n}", F.sqrt(sum((F.col(f"v{n}{k}") * F.col(f"v{n}{k}") for k in range(1, 3)), F.col(f"v{n}0") * F.col(f"v{n}0"))))
    best = F.greatest("s0", "s1", "s2")
    parts = [F.try_divide(F.when(F.col("s0") == best, F.col(f"v0{k}")).when(F.col("s1") == best, F.col(f"v1{k}")).otherwise(F.col(f"v2{k}")), best) for k in range(3)]
    m = m.withColumns({f"u{k}": F.when(F.col("n") >= 3, parts[k]) for k in range(3)}).withColumn("up", F.when(F.col("u2") < 0, -1.0).otherwise(1.0))
    m = m.select(key, "n", *[(F.col(f"u{k}") * F.col("up")).alias(f"n{c}") for k, c in enumerate("xyz")], "mx", "my", "mz", F.greatest("low", F.lit(0.0)).alias("spread"))
    return m.select(key, "n", "nx", "ny", "nz", (-(F.col("nx") * F.col("mx") + F.col("ny") * F.col("my") + F.col("nz") * F.col("mz"))).alias("d"), "spread")


def samples(points: DataFrame, key: str, row: str, size: int, tries: int, seed: int, fields: list[str]) -> DataFrame:
    """``key, try`` and ``<field>0 .. <field><size-1>``: up to ``tries`` disjoint samples of ``size`` rows of each key, by a hash
    of seed and row, so that the same data give the same samples."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(row).cast("string")))
    numbered = points.select(key, row, *fields, draw.alias("_draw")).withColumn("_no", F.expr(f"row_number() OVER (PARTITION BY `{key}` ORDER BY _draw, `{row}`) - 1")).filter(F.col("_no") < size * tries)
    place = F.pmod("_no", F.lit(size))
    cells = [F.max(F.when(place == i, F.col(f))).alias(f"{f}{i}") for f in fields for i in range(size)]
    return numbered.groupBy(key, F.expr(f"_no div {size}").alias("try")).agg(*cells, F.count("*").alias("_n")).filter(F.col("_n") == size).drop("_n")


def sampled_planes(points: DataFrame, key: str, row: str, *, threshold: float, tries: int, seed: int, most_tilt_deg: float) -> DataFrame:
    """``key, try, n_inliers, residual, nx, ny, nz, d``: of the planes through sampled triples of each key the one with most
    points within ``threshold`` (then the least mean residual, the first try); steeper ones than ``most_tilt_deg`` don't count.
    The tries are a fixed few a key, so points are only repeated that often."""
    s = samples(points, key, row, 3, tries, seed, ["x", "y", "z"])
    e = [[F.col(f"{c}{i}") - F.col(f"{c}0") for c in "xyz"] for i in (1, 2)]
    s = s.withColumns({f"w{k}": e[0][a] * e[1][b] - e[0][b] * e[1][a] for k, (a, b) in enumerate(((1, 2), (2, 0), (0, 1)))})
    s = s.withColumn("len", F.sqrt(F.col("w0") * F.col("w0") + F.col("w1") * F.col("w1") + F.col("w2") * F.col("w2"))).filter("len > 1e-12")
    sign = F.when(F.col("w2") < 0, -1.0).otherwise(1.0)
    s = s.select(key, "try", *[(F.col(f"w{k}") / F.col("len") * sign).alias(f"n{c}") for k, c in enumerate("xyz")], "x0", "y0", "z0").filter(F.col("nz") >= math.cos(math.radians(most_tilt_deg)))
    s = s.select(key, "try", "nx", "ny", "nz", (-(F.col("nx") * F.col("x0") + F.col("ny") * F.col("y0") + F.col("nz") * F.col("z0"))).alias("d"))
    far = F.abs(F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") + F.col("d"))
    met = points.select(key, "x", "y", "z").join(s, key).select(key, "try", "nx", "ny", "nz", "d", far.alias("far")).filter(F.col("far") < threshold)
    tried = met.groupBy(key, "try", "nx", "ny", "nz", "d").agg(F.count("*").alias("n_inliers"), F.round(F.avg("far"), 9).alias("residual"))
    best = tried.groupBy(key).agg(F.min(F.struct((-F.col("n_inliers")).alias("a"), "residual", "try", "nx", "ny", "nz", "d")).alias("m")).filter("-m.a >= 3")
    return best.select(key, F.col("m.try").alias("try"), (-F.col("m.a")).alias("n_inliers"), *[F.col(f"m.{c}").alias(c) for c in ("residual", "nx", "ny", "nz", "d")])


def sampled_motions(pairs: DataFrame, key: str, row: str, *, threshold: float, tries: int, seed: int, least: int) -> DataFrame:
    """``key, n, n_inliers, yaw, dx, dy``: the planar motion that takes ``x, y`` to ``u, v``, robust against wrong pairs.

    Motions through sampled pairs of rows are tried; the one that takes most rows within ``threshold`` (the first among
    equals) chooses the rows that the motion is fitted to.  Keys with under ``least`` such rows have no row.
    """
    s = samples(pairs, key, row, 2, tries, seed, ["x", "y", "u", "v"])
    ax, ay, bx, by = (F.col(f"{c}1") - F.col(f"{c}0") for c in "xyuv")
    s = s.filter(F.hypot(ax, ay) >= 1e-6).withColumn("yaw", F.atan2(ax * by - ay * bx, ax * bx + ay * by))
    mid = {c: (F.col(f"{c}0") + F.col(f"{c}1")) / 2 for c in "xyuv"}
    s = s.select(key, "try", "yaw", (mid["u"] - (F.cos("yaw") * mid["x"] - F.sin("yaw") * mid["y"])).alias("dx"), (mid["v"] - (F.sin("yaw") * mid["x"] + F.cos("yaw") * mid["y"])).alias("dy"))
    off = F.hypot(F.cos("yaw") * F.col("x") - F.sin("yaw") * F.col("y") + F.col("dx") - F.col("u"), F.sin("yaw") * F.col("x") + F.cos("yaw") * F.col("y") + F.col("dy") - F.col("v"))
    tried = pairs.select(key, "x", "y", "u", "v").join(s, key).filter(off < threshold).groupBy(key, "try", "yaw", "dx", "dy").agg(F.count("*").alias("n_in"))
    best = tried.groupBy(key).agg(F.min(F.struct((-F.col("n_in")).alias("a"), "try", "yaw", "dx", "dy")).alias("m")).filter(-F.col("m.a") >= least)
    best = best.select(F.col(key).alias("_k"), "m.yaw", "m.dx", "m.dy")
    chosen = pairs.select(key, "x", "y", "u", "v").join(best, F.col(key) == F.col("_k")).filter(off < threshold)
    fit = planar_fit(chosen.select(key, "x", "y", "u", "v"), key).withColumnRenamed("n", "n_inliers")
    return fit.join(pairs.groupBy(key).agg(F.count("*").alias("n")), key).select(key, "n", "n_inliers", "yaw", "dx", "dy")

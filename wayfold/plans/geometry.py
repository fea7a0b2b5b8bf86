"""Queries that place boxes and masks on the ground, fit planes and motions, cut fans, and look under the vehicle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import frames as G
from wayfold.functions import settings as S
from wayfold.operators import clouds, planes
from wayfold.operators import risk as R
from wayfold.operators.sweep import COMPONENTS, component_table
from wayfold.plans.capture import _ego, _ego_sql
from wayfold.plans.detections import _BX, C, CX, CY, FX, HEIGHT, N, UP, boxes
from wayfold.plans.perception import _MAP, _CELLS, _OBS, MAP_CELL, MAP_SIZE, height_maps, placed
from wayfold.plans.risk import _COMP, _FRAMES, distinct_frames

MOST_RANGE, PIXEL_SIGMA, BASE_ROWS = 25.0, 2.0, 12


def _eye():
    return G.vec(0.0, 0.0, UP)


def _ray(u, v):
    return G.pixel_ray(G.vec(0.0, -N, C, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -C, -N, UP, 0.0, 0.0, 0.0, 1.0), u, v, FX, FX, CX, CY)


def box_obstacles(spark: SparkSession, folder: str) -> DataFrame:
    """Obstacles made anew from their image boxes: the lower edge stands on the ground and is the near one, the footprint is
    square; without a usable pixel error the deviation is the most range, and ``planned`` that by distance."""
    b = boxes(spark, folder).select("obs_row", ((F.col("x0") + F.col("x1")) / 2).alias("u"), "x0", "x1", F.col("y0").alias("top"), F.col("y1").alias("v"))
    rays = {"mid": ("u", F.col("v")), "first": ("x0", F.col("v")), "last": ("x1", F.col("v")), "up": ("u", F.col("top")), "above": ("u", F.col("v") - PIXEL_SIGMA), "below": ("u", F.col("v") + PIXEL_SIGMA)}
    g = b.select("obs_row", *[_ray(F.col(u), v).alias(n) for n, (u, v) in rays.items()])
    g = g.select("obs_row", "up", *[G.on_ground(_eye(), F.col(r), MOST_RANGE).alias(n) for n, r in (("base", "mid"), ("left", "first"), ("right", "last"))], G.ground_sigma(_eye(), F.col("above"), F.col("below")).alias("sigma")).filter("base IS NOT NULL")
    g = g.select("obs_row", G.at(F.col("base"), 0).alias("bx"), G.at(F.col("base"), 1).alias("by"), "up", "sigma", F.coalesce(F.hypot(F.expr("left[0] - right[0]"), F.expr("left[1] - right[1]")), F.lit(0.0)).alias("width"))
    x, y = G.pushed(_eye(), F.col("bx"), F.col("by"), F.col("width") / 2)
    height = F.greatest(F.lit(0.0), G.height_over(_eye(), F.col("up"), F.col("bx"), F.col("by")))
    sigma = F.when(F.col("sigma") < float("inf"), F.col("sigma")).otherwise(MOST_RANGE)
    return g.select("obs_row", *[F.round(c, 4).alias(n) for n, c in (("x", x), ("y", y), ("width", F.col("width")), ("height", height), ("sigma", sigma), ("planned", G.planned_sigma(F.hypot("bx", "by"))))])


def mask_obstacles(spark: SparkSession, folder: str) -> DataFrame:
    """One obstacle per pass and track from the mask of all its pixels: the lowest rows touch the ground, their spread is the
    width and their middle the near edge.  Masks that reach the last row of the image have none."""
    # Spark may cast before it drops boxes beside the camera, whose pixels go beyond any integer.
    m = boxes(spark, folder).select("pass_id", "id", F.round((F.col("x0") + F.col("x1")) / 2).try_cast("int").alias("col"), F.round("y1").try_cast("int").alias("row"), F.round("y0").try_cast("int").alias("top"))
    m = m.select("pass_id", "id", "col", F.explode(F.array("row", "top")).alias("row")).filter(F.col("row").between(0, HEIGHT - 1) & F.col("col").between(0, 1279)).distinct()
    ends = m.groupBy("pass_id", "id").agg(F.max("row").alias("low"), F.min("row").alias("high")).filter(F.col("low") < HEIGHT - 1)
    m = m.join(ends, ["pass_id", "id"])
    tops = m.groupBy("pass_id", "id").agg(F.avg(F.when(F.col("row") == F.col("high"), F.col("col"))).alias("utop"), F.avg(F.when(F.col("row") == F.col("low"), F.col("col"))).alias("ulow"))
    base = m.filter(F.col("row") >= F.col("low") - BASE_ROWS).withColumn("ray", _ray(F.col("col"), F.col("row"))).withColumn("g", G.on_ground(_eye(), F.col("ray"), MOST_RANGE)).filter("g IS NOT NULL")
    b = base.groupBy("pass_id", "id", "low", "high").agg(*[f(F.expr(f"g[{i}]")).alias(f"{n}{c}") for i, c in enumerate("xy") for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("n_base"))
    b = b.join(tops, ["pass_id", "id"]).withColumn("width", F.greatest(F.expr("hix - lox"), F.expr("hiy - loy")))
    x, y = G.pushed(_eye(), F.expr("(lox + hix) / 2"), F.expr("(loy + hiy) / 2"), F.col("width") / 2)
    b = b.withColumns({"cx": x, "cy": y, "up": _ray(F.col("utop"), F.col("high")), "above": _ray(F.col("ulow"), F.col("low") - PIXEL_SIGMA), "below": _ray(F.col("ulow"), F.col("low") + PIXEL_SIGMA)})
    height = F.greatest(F.lit(0.0), G.height_over(_eye(), F.col("up"), F.col("cx"), F.col("cy")))
    b = b.withColumn("s", G.ground_sigma(_eye(), F.col("above"), F.col("below")))
    sigma = F.col("s")
    return b.select("pass_id", "id", "n_base", *[F.round(c, 4).alias(n) for n, c in (("x", F.col("cx")), ("y", F.col("cy")), ("width", F.col("width")), ("height", height), ("sigma", F.when(sigma < float("inf"), sigma).otherwise(MOST_RANGE)))])


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return placed(spark, folder).select("pass_id", "obs_row", "x", "y", "z").filter("abs(x) < 60 AND abs(y) < 60")


def plane_fits(spark: SparkSession, folder: str) -> DataFrame:
    """The plane through each pass's obstacle centres, its tilt, and how many lie within half a metre of it."""
    p = _points(spark, folder)
    f = planes.fitted_planes(p, "pass_id").filter("nx IS NOT NULL")
    normal, here = F.array("nx", "ny", "nz"), F.array("x", "y", "z")
    far = p.join(f.select("pass_id", "nx", "ny", "nz", "d"), "pass_id").groupBy("pass_id").agg(F.count_if(F.abs(G.plane_distance(normal, F.col("d"), here)) < 0.5).alias("n_near"))
    return f.join(far, "pass_id").select("pass_id", "n", *[F.round(c, 4).alias(c) for c in ("nx", "ny", "nz", "d", "spread")], F.round(G.tilt_deg(normal, G.vec(0.0, 0.0, 1.0)), 3).alias("tilt_deg"), "n_near")


def sampled_planes(spark: SparkSession, folder: str) -> DataFrame:
    p = planes.sampled_planes(_points(spark, folder), "pass_id", "obs_row", threshold=0.3, tries=16, seed=3, most_tilt_deg=30.0)
    return p.select("pass_id", "try", "n_inliers", *[F.round(c, 6).alias(c) for c in ("residual", "nx", "ny", "nz", "d")])


def sampled_motions(spark: SparkSession, folder: str) -> DataFrame:
    """The planar motion between successive instants of each pass's tracks, against wrong pairs."""
    over = "OVER (PARTITION BY pass_id, id ORDER BY t_ns)"
    p = placed(spark, folder).select("pass_id", "obs_row", "x", "y", F.expr(f"lead(x) {over}").alias("u"), F.expr(f"lead(y) {over}").alias("v")).filter("u IS NOT NULL")
    return planes.sampled_motions(p, "pass_id", "obs_row", threshold=0.5, tries=12, seed=5, least=10).withColumns({c: F.round(c, 6) for c in ("yaw", "dx", "dy")})


def cut_fans(spark: SparkSession, folder: str) -> DataFrame:
    """The fan of each frame with a predicted contact, cut there: steps kept, and the exact pose at the cut as x, y,
    heading, and the first row of its transform.  A contact at or beyond the horizon leaves the fan whole."""
    first = R.exploded(distinct_frames(spark, folder)).filter("ttc_s >= 0 AND ego_speed_mps IS NOT NULL").groupBy("pass_id", "t_ns").agg(F.min("ttc_s").alias("cut_s"), F.first("ego_speed_mps").alias("v"))
    end = F.least(F.col("cut_s"), F.lit(S.HORIZON_S))
    steps = F.when(F.col("cut_s") >= S.HORIZON_S, round(S.HORIZON_S / S.STEP_S) + 1).otherwise(F.ceil(F.round(end / S.STEP_S, 9)) + 1)
    f = first.select("pass_id", "t_ns", "v", end.alias("end_s"), steps.cast("int").alias("n_steps"), F.explode(F.array(*[F.lit(k) for k in S.CURVATURES])).alias("curvature"))
    x, y, a = G.curved(F.col("curvature"), F.col("v") * F.col("end_s"))
    f = f.select("pass_id", "t_ns", "curvature", "n_steps", F.round(F.col("end_s") * 1e9).cast("bigint").alias("end_ns"), x.alias("x"), y.alias("y"), a.alias("heading"))
    t = G.planar(F.col("x"), F.col("y"), F.col("heading"))
    return f.select("pass_id", "t_ns", "curvature", "n_steps", "end_ns", *[F.round(c, 8).alias(c) for c in ("x", "y", "heading")], *[F.round(G.at(t, i), 8).alias(f"t0{i}") for i in range(4)])


LOW_Z, MARGIN, UNDER_SPEED, UNDER_CURVATURE = 0.30, 0.02, 1.0, 0.05


def underbody_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per pass and low component: the least clearance over the mapped cells it passes on a curve of 3 s, and the first step at
    which it is under the margin.  Cells are taken back to the vehicle at each step and tested against its boxes."""
    cells = height_maps(spark, folder).filter(F.col("height") > S.OBSTACLE_HEIGHT).select("pass_id", "height", ((F.col("ci") + 0.5) * MAP_CELL - MAP_SIZE / 2).alias("px"), ((F.col("cj") + 0.5) * MAP_CELL - MAP_SIZE / 2).alias("py")).filter("abs(px) < 10 AND abs(py) < 10")
    poses = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(30))).alias("i"))
    x, y, a = G.curved(F.lit(UNDER_CURVATURE), F.lit(UNDER_SPEED) * F.col("i") * S.STEP_S)
    p = poses.select("pass_id", "height", "i", (F.col("px") - x).alias("dx"), (F.col("py") - y).alias("dy"), a.alias("a"))
    p = p.select("pass_id", "height", "i", (F.cos("a") * F.col("dx") + F.sin("a") * F.col("dy")).alias("vx"), (F.cos("a") * F.col("dy") - F.sin("a") * F.col("dx")).alias("vy"))
    low = component_table(spark).filter(F.col("zmin") <= LOW_Z)
    met = p.join(F.broadcast(low), F.expr("vx BETWEEN xmin AND xmax AND vy BETWEEN ymin AND ymax"))  # a fixed few components
    steps = met.groupBy("pass_id", "component", "i").agg((F.first("zmin") - F.max("height")).alias("clearance"))
    return steps.groupBy("pass_id", "component").agg(F.round(F.min("clearance"), 6).alias("clearance"), F.round(F.min(F.when(F.col("clearance") < MARGIN, F.col("i"))) * S.STEP_S, 6).alias("ttc_s"))


def door_points(spark: SparkSession, folder: str) -> DataFrame:
    """Obstacle centres taken to a hinged door's frame, which hangs askew by the pass's yaw rate, and back to the vehicle with the
    door opened by it: a joint out of its limits has none."""
    q = _ego(spark, folder, "yaw_rate_radps").groupBy("pass_id").agg(F.max("yaw_rate_radps").alias("q"))
    q = q.select("pass_id", "q", G.rot("z", F.col("q") + 1.0).alias("rz"), G.rot("y", F.col("q") * 0.2).alias("ry"), G.rot("x", F.col("q") * 0.1).alias("rx"))
    q = q.withColumn("zy", G.product3(F.col("rz"), F.col("ry"))).withColumn("r", G.product3(F.col("zy"), F.col("rx"))).withColumn("origin", G.transform_of(F.col("r"), G.vec(1.0, -0.95, 0.5)))
    q = q.withColumn("inverse", G.inverted(F.col("origin"))).withColumn("motion", G.joint_motion("revolute", G.vec(0.0, 0.0, 2.0), F.col("q"), -0.5, 1.2))
    o = _points(spark, folder).join(q.select("pass_id", "origin", "inverse", "motion"), "pass_id").select("obs_row", F.array("x", "y", "z").alias("p"), "origin", "inverse", "motion")
    for name, by, what in (("child", "inverse", "p"), ("swung", "motion", "child"), ("back", "origin", "swung")):
        o = o.withColumn(name, G.moved(F.col(by), F.col(what)))
    return o.select("obs_row", F.col("motion").isNotNull().alias("within"), *[F.round(G.at(F.col("back"), i), 6).alias(c) for i, c in enumerate("xyz")])


QUERIES = {q.__name__: q for q in (box_obstacles, mask_obstacles, plane_fits, sampled_planes, sampled_motions, cut_fans, underbody_checks, door_points)}


def _ground_sql(u: str, v: str, most: str = "1e308") -> tuple[str, str]:
    """x and y of a pixel's ground point; null where it has none."""
    a, b = f"(({u} - {CX}) / {FX})", f"(({v} - {CY}) / {FX})"
    far = f"({UP}::DOUBLE / ({C!r}::DOUBLE * {b} + {N!r}::DOUBLE))"
    x, y = f"{far} * ({C!r}::DOUBLE - {N!r}::DOUBLE * {b})", f"-{far} * {a}"
    ok = f"{C!r}::DOUBLE * {b} + {N!r}::DOUBLE > 0 AND sqrt(({x}) ** 2 + ({y}) ** 2) <= {most}"
    return f"CASE WHEN {ok} THEN {x} END", f"CASE WHEN {ok} THEN {y} END"


def _height_sql(u: str, v: str, x: str, y: str) -> str:
    a, b = f"(({u} - {CX}) / {FX})", f"(({v} - {CY}) / {FX})"
    dx, dy, dz = f"({C!r}::DOUBLE - {N!r}::DOUBLE * {b})", f"(-{a})", f"(-{C!r}::DOUBLE * {b} - {N!r}::DOUBLE)"
    return f"greatest(0::DOUBLE, {UP}::DOUBLE + ({x} * {dx} + {y} * {dy}) / ({dx} * {dx} + {dy} * {dy}) * {dz})"


def _sigma_sql(u: str, v: str) -> str:
    (ax, ay), (bx, by) = _ground_sql(u, f"({v} - {PIXEL_SIGMA})"), _ground_sql(u, f"({v} + {PIXEL_SIGMA})")
    return f"coalesce(sqrt((({ax}) - ({bx})) ** 2 + (({ay}) - ({by})) ** 2) / 2, {MOST_RANGE})"


def _pushed_sql(x: str, y: str, by: str) -> tuple[str, str]:
    return tuple(f"({c} + {c} / sqrt({x} * {x} + {y} * {y}) * {by})" for c in (x, y))


_PTS = "pt AS (SELECT pass_id, obs_row, id, t_ns, x, y, z FROM obs WHERE abs(x) < 60 AND abs(y) < 60)"
_B = _ground_sql("u", "v", str(MOST_RANGE))
_L, _RIGHT = _ground_sql("x0", "v", str(MOST_RANGE)), _ground_sql("x1", "v", str(MOST_RANGE))
_P = _pushed_sql("ax", "ay", "width / 2")
_MG = _ground_sql("col", "row", str(MOST_RANGE))
_MP = _pushed_sql("nx", "ny", "width / 2")
_FAN = ", ".join(f"({k}::DOUBLE)" for k in S.CURVATURES)
_LOW = ", ".join(f"('{n}', {x0}::DOUBLE, {y0}::DOUBLE, {z0}::DOUBLE, {x1}::DOUBLE, {y1}::DOUBLE)" for n, x0, y0, z0, x1, y1, _ in COMPONENTS if z0 <= LOW_Z)


def _curve_sql(k: str, s: str) -> tuple[str, str, str]:
    a = f"({k} * ({s}))"
    return f"CASE WHEN abs({a}) < 1e-4 THEN {s} * (1 - {a} * {a} / 6) ELSE sin({a}) / {k} END", f"CASE WHEN abs({a}) < 1e-4 THEN {s} * ({a} / 2 - {a} * {a} * {a} / 24) ELSE (1 - cos({a})) / {k} END", a


_CX, _CY, _CA = _curve_sql("curvature", "v * end_s")
_UX, _UY, _UA = _curve_sql(f"{UNDER_CURVATURE}::DOUBLE", f"{UNDER_SPEED}::DOUBLE * i * {S.STEP_S}::DOUBLE")


def _samples_sql(table: str, size: int, tries: int, seed: int, fields: str) -> str:
    cells = ", ".join(f"max({f}) FILTER (no % {size} = {i}) AS {f}{i}" for f in fields for i in range(size))
    return f"sm AS (SELECT pass_id, no // {size} AS try, {cells} FROM (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY md5('{seed}|' || obs_row), obs_row) - 1 AS no FROM {table}) WHERE no < {size * tries} GROUP BY 1, 2 HAVING count(*) = {size})"


ORACLES = {
    "box_obstacles": f"""WITH {_BX}, b AS (SELECT obs_row, (x0 + x1) / 2 AS u, x0, x1, y0 AS top, y1 AS v FROM bx), g AS (SELECT obs_row, u, top, v, {_B[0]} AS ax, {_B[1]} AS ay, coalesce(sqrt((({_L[0]}) - ({_RIGHT[0]})) ** 2 + (({_L[1]}) - ({_RIGHT[1]})) ** 2), 0) AS width FROM b)
 SELECT obs_row, round({_P[0]}, 4) AS x, round({_P[1]}, 4) AS y, round(width, 4) AS width, round({_height_sql('u', 'top', 'ax', 'ay')}, 4) AS height, round({_sigma_sql('u', 'v')}, 4) AS sigma, round(0.05::DOUBLE + 0.03::DOUBLE * sqrt(ax * ax + ay * ay), 4) AS planned FROM g WHERE ax IS NOT NULL""",
    "mask_obstacles": f"""WITH {_BX}, m AS (SELECT DISTINCT pass_id, id, col, row FROM (SELECT pass_id, id, round((x0 + x1) / 2)::INT AS col, unnest([round(y1)::INT, round(y0)::INT]) AS row FROM bx) WHERE row BETWEEN 0 AND {HEIGHT - 1} AND col BETWEEN 0 AND 1279),
 e AS (SELECT * FROM (SELECT *, max(row) OVER w AS low, min(row) OVER w AS high FROM m WINDOW w AS (PARTITION BY pass_id, id)) WHERE low < {HEIGHT - 1}), t AS (SELECT pass_id, id, avg(col) FILTER (row = high) AS utop, avg(col) FILTER (row = low) AS ulow FROM e GROUP BY 1, 2),
 b AS (SELECT pass_id, id, low, high, min(gx) AS lox, max(gx) AS hix, min(gy) AS loy, max(gy) AS hiy, count(*) AS n_base FROM (SELECT *, {_MG[0]} AS gx, {_MG[1]} AS gy FROM e WHERE row >= low - {BASE_ROWS}) WHERE gx IS NOT NULL GROUP BY 1, 2, 3, 4),
 c AS (SELECT *, {_MP[0]} AS cx, {_MP[1]} AS cy FROM (SELECT *, greatest(hix - lox, hiy - loy) AS width, (lox + hix) / 2 AS nx, (loy + hiy) / 2 AS ny FROM b JOIN t USING (pass_id, id)))
 SELECT pass_id, id, n_base, round(cx, 4) AS x, round(cy, 4) AS y, round(width, 4) AS width, round({_height_sql('utop', 'high', 'cx', 'cy')}, 4) AS height, round({_sigma_sql('ulow', 'low')}, 4) AS sigma FROM c""",
    "sampled_planes": f"""WITH {_OBS}, {_PTS}, {_samples_sql('pt', 3, 16, 3, 'xyz')}, w AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS w0, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS w1, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS w2 FROM sm),
 u AS (SELECT pass_id, try, x0, y0, z0, w0 / l * s AS nx, w1 / l * s AS ny, w2 / l * s AS nz FROM (SELECT *, sqrt(w0 * w0 + w1 * w1 + w2 * w2) AS l, CASE WHEN w2 < 0 THEN -1 ELSE 1 END AS s FROM w) WHERE l > 1e-12), n AS (SELECT *, -(nx * x0 + ny * y0 + nz * z0) AS d FROM u WHERE nz >= {math.cos(math.radians(30))!r}::DOUBLE),
 f AS (SELECT n.*, abs(nx * x + ny * y + nz * z + d) AS far FROM n JOIN pt USING (pass_id)), c AS (SELECT pass_id, try, nx, ny, nz, d, count(*) AS n_inliers, round(avg(far), 9) AS residual FROM f WHERE far < 0.3 GROUP BY ALL)
 SELECT pass_id, try, n_inliers, round(residual, 6) AS residual, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY n_inliers DESC, residual, try) AS k FROM c) WHERE k = 1 AND n_inliers >= 3""",
    "sampled_motions": f"""WITH {_OBS}, pr AS (SELECT * FROM (SELECT pass_id, obs_row, x, y, lead(x) OVER w AS u, lead(y) OVER w AS v FROM obs WINDOW w AS (PARTITION BY pass_id, id ORDER BY t_ns)) WHERE u IS NOT NULL), {_samples_sql('pr', 2, 12, 5, 'xyuv')},
 a AS (SELECT *, atan2((x1 - x0) * (v1 - v0) - (y1 - y0) * (u1 - u0), (x1 - x0) * (u1 - u0) + (y1 - y0) * (v1 - v0)) AS yaw FROM sm WHERE sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) >= 1e-6),
 b AS (SELECT pass_id, try, yaw, (u0 + u1) / 2 - (cos(yaw) * (x0 + x1) / 2 - sin(yaw) * (y0 + y1) / 2) AS dx, (v0 + v1) / 2 - (sin(yaw) * (x0 + x1) / 2 + cos(yaw) * (y0 + y1) / 2) AS dy FROM a),
 i AS (SELECT b.*, x, y, u, v FROM b JOIN pr USING (pass_id) WHERE sqrt((cos(yaw) * x - sin(yaw) * y + dx - u) ** 2 + (sin(yaw) * x + cos(yaw) * y + dy - v) ** 2) < 0.5), r AS (SELECT pass_id, try FROM (SELECT pass_id, try, count(*) AS n, row_number() OVER (PARTITION BY pass_id ORDER BY count(*) DESC, try) AS k FROM i GROUP BY 1, 2) WHERE k = 1 AND n >= 10),
 p AS (SELECT i.* FROM i JOIN r USING (pass_id, try)), m AS (SELECT pass_id, count(*) AS n_inliers, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM p GROUP BY 1),
 s AS (SELECT pass_id, any_value(n_inliers) AS n_inliers, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv, atan2(sum((x - mx) * (v - mv) - (y - my) * (u - mu)), sum((x - mx) * (u - mu) + (y - my) * (v - mv))) AS yaw FROM p JOIN m USING (pass_id) GROUP BY 1)
 SELECT pass_id, n, n_inliers, round(yaw, 6) AS yaw, round(mu - (cos(yaw) * mx - sin(yaw) * my), 6) AS dx, round(mv - (sin(yaw) * mx + cos(yaw) * my), 6) AS dy FROM s JOIN (SELECT pass_id, count(*) AS n FROM pr GROUP BY 1) USING (pass_id)""",
    "cut_fans": f"""WITH {_FRAMES}, {_COMP}, f AS (SELECT pass_id, t_ns, any_value(ego_speed_mps) AS v, min(ttc_s) AS cut_s FROM comp WHERE ttc_s >= 0 AND ego_speed_mps IS NOT NULL GROUP BY 1, 2),
 e AS (SELECT pass_id, t_ns, curvature, v, least(cut_s, {S.HORIZON_S}::DOUBLE) AS end_s, CASE WHEN cut_s >= {S.HORIZON_S} THEN {round(S.HORIZON_S / S.STEP_S) + 1} ELSE ceil(round(cut_s / {S.STEP_S}::DOUBLE, 9)) + 1 END::INT AS n_steps FROM f, (VALUES {_FAN}) c(curvature)),
 p AS (SELECT *, {_CX} AS x, {_CY} AS y, {_CA} AS heading FROM e)
 SELECT pass_id, t_ns, curvature, n_steps, round(end_s * 1e9::DOUBLE)::BIGINT AS end_ns, round(x, 8) AS x, round(y, 8) AS y, round(heading, 8) AS heading, round(cos(heading), 8) AS t00, round(-sin(heading), 8) AS t01, 0::DOUBLE AS t02, round(x, 8) AS t03 FROM p""",
    "underbody_checks": f"""WITH {_OBS}, {_CELLS}, {_MAP}, c AS (SELECT * FROM (SELECT pass_id, height, (ci + 0.5::DOUBLE) * {MAP_CELL} - {MAP_SIZE / 2} AS px, (cj + 0.5::DOUBLE) * {MAP_CELL} - {MAP_SIZE / 2} AS py FROM hm WHERE height > {S.OBSTACLE_HEIGHT}) WHERE abs(px) < 10 AND abs(py) < 10),
 p AS (SELECT pass_id, height, i, px - ({_UX}) AS dx, py - ({_UY}) AS dy, {_UA} AS a FROM c, (SELECT range AS i FROM range(0, 31))), v AS (SELECT pass_id, height, i, cos(a) * dx + sin(a) * dy AS vx, cos(a) * dy - sin(a) * dx AS vy FROM p),
 s AS (SELECT pass_id, component, i, any_value(zmin) - max(height) AS clearance FROM v JOIN (VALUES {_LOW}) l(component, xmin, ymin, zmin, xmax, ymax) ON vx BETWEEN xmin AND xmax AND vy BETWEEN ymin AND ymax GROUP BY 1, 2, 3)
 SELECT pass_id, component, round(min(clearance), 6) AS clearance, round(min(i) FILTER (clearance < {MARGIN}) * {S.STEP_S}::DOUBLE, 6) AS ttc_s FROM s GROUP BY 1, 2""",
    "door_points": f"""WITH {_OBS}, {_PTS}, {_ego_sql("yaw_rate_radps")}, q AS (SELECT pass_id, max(yaw_rate_radps) AS q FROM ego GROUP BY 1), t AS (SELECT *, cos(q + 1.0) AS cy, sin(q + 1.0) AS sy, cos(q * 0.2::DOUBLE) AS cp, sin(q * 0.2::DOUBLE) AS sp, cos(q * 0.1::DOUBLE) AS cr, sin(q * 0.1::DOUBLE) AS sr FROM q),
 r AS (SELECT pass_id, q, cy * cp AS r0, cy * sp * sr - sy * cr AS r1, cy * sp * cr + sy * sr AS r2, sy * cp AS r3, sy * sp * sr + cy * cr AS r4, sy * sp * cr - cy * sr AS r5, -sp AS r6, cp * sr AS r7, cp * cr AS r8 FROM t),
 p AS (SELECT obs_row, r.*, x - 1.0 AS x, y + 0.95::DOUBLE AS y, z - 0.5::DOUBLE AS z FROM pt JOIN r USING (pass_id)), c AS (SELECT *, r0 * x + r3 * y + r6 * z AS cx, r1 * x + r4 * y + r7 * z AS cy, r2 * x + r5 * y + r8 * z AS cz FROM p),
 m AS (SELECT *, q BETWEEN -0.5 AND 1.2 AS within, cos(q) * cx - sin(q) * cy AS sx, sin(q) * cx + cos(q) * cy AS sy FROM c)
 SELECT obs_row, within, CASE WHEN within THEN round(r0 * sx + r1 * sy + r2 * cz + 1.0, 6) END AS x, CASE WHEN within THEN round(r3 * sx + r4 * sy + r5 * cz - 0.95::DOUBLE, 6) END AS y, CASE WHEN within THEN round(r6 * sx + r7 * sy + r8 * cz + 0.5::DOUBLE, 6) END AS z FROM m""",
}

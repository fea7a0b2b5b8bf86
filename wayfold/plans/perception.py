"""Queries over obstacles: filters, occupancy, clusters, neighbours, geometry."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import frames as G
from wayfold.functions import settings as S
from wayfold.operators import occupancy as O
from wayfold.operators.medians import exact_medians
from wayfold.plans.capture import _EGO, _ego, _ego_sql
from wayfold.sources.tables import read_table

MAP_CELL, MAP_SIZE = 0.25, 60.0


def placed(spark: SparkSession, folder: str) -> DataFrame:
    """Obstacles with set instant and finite centre, one per pass, track and instant (the smallest row number)."""
    o = read_table(spark, folder, "obstacles").filter("t_ns IS NOT NULL AND size(center_veh) = 3 AND forall(center_veh, v -> abs(v) < 1000)")
    kept = F.struct("obs_row", "rig_id", "kind", "center_veh", "extent", "velocity_veh", "pos_sigma_m", "source")
    o = o.groupBy("pass_id", "id", "t_ns").agg(F.min_by(kept, "obs_row").alias("r")).select("pass_id", "id", "t_ns", "r.*")
    return o.select("*", *[F.expr(f"center_veh[{i}]").alias(c) for i, c in enumerate("xyz")])


def kinds_split(spark: SparkSession, folder: str) -> DataFrame:
    """Obstacles by how they move: unknown kinds count as static."""
    o = placed(spark, folder)
    moves = F.coalesce(F.col("kind").isin("person", "cyclist", "vehicle"), F.lit(False))
    fast = F.coalesce(F.hypot(F.expr("get(velocity_veh, 0)"), F.expr("get(velocity_veh, 1)")) >= 0.3, F.lit(False))
    return o.groupBy(F.coalesce("kind", F.lit("static_geom")).alias("kind"), moves.alias("moves")).agg(F.count("*").alias("n"), F.count_if(fast).alias("n_fast"), F.count_distinct("pass_id", "id").alias("n_tracks"))


def height_maps(spark: SparkSession, folder: str) -> DataFrame:
    points = O.cells(placed(spark, folder), "x", "y", MAP_CELL, MAP_SIZE)
    return O.height_map(points, "pass_id", "t_ns", "z").withColumn("height", F.round("height", 6))


def map_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of the connected tall cells of each pass."""
    m = height_maps(spark, folder).filter(F.col("height") > S.OBSTACLE_HEIGHT)
    boxes = O.cluster_boxes(O.cell_clusters(m, "pass_id").join(m.select("pass_id", "ci", "cj", "height"), ["pass_id", "ci", "cj"]), "pass_id", "height", MAP_CELL, MAP_SIZE)
    return boxes.withColumns({c: F.round(c, 6) for c in ("x", "y", "size_x", "size_y", "top")})


def outside_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Points within the height band, above, below and outside the grid, per source."""
    p = O.cells(placed(spark, folder), "x", "y")
    low, high = S.HEIGHT_BAND
    return p.groupBy("source").agg(F.count_if(F.col("inside") & F.col("z").between(low, high)).alias("n_in"), F.count_if(F.col("z") > high).alias("n_above"), F.count_if(F.col("z") < low).alias("n_below"), F.count_if(~F.col("inside")).alias("n_outside"))


def close_tracks(spark: SparkSession, folder: str) -> DataFrame:
    """Tracks of a pass that come within 4 m of each other at one instant of the pass's clock, rounded to 100 ms."""
    o = placed(spark, folder).withColumn("tick", F.expr("t_ns div 100000000")).select("pass_id", "tick", "id", "obs_row", "x", "y", "z")
    o = o.groupBy("pass_id", "tick", "id").agg(F.min_by(F.struct("x", "y", "z"), "obs_row").alias("c"), F.min("obs_row").alias("row")).select("pass_id", "tick", "id", "row", "c.*")
    pairs = O.within_radius(o.withColumnRenamed("row", "row_a"), o.withColumnRenamed("row", "row_b"), ["pass_id", "tick"], ["x", "y", "z"], 4.0, "row_a", "row_b").filter("row_a < row_b")
    return pairs.withColumn("distance", F.round("distance", 6))


def nearest_obstacles(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest obstacle of each pass in plan: distance, kind, sector ahead."""
    o = placed(spark, folder).select("pass_id", "obs_row", "kind", F.hypot("x", "y").alias("d"), F.atan2("y", "x").alias("a"))
    n = o.groupBy("pass_id").agg(F.min(F.struct("d", "obs_row", "kind", "a")).alias("m"))
    return n.select("pass_id", F.col("m.obs_row").alias("obs_row"), F.col("m.kind").alias("kind"), F.round("m.d", 6).alias("distance"), F.round(F.degrees("m.a"), 4).alias("bearing_deg"))


def range_errors(spark: SparkSession, folder: str) -> DataFrame:
    """By distance bucket: obstacles, median stated deviation of range, and how many state none (errors against the truth are
    ``signed_range_errors``)."""
    o = placed(spark, folder).withColumn("bucket", G.depth_bucket(F.hypot("x", "y"))).filter("bucket IS NOT NULL").withColumn("hour", F.expr("t_ns div 3600000000000"))
    m = exact_medians(o, ["bucket"], "hour", "pos_sigma_m")
    n = o.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if(F.col("pos_sigma_m").isNull()).alias("n_unstated"))
    return n.join(m, "bucket", "left").select("bucket", "n", F.round("median", 6).alias("median_sigma"), "n_unstated")


def contact_chances(spark: SparkSession, folder: str) -> DataFrame:
    """Chance that the gap to each obstacle is closed, by its stated deviation; those that state none have no row."""
    o = placed(spark, folder).filter("pos_sigma_m IS NOT NULL").select("pass_id", "obs_row", "pos_sigma_m", F.hypot("x", "y").alias("d"))
    return o.select("pass_id", "obs_row", F.round(G.gaussian_contact(F.col("d") - 1.0, F.col("pos_sigma_m")), 5).alias("p"))


def pixel_rays(spark: SparkSession, folder: str) -> DataFrame:
    """Obstacle feet seen by a camera 1.5 m up, tilted down by 0.2: their pixels, and the ground points of these."""
    c, n = math.cos(0.2), math.sin(0.2)
    pose = [0.0, -n, c, 0.0, -1.0, 0.0, 0.0, 0.0, 0.0, -c, -n, 1.5, 0.0, 0.0, 0.0, 1.0]
    back = [0.0, -1.0, 0.0, 0.0, -n, 0.0, -c, 1.5 * c, c, 0.0, -n, 1.5 * n, 0.0, 0.0, 0.0, 1.0]
    o = placed(spark, folder).filter("x > 0.5").select("obs_row", "x", "y", G.vec(*back).alias("back"), G.vec(*pose).alias("pose"))
    seen = o.withColumn("q", G.moved(F.col("back"), F.array("x", "y", F.lit(0.0)))).withColumn("p", G.projected(F.col("q"), 900.0, 900.0, 639.5, 359.5, (1280, 720))).filter("p IS NOT NULL")
    rays = seen.select("obs_row", "p", G.translation_of(F.col("pose")).alias("eye"), G.pixel_ray(F.col("pose"), F.expr("p[0]"), F.expr("p[1]"), 900.0, 900.0, 639.5, 359.5).alias("ray"))
    g = rays.select("obs_row", "p", G.on_ground(F.col("eye"), F.col("ray"), 50.0).alias("g"))
    return g.select("obs_row", F.round(F.expr("p[0]"), 4).alias("u"), F.round(F.expr("p[1]"), 4).alias("v"), F.round(F.expr("get(g, 0)"), 5).alias("gx"), F.round(F.expr("get(g, 1)"), 5).alias("gy"))


def motion_fan(spark: SparkSession, folder: str) -> DataFrame:
    """Poses along the fan of curvatures from each ego state, backwards where it reverses; one pose a curvature
    for a standing vehicle."""
    e = _ego(spark, folder, "speed_mps").select("pass_id", "t_ns", F.col("speed_mps").alias("v"))
    n = round(S.HORIZON_S / S.STEP_S)
    f = e.select("pass_id", "t_ns", "v", F.explode(F.array(*[F.lit(k) for k in S.CURVATURES])).alias("curvature"))
    f = f.select("*", F.explode(F.when(G.is_moving(F.col("v")), F.sequence(F.lit(0), F.lit(n))).otherwise(F.array(F.lit(0)))).alias("i"))
    x, y, a = G.curved(F.col("curvature"), F.col("v") * F.col("i") * S.STEP_S)
    return f.select("pass_id", "t_ns", "curvature", "i", F.round(x, 9).alias("x"), F.round(y, 9).alias("y"), F.round(a, 9).alias("heading"))


def path_curvatures(spark: SparkSession, folder: str) -> DataFrame:
    """Instants by the nearest curvature of the fan, per rig."""
    k = G.curvature_of(F.col("yaw_rate_radps"), F.col("speed_mps"))
    fan = F.array(*[F.struct(F.abs(k - F.lit(c)).alias("d"), F.lit(c).alias("c")) for c in S.CURVATURES])
    e = _ego(spark, folder).select("rig_id", F.array_min(fan)["c"].alias("curvature"), G.is_moving(F.col("speed_mps")).alias("moving"))
    return e.groupBy("rig_id", "curvature").agg(F.count("*").alias("n"), F.count_if("moving").alias("n_moving"))


def rotations_back(spark: SparkSession, folder: str) -> DataFrame:
    """Centres turned by yaw rate times one second about three axes and back through a quaternion: the error, and validity."""
    e = _ego(spark, folder).filter("abs(yaw_rate_radps) < 3")
    r = e.select("pass_id", G.rot("z", F.col("yaw_rate_radps")).alias("a"), G.rot("y", F.col("speed_mps") / 10).alias("b"), G.rot("x", F.col("yaw_rate_radps") / 2).alias("c"))
    r = r.withColumn("bc", G.product3(F.col("b"), F.col("c"))).withColumn("r", G.product3(F.col("a"), F.col("bc"))).withColumn("q", G.to_quaternion(F.col("r"))).withColumn("back", G.from_quaternion(F.col("q")))
    err = F.array_max(F.zip_with("back", "r", lambda x, y: F.abs(x - y)))
    q = r.select("pass_id", G.is_rotation(F.col("r")).alias("valid"), (err < 1e-9).alias("same"))
    return q.groupBy("pass_id").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.count_if("same").alias("n_same"))


QUERIES = {q.__name__: q for q in (kinds_split, height_maps, map_clusters, outside_counts, close_tracks, nearest_obstacles, range_errors, contact_chances, pixel_rays, motion_fan, path_curvatures, rotations_back)}

_OBS = """obs AS (SELECT * FROM (SELECT *, center_veh[1] AS x, center_veh[2] AS y, center_veh[3] AS z, row_number() OVER (PARTITION BY pass_id, id, t_ns ORDER BY obs_row) AS rn FROM obstacles WHERE t_ns IS NOT NULL AND len(center_veh) = 3
 AND isfinite(center_veh[1]) AND isfinite(center_veh[2]) AND isfinite(center_veh[3]) AND abs(center_veh[1]) < 1000 AND abs(center_veh[2]) < 1000 AND abs(center_veh[3]) < 1000) WHERE rn = 1)"""
_CELLS = f"cl AS (SELECT *, floor((x + {MAP_SIZE / 2}) / {MAP_CELL})::BIGINT AS ci, floor((y + {MAP_SIZE / 2}) / {MAP_CELL})::BIGINT AS cj FROM obs)"
_N = round(MAP_SIZE / MAP_CELL)
_MAP = f"""hm AS (SELECT pass_id, ci, cj, round(height, 6) AS height, last_seen FROM (SELECT *, row_number() OVER (PARTITION BY pass_id, ci, cj ORDER BY last_seen DESC) AS rk FROM (SELECT pass_id, ci, cj, t_ns AS last_seen, max(z) AS height FROM cl
 WHERE ci >= 0 AND ci < {_N} AND cj >= 0 AND cj < {_N} AND z BETWEEN {S.HEIGHT_BAND[0]} AND {S.HEIGHT_BAND[1]} GROUP BY 1, 2, 3, 4)) JOIN (SELECT pass_id, max(t_ns) AS fin FROM obs GROUP BY 1) USING (pass_id) WHERE rk = 1 AND fin - last_seen <= {int(S.PERSIST_S * 1e9)})"""
_BUCKET = "CASE " + " ".join(f"WHEN abs(d - {b}::DOUBLE) <= {S.DEPTH_TOLERANCE * b}::DOUBLE THEN {b}::DOUBLE" for b in S.DEPTH_BUCKETS) + " END"
_FAN = ", ".join(f"({k}::DOUBLE)" for k in S.CURVATURES)

ORACLES = {
    "kinds_split": f"WITH {_OBS} SELECT coalesce(kind, 'static_geom') AS kind, coalesce(kind IN ('person', 'cyclist', 'vehicle'), false) AS moves, count(*) AS n, count_if(sqrt(velocity_veh[1] ** 2 + velocity_veh[2] ** 2) >= 0.3) AS n_fast, count(DISTINCT (pass_id, id)) AS n_tracks FROM obs GROUP BY 1, 2",
    "height_maps": f"WITH {_OBS}, {_CELLS}, {_MAP} SELECT * FROM hm",
    "outside_counts": f"""WITH {_OBS}, g AS (SELECT source, z, (abs(floor((x + 6) / 0.05::DOUBLE) - 119.5) < 120 AND abs(floor((y + 6) / 0.05::DOUBLE) - 119.5) < 120) AS inside FROM obs)
 SELECT source, count_if(inside AND z BETWEEN -0.2 AND 2.5) AS n_in, count_if(z > 2.5) AS n_above, count_if(z < -0.2) AS n_below, count_if(NOT inside) AS n_outside FROM g GROUP BY 1""",
    "close_tracks": f"""WITH {_OBS}, tk AS (SELECT * FROM (SELECT *, t_ns // 100000000 AS tick, row_number() OVER (PARTITION BY pass_id, t_ns // 100000000, id ORDER BY obs_row) AS first FROM obs) WHERE first = 1)
 SELECT a.obs_row AS row_a, b.obs_row AS row_b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS distance FROM tk a JOIN tk b ON a.pass_id = b.pass_id AND a.tick = b.tick AND a.obs_row < b.obs_row WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) <= 4.0""",
    "nearest_obstacles": f"WITH {_OBS} SELECT pass_id, obs_row, kind, round(d, 6) AS distance, round(degrees(atan2(y, x)), 4) AS bearing_deg FROM (SELECT *, row_number() OVER (PARTITION BY pass_id ORDER BY d, obs_row) AS rk FROM (SELECT *, sqrt(x * x + y * y) AS d FROM obs)) WHERE rk = 1",
    "range_errors": f"WITH {_OBS} SELECT bucket, count(*) AS n, round(median(pos_sigma_m), 6) AS median_sigma, count_if(pos_sigma_m IS NULL) AS n_unstated FROM (SELECT *, {_BUCKET} AS bucket FROM (SELECT *, sqrt(x * x + y * y) AS d FROM obs)) WHERE bucket IS NOT NULL GROUP BY 1",
    "motion_fan": f"""WITH {_ego_sql("speed_mps")}, f AS (SELECT pass_id, t_ns, curvature, i, speed_mps * i * 0.1::DOUBLE AS s, curvature * (speed_mps * i * 0.1::DOUBLE) AS a FROM ego, (VALUES {_FAN}) c(curvature), (SELECT range::INT AS i FROM range(0, 31)) WHERE i = 0 OR abs(speed_mps) >= 0.1)
 SELECT pass_id, t_ns, curvature, i, round(CASE WHEN abs(a) < 1e-4 THEN s * (1 - a * a / 6) ELSE sin(a) / curvature END, 9) AS x, round(CASE WHEN abs(a) < 1e-4 THEN s * (a / 2 - a * a * a / 24) ELSE (1 - cos(a)) / curvature END, 9) AS y, round(a, 9) AS heading FROM f""",
    "path_curvatures": f"""WITH {_EGO}, k AS (SELECT rig_id, CASE WHEN abs(speed_mps) < 1e-6 THEN 0 ELSE yaw_rate_radps / speed_mps END AS k, abs(speed_mps) >= 0.1 AS moving FROM ego)
 SELECT rig_id, list_min(list_transform([{", ".join(f"{c}::DOUBLE" for c in S.CURVATURES)}], lambda c: {{'d': abs(k - c), 'c': c}})).c AS curvature, count(*) AS n, count_if(moving) AS n_moving FROM k GROUP BY 1, 2""",
    "rotations_back": f"WITH {_EGO} SELECT pass_id, count(*) AS n, count(*) AS n_valid, count(*) AS n_same FROM ego WHERE abs(yaw_rate_radps) < 3 GROUP BY 1",
    "contact_chances": f"""WITH {_OBS}, g AS (SELECT pass_id, obs_row, -(sqrt(x * x + y * y) - 1.0) / greatest(pos_sigma_m, 0.02::DOUBLE) AS q FROM obs WHERE pos_sigma_m IS NOT NULL), h AS (SELECT *, abs(q) / sqrt(2::DOUBLE) AS a, 1 / (1 + 0.3275911::DOUBLE * (abs(q) / sqrt(2::DOUBLE))) AS t FROM g),
 e AS (SELECT *, 1 - ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-a * a) AS erf FROM h), p AS (SELECT *, CASE WHEN q >= 0 THEN 0.5 * (1 + erf) ELSE 0.5 * (1 - erf) END AS p0 FROM e)
 SELECT pass_id, obs_row, round(CASE WHEN p0 < 0.001 THEN 0 ELSE p0 END, 5) AS p FROM p""",
    "pixel_rays": f"""WITH {_OBS}, c AS (SELECT obs_row, {math.cos(0.2)!r}::DOUBLE AS c, {math.sin(0.2)!r}::DOUBLE AS n, x, y FROM obs WHERE x > 0.5), q AS (SELECT *, c * x + 1.5 * n AS d, 900 * -y / (c * x + 1.5 * n) + 639.5 AS u, 900 * (1.5 * c - n * x) / (c * x + 1.5 * n) + 359.5 AS v FROM c),
 g AS (SELECT *, 1.5 / (c * (v - 359.5) / 900 + n) AS f FROM q WHERE d > 1e-6 AND u >= 0 AND u < 1280 AND v >= 0 AND v < 720), h AS (SELECT *, f * (c - n * (v - 359.5) / 900) AS gx, -f * (u - 639.5) / 900 AS gy, c * (v - 359.5) / 900 + n > 0 AS down FROM g)
 SELECT obs_row, round(u, 4) AS u, round(v, 4) AS v, CASE WHEN down AND sqrt(gx * gx + gy * gy) <= 50 THEN round(gx, 5) END AS gx, CASE WHEN down AND sqrt(gx * gx + gy * gy) <= 50 THEN round(gy, 5) END AS gy FROM h""",
    "map_clusters": f"""WITH RECURSIVE {_OBS}, {_CELLS}, {_MAP}, m AS (SELECT pass_id, ci, cj, height FROM hm WHERE height > {S.OBSTACLE_HEIGHT}), e AS (SELECT a.pass_id, a.ci, a.cj, b.ci AS di, b.cj AS dj FROM m a JOIN m b ON a.pass_id = b.pass_id AND abs(a.ci - b.ci) <= 1 AND abs(a.cj - b.cj) <= 1),
 w(pass_id, ci, cj, ri, rj) AS (SELECT pass_id, ci, cj, ci, cj FROM m UNION SELECT w.pass_id, w.ci, w.cj, e.di, e.dj FROM w JOIN e ON e.pass_id = w.pass_id AND e.ci = w.ri AND e.cj = w.rj), r AS (SELECT pass_id, ci, cj, min({{'i': ri, 'j': rj}}) AS root FROM w GROUP BY 1, 2, 3),
 g AS (SELECT pass_id, root.i || ':' || root.j AS cluster, min(ci) AS i0, max(ci) AS i1, min(cj) AS j0, max(cj) AS j1, max(height) AS top, count(*) AS n_cells FROM r JOIN m USING (pass_id, ci, cj) GROUP BY 1, 2)
 SELECT pass_id, cluster, round((i0 + i1 + 1) * {MAP_CELL} / 2::DOUBLE - {MAP_SIZE / 2}, 6) AS x, round((j0 + j1 + 1) * {MAP_CELL} / 2::DOUBLE - {MAP_SIZE / 2}, 6) AS y, round((i1 - i0 + 1) * {MAP_CELL}::DOUBLE, 6) AS size_x, round((j1 - j0 + 1) * {MAP_CELL}::DOUBLE, 6) AS size_y, round(top, 6) AS top, n_cells FROM g""",
}

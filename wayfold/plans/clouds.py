"""Queries that take obstacle centres as labelled points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators import clouds as C
from wayfold.operators import evaluation as E
from wayfold.operators.medians import exact_medians
from wayfold.plans.perception import _OBS, placed


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return placed(spark, folder).select("pass_id", "id", "t_ns", "obs_row", "kind", "x", "y", "z")


def track_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The planar motion between successive instants of each pass's tracks, fitted over the pass."""
    over = "OVER (PARTITION BY pass_id, id ORDER BY t_ns)"
    p = _points(spark, folder).select("pass_id", "x", "y", F.expr(f"lead(x) {over}").alias("u"), F.expr(f"lead(y) {over}").alias("v")).filter("u IS NOT NULL")
    return C.planar_fit(p, "pass_id").withColumns({c: F.round(c, 6) for c in ("yaw", "dx", "dy")})


def track_axes(spark: SparkSession, folder: str) -> DataFrame:
    a = C.long_axis(_points(spark, folder), "pass_id").filter("n >= 3")
    return a.withColumns({c: F.round(c, 11) for c in ("cx", "cy", "heading")})


def lane_widths(spark: SparkSession, folder: str) -> DataFrame:
    return C.slice_widths(_points(spark, folder), "pass_id", 0.5).withColumn("median_width", F.round("median_width", 6))


def occupied_volume(spark: SparkSession, folder: str) -> DataFrame:
    return C.voxel_volumes(_points(spark, folder), "pass_id", 0.25).withColumn("volume", F.round("volume", 6))


def track_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """The kind most rows of a track vote for, if at least 3 and half of them agree."""
    p = _points(spark, folder).select(F.concat_ws("/", "pass_id", F.col("id").cast("string")).alias("track"), "kind")
    return C.vote_labels(p, "track", "kind", 3, 0.5).withColumn("share", F.round("share", 6))


def relabelled_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points in small clusters of their kind, with the kind of what stands around them."""
    return C.clean_labels(_points(spark, folder), ["pass_id"], "obs_row", "kind", eps=0.5, least_cluster=4, radius=1.0, least_votes=3).filter("stray").select("obs_row", "kind", F.col("new_label").alias("new_kind"))


def voxel_faces(spark: SparkSession, folder: str) -> DataFrame:
    return C.exposed_faces(_points(spark, folder), "pass_id", 0.25).withColumn("area", F.round("area", 6))


def volume_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Volume of each pass's occupied voxels against that of the box around its points: the error, a gate, and the worst of its rig."""
    p = placed(spark, folder).select("rig_id", "pass_id", "x", "y", "z")
    box = p.groupBy("pass_id").agg(F.min("rig_id").alias("rig_id"), *[(F.max(c) - F.min(c)).alias(f"d{c}") for c in "xyz"])
    v = C.voxel_volumes(p, "pass_id", 2.0).join(box, "pass_id").withColumn("box", F.col("dx") * F.col("dy") * F.col("dz"))
    v = v.withColumn("error", F.try_divide(F.abs(F.col("volume") - F.col("box")), "box"))
    worst = F.expr("max(error) OVER (PARTITION BY rig_id)")
    return v.select("pass_id", "rig_id", "volume", F.round("box", 4).alias("box"), F.round("error", 6).alias("error"), F.coalesce(F.col("error") <= 0.15, F.lit(False)).alias("passed"), F.round(worst, 6).alias("worst_of_rig"))


def point_spacings(spark: SparkSession, folder: str) -> DataFrame:
    """The middle distance from a place to the nearest other of its pass."""
    s = C.nearest_spacing(_points(spark, folder), "pass_id", "obs_row").withColumn("c", F.lit(0))
    return exact_medians(s, ["pass_id"], "c", "spacing").select("pass_id", F.round("median", 6).alias("median_spacing"))


def vehicle_frames(spark: SparkSession, folder: str) -> DataFrame:
    p = _points(spark, folder).withColumn("hour", F.expr("t_ns div 3600000000000"))
    return C.vehicle_frames(p, "pass_id", "hour", overhang=0.9, slice_m=0.5, trim=0.5).withColumns({c: F.round(c, 6) for c in ("heading", "ox", "oy", "length", "width", "full_width", "height")})


def axle_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of obstacles as wheels of two axles: middles of their trimmed positions per axle, the gap within each, and between them."""
    m = E.trimmed_middles(placed(spark, folder).filter("kind IS NOT NULL").select("kind", "x"), "kind", "x", 2.0, 10)
    axle = F.when(F.col("kind").isin("person", "cyclist"), "front").when(F.col("kind").isin("vehicle", "static_geom"), "rear")
    a = m.select(axle.alias("axle"), "middle").filter("axle IS NOT NULL").groupBy("axle").agg(F.avg("middle").alias("x"), (F.max("middle") - F.min("middle")).alias("gap"), F.count("*").alias("n"))
    base = a.agg((F.max(F.when(F.col("axle") == "front", F.col("x"))) - F.max(F.when(F.col("axle") == "rear", F.col("x")))).alias("wheelbase"))
    return a.join(F.broadcast(base)).withColumns({c: F.round(c, 5) for c in ("x", "gap", "wheelbase")})


QUERIES = {q.__name__: q for q in (track_turns, track_axes, lane_widths, occupied_volume, track_kinds, relabelled_points, voxel_faces, volume_errors, point_spacings, vehicle_frames, axle_gaps)}

ORACLES = {
    "track_turns": f"""WITH {_OBS}, p AS (SELECT * FROM (SELECT pass_id, x, y, lead(x) OVER w AS u, lead(y) OVER w AS v FROM obs WINDOW w AS (PARTITION BY pass_id, id ORDER BY t_ns)) WHERE u IS NOT NULL), m AS (SELECT pass_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM p GROUP BY 1),
 s AS (SELECT pass_id, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) AS cr, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) AS dt FROM p JOIN m USING (pass_id) GROUP BY 1),
 f AS (SELECT *, CASE WHEN cr <> 0 OR dt <> 0 THEN atan2(cr, dt) END AS yaw FROM s) SELECT pass_id, n, round(yaw, 6) AS yaw, round(mu - (cos(yaw) * mx - sin(yaw) * my), 6) AS dx, round(mv - (sin(yaw) * mx + cos(yaw) * my), 6) AS dy FROM f""",
    "track_axes": f"WITH {_OBS} SELECT pass_id, count(*) AS n, round(avg(x), 11) AS cx, round(avg(y), 11) AS cy, round(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)), 11) AS heading FROM obs GROUP BY 1 HAVING count(*) >= 3",
    "lane_widths": f"WITH {_OBS} SELECT pass_id, count(*) AS n_slices, round(median(w), 6) AS median_width FROM (SELECT pass_id, floor((x - x0) / 0.5::DOUBLE) AS i, max(y) - min(y) AS w, count(*) AS n FROM obs JOIN (SELECT pass_id, min(x) AS x0 FROM obs GROUP BY 1) USING (pass_id) GROUP BY 1, 2) WHERE n >= 2 GROUP BY 1",
    "occupied_volume": f"WITH {_OBS} SELECT pass_id, count(*) AS n_voxels, round(count(*) * 0.015625::DOUBLE, 6) AS volume FROM (SELECT DISTINCT pass_id, floor(x / 0.25::DOUBLE), floor(y / 0.25::DOUBLE), floor(z / 0.25::DOUBLE) FROM obs) GROUP BY 1",
    "track_kinds": f"""WITH {_OBS}, n AS (SELECT pass_id || '/' || id AS track, kind, count(*) AS n FROM obs WHERE kind IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY track)::BIGINT AS n_votes, row_number() OVER (PARTITION BY track ORDER BY n DESC, kind) AS k FROM n)
 SELECT track, CASE WHEN n_votes >= 3 AND n / n_votes >= 0.5 THEN kind END AS kind, n_votes, round(n::DOUBLE / n_votes, 6) AS share FROM r WHERE k = 1""",
    "voxel_faces": f"""WITH {_OBS}, c AS (SELECT DISTINCT pass_id, floor(x / 0.25::DOUBLE)::BIGINT AS i, floor(y / 0.25::DOUBLE)::BIGINT AS j, floor(z / 0.25::DOUBLE)::BIGINT AS k FROM obs), f AS (SELECT pass_id, i + a AS i, j + b AS j, k + d AS k FROM c, (VALUES (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) s(a, b, d))
 SELECT pass_id, n_voxels, n_faces, round(n_faces * 0.0625::DOUBLE, 6) AS area FROM (SELECT pass_id, count(*) AS n_voxels FROM c GROUP BY 1) JOIN (SELECT pass_id, count(*) AS n_faces FROM f ANTI JOIN c USING (pass_id, i, j, k) GROUP BY 1) USING (pass_id)""",
    "volume_errors": f"""WITH {_OBS}, v AS (SELECT pass_id, count(*) * 8.0::DOUBLE AS volume FROM (SELECT DISTINCT pass_id, floor(x / 2), floor(y / 2), floor(z / 2) FROM obs) GROUP BY 1), b AS (SELECT pass_id, min(rig_id) AS rig_id, (max(x) - min(x)) * (max(y) - min(y)) * (max(z) - min(z)) AS box FROM obs GROUP BY 1),
 e AS (SELECT *, abs(volume - box) / nullif(box, 0) AS error FROM v JOIN b USING (pass_id)) SELECT pass_id, rig_id, volume, round(box, 4) AS box, round(error, 6) AS error, coalesce(error <= 0.15, false) AS passed, round(max(error) OVER (PARTITION BY rig_id), 6) AS worst_of_rig FROM e""",
    "point_spacings": f"""WITH {_OBS}, p AS (SELECT DISTINCT pass_id, x, y, z FROM obs), d AS (SELECT a.pass_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS s FROM p a JOIN p b ON a.pass_id = b.pass_id AND (a.x <> b.x OR a.y <> b.y OR a.z <> b.z) GROUP BY a.pass_id, a.x, a.y, a.z)
 SELECT pass_id, round(median(s), 6) AS median_spacing FROM d GROUP BY 1""",
    "vehicle_frames": f"""WITH {_OBS}, a AS (SELECT pass_id, avg(x) AS cx, avg(y) AS cy, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS h FROM obs GROUP BY 1), st AS (SELECT pass_id, z, (x - cx) * cos(h) + (y - cy) * sin(h) AS s, (y - cy) * cos(h) - (x - cx) * sin(h) AS t FROM obs JOIN a USING (pass_id)),
 e AS (SELECT pass_id, quantile_cont(s, 0.005) AS rear, quantile_cont(s, 0.995) AS front, quantile_cont(z, 0.995) AS height, min(t) AS t0, max(t) AS t1 FROM st GROUP BY 1),
 w AS (SELECT pass_id, median(w) AS width FROM (SELECT pass_id, floor((s - rear) / 0.5) AS i, max(t) - min(t) AS w, count(*) AS n FROM st JOIN e USING (pass_id) WHERE s >= rear AND s < rear + ceil((front - rear) / 0.5) * 0.5 GROUP BY 1, 2) WHERE n >= 2 GROUP BY 1)
 SELECT pass_id, round(h, 6) AS heading, round(cx + (rear + 0.9) * cos(h) - (t0 + t1) / 2 * sin(h), 6) AS ox, round(cy + (rear + 0.9) * sin(h) + (t0 + t1) / 2 * cos(h), 6) AS oy, round(front - rear, 6) AS length, round(width, 6) AS width, round(t1 - t0, 6) AS full_width, round(height, 6) AS height FROM a JOIN e USING (pass_id) JOIN w USING (pass_id)""",
    "axle_gaps": f"""WITH {_OBS}, m AS (SELECT CASE WHEN kind IN ('person', 'cyclist') THEN 'front' WHEN kind IN ('vehicle', 'static_geom') THEN 'rear' END AS axle, (quantile_cont(x, 0.02) + quantile_cont(x, 0.98)) / 2 AS middle FROM obs WHERE kind IS NOT NULL GROUP BY kind HAVING count(*) >= 10),
 a AS (SELECT axle, avg(middle) AS x, max(middle) - min(middle) AS gap, count(*) AS n FROM m WHERE axle IS NOT NULL GROUP BY 1) SELECT axle, round(x, 5) AS x, round(gap, 5) AS gap, n, round((SELECT max(x) FILTER (axle = 'front') - max(x) FILTER (axle = 'rear') FROM a), 5) AS wheelbase FROM a""",
}

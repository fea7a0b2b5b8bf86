"""Queries that take obstacles as detections of a camera, and their kinds as labels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import settings as S
from wayfold.operators import detections as D
from wayfold.plans.perception import _OBS, placed
from wayfold.plans.risk import _COMP, _FRAMES, distinct_frames
from wayfold.operators import risk as R
from wayfold.sources.tables import read_table

# The camera of the queries: 1.5 m up, tilted down by 0.2.
C, N, UP, FX, CX, CY, WIDTH, HEIGHT = math.cos(0.2), math.sin(0.2), 1.5, 900.0, 639.5, 359.5, 1280, 720
MOVING, LEAST_SCORE, IGNORED = ["person", "cyclist", "vehicle"], 0.5, ["Vehicle "]


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """The image box of each placed obstacle's near face, for those wholly in front of the camera: ``x0, y0, x1, y1``,
    its four corners, and a score by the stated deviation."""
    o = placed(spark, folder).filter("size(extent) = 3 AND forall(extent, v -> v > 0 AND v < 50)")
    o = o.select("pass_id", "id", "t_ns", "obs_row", "kind", "source", (1 - F.coalesce("pos_sigma_m", F.lit(0.6)) * 2).alias("score"), F.expr("x - extent[0] / 2").alias("nx"), *[F.expr(f"{c} {sign} extent[{i}] / 2").alias(f"{c}{n}") for i, c in ((1, "y"), (2, "z")) for n, sign in ((0, "-"), (1, "+"))])
    for n in (0, 1):
        depth = F.lit(C) * F.col("nx") - F.lit(N) * F.col(f"z{n}") + F.lit(N * UP)
        down = F.lit(C * UP) - F.lit(N) * F.col("nx") - F.lit(C) * F.col(f"z{n}")
        o = o.withColumns({f"d{n}": depth, f"v{n}": F.try_divide(F.lit(FX) * down, depth) + CY})
        o = o.withColumns({f"u{n}{m}": F.try_divide(-F.lit(FX) * F.col(f"y{m}"), F.col(f"d{n}")) + CX for m in (0, 1)})
    o = o.filter("d0 > 0.1 AND d1 > 0.1")
    us = ["u00", "u01", "u10", "u11"]
    return o.select("pass_id", "id", "t_ns", "obs_row", "kind", "source", "score", *us, "v0", "v1", F.least(*us).alias("x0"), F.least("v0", "v1").alias("y0"), F.greatest(*us).alias("x1"), F.greatest("v0", "v1").alias("y1"))


def _rounded_box(df: DataFrame) -> DataFrame:
    return df.select("obs_row", *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1", "score")])


def clipped_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes of moving kinds that score enough, cut to the image."""
    return _rounded_box(D.clipped(D.wanted(boxes(spark, folder), "kind", "score", MOVING, LEAST_SCORE), WIDTH, HEIGHT))


def grounded_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Boxes that aren't of a whole vehicle, cut to the last pixel of the image; they come as arrays per pass and source."""
    held = boxes(spark, folder).groupBy("pass_id", "source", "id").agg(F.sort_array(F.collect_list(F.struct("obs_row", "kind", "score", "x0", "y0", "x1", "y1"))).alias("h"))
    arrays = held.select("pass_id", *[F.col(f"h.{c}").alias(f"a_{c}") for c in ("obs_row", "kind", "score", "x0", "y0", "x1", "y1")])
    each = D.hits(arrays, ["pass_id"], {f"a_{c}": c for c in ("obs_row", "kind", "score", "x0", "y0", "x1", "y1")})
    return _rounded_box(D.clipped(D.without_labels(each, "kind", IGNORED), WIDTH - 1, HEIGHT - 1))


def _frames(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "video_frames").filter("t_ns IS NOT NULL AND t_ns <> 0").select("pass_id", "t_ns").distinct()


def key_frames(spark: SparkSession, folder: str) -> DataFrame:
    return D.keyframes(_frames(spark, folder), "pass_id", "t_ns", 30)


def strided_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Every fifth frame of each pass, at most 40 of them."""
    return D.strided(_frames(spark, folder), "pass_id", "t_ns", 5, 40)


def drawn_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Eight frames of each pass, drawn by hash."""
    return D.drawn_frames(_frames(spark, folder), "pass_id", "t_ns", 8, 7)


def best_detections(spark: SparkSession, folder: str) -> DataFrame:
    """The best box of each kind in each second of a pass that scores enough."""
    b = boxes(spark, folder).filter(F.col("kind").isNotNull() & (F.col("score") >= LEAST_SCORE)).withColumn("second", F.expr("t_ns div 1000000000"))
    return D.best_per(b, ["pass_id", "second", "kind"], "score", "obs_row", ["source"]).withColumn("score", F.round("score", 6))


def merged_passes(spark: SparkSession, folder: str) -> DataFrame:
    """The better of the detector's and the map's best of each second: the detector's where they score the same."""
    b = boxes(spark, folder).withColumn("second", F.expr("t_ns div 1000000000")).withColumn("turn", F.when(F.col("source") == "detector", 0).otherwise(1))
    parts = D.best_per(b, ["pass_id", "second", "turn"], "score", "obs_row", ["kind"])
    return D.best_per(parts, ["pass_id", "second"], "score", "turn", ["obs_row", "kind"]).withColumn("score", F.round("score", 6)).drop("turn")


def composed_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The kind of each half-metre cell of a pass by its most certain obstacle; none where no score is positive."""
    o = placed(spark, folder).select("pass_id", F.floor(F.col("x") / 0.5).alias("ci"), F.floor(F.col("y") / 0.5).alias("cj"), "kind", (1 - F.coalesce("pos_sigma_m", F.lit(0.6)) * 2).alias("logit"))
    return D.composed(o, ["pass_id", "ci", "cj"], "kind", "logit").withColumn("logit", F.round("logit", 6))


def label_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Per component of the vehicle's list: rows, frames and passes that name it; those never named have 0."""
    names = spark.createDataFrame([(n,) for n in sorted(S.SEVERITY)], "component string")
    c = R.exploded(distinct_frames(spark, folder)).groupBy("component").agg(F.count("*").alias("n_rows"), F.count_distinct("pass_id", "t_ns").alias("n_frames"), F.count_distinct("pass_id").alias("n_passes"))
    zero = F.lit(0).cast("bigint")
    return names.join(c, "component", "left").select("component", F.replace("component", F.lit("_"), F.lit(" ")).alias("shown"), *[F.coalesce(x, zero).alias(x) for x in ("n_rows", "n_frames", "n_passes")], F.col("n_rows").isNull().alias("never"))


def unknown_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Components that frames name and the severity table lacks, and worst components no frame of the pass lists."""
    known = spark.createDataFrame([(n,) for n in S.SEVERITY], "component string")
    c = R.exploded(distinct_frames(spark, folder)).select("pass_id", "component").filter("component IS NOT NULL").distinct()
    odd = c.join(known, "component", "left_anti").groupBy("component").agg(F.count("*").alias("n_passes")).withColumn("why", F.lit("no severity"))
    w = distinct_frames(spark, folder).select("pass_id", F.col("worst_component").alias("component")).filter("component IS NOT NULL").distinct()
    lost = w.join(c, ["pass_id", "component"], "left_anti").groupBy("component").agg(F.count("*").alias("n_passes")).withColumn("why", F.lit("not listed"))
    return odd.unionByName(lost)


def quad_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind: faces whose quad in the image is large and square enough, and those rejected."""
    b = boxes(spark, folder)
    side, angle = D.quad_quality([(F.col(f"u{n}{m}"), F.col(f"v{n}")) for n, m in ((0, 0), (0, 1), (1, 1), (1, 0))])
    q = b.select("kind", side.alias("side"), angle.alias("angle"))
    good = F.coalesce((F.col("side") >= 25) & (F.col("angle") >= 60), F.lit(False))
    return q.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(~good).alias("n_rejected"), F.round(F.max("side"), 4).alias("largest_side"), F.round(F.min("angle"), 4).alias("least_angle"))


def mark_views(spark: SparkSession, folder: str) -> DataFrame:
    """Tracks of a pass as marks seen in its seconds."""
    v = placed(spark, folder).select("pass_id", F.expr("t_ns div 200000000").alias("image"), "id")
    return D.mark_tracks(v, "pass_id", "image", "id", least_views=10)


def seen_fractions(spark: SparkSession, folder: str) -> DataFrame:
    """Share of a pass's seconds with a frame in which any obstacle was seen."""
    images = _frames(spark, folder).select("pass_id", F.expr("t_ns div 1000000000").alias("image")).distinct()
    v = placed(spark, folder).select("pass_id", F.expr("t_ns div 1000000000").alias("image"))
    return D.seen_fractions(images, v, "pass_id", "image", fallback_below=0.8).withColumn("fraction", F.round("fraction", 6))


QUERIES = {q.__name__: q for q in (clipped_boxes, grounded_boxes, key_frames, strided_frames, drawn_frames, best_detections, merged_passes, composed_cells, label_frames, unknown_labels, quad_checks, mark_views, seen_fractions)}


def _box_sql() -> str:
    parts = ["SELECT *, 1 - coalesce(pos_sigma_m, 0.6::DOUBLE) * 2 AS score, x - extent[1] / 2 AS nx, y - extent[2] / 2 AS y0, y + extent[2] / 2 AS y1, z - extent[3] / 2 AS z0, z + extent[3] / 2 AS z1 FROM obs WHERE len(extent) = 3 AND extent[1] > 0 AND extent[1] < 50 AND extent[2] > 0 AND extent[2] < 50 AND extent[3] > 0 AND extent[3] < 50"]
    parts.append("SELECT *, " + ", ".join(f"{C!r}::DOUBLE * nx - {N!r}::DOUBLE * z{n} + {N * UP!r}::DOUBLE AS d{n}, {C * UP!r}::DOUBLE - {N!r}::DOUBLE * nx - {C!r}::DOUBLE * z{n} AS w{n}" for n in (0, 1)) + f" FROM ({parts[0]})")
    parts.append("SELECT pass_id, id, t_ns, obs_row, kind, source, score, " + ", ".join(f"{FX} * w{n} / d{n} + {CY} AS v{n}" for n in (0, 1)) + ", " + ", ".join(f"-{FX} * y{m} / d{n} + {CX} AS u{n}{m}" for n in (0, 1) for m in (0, 1)) + f" FROM ({parts[1]}) WHERE d0 > 0.1 AND d1 > 0.1")
    return f"bx AS (SELECT *, least(u00, u01, u10, u11) AS x0, least(v0, v1) AS y0, greatest(u00, u01, u10, u11) AS x1, greatest(v0, v1) AS y1 FROM ({parts[2]}))"


def _clip_sql(width: float, height: float, where: str) -> str:
    cut = ", ".join(f"greatest(0::DOUBLE, least({m}::DOUBLE, {c})) AS {c}" for c, m in (("x0", width), ("x1", width), ("y0", height), ("y1", height)))
    return f"SELECT obs_row, {', '.join(f'round({c}, 4) AS {c}' for c in ('x0', 'y0', 'x1', 'y1', 'score'))} FROM (SELECT obs_row, score, {cut} FROM bx WHERE {where}) WHERE x1 > x0 AND y1 > y0"


_BX = f"{_OBS}, {_box_sql()}"
_FR = "fr AS (SELECT pass_id, t_ns, row_number() OVER (PARTITION BY pass_id ORDER BY t_ns) - 1 AS place, count(*) OVER (PARTITION BY pass_id) AS n FROM (SELECT DISTINCT pass_id, t_ns FROM video_frames WHERE t_ns IS NOT NULL AND t_ns <> 0))"
_KNOWN = ", ".join(f"('{c}')" for c in S.SEVERITY)


def _quad_sql() -> str:
    c = [("u00", "v0"), ("u01", "v0"), ("u11", "v1"), ("u10", "v1")]
    side = [f"sqrt(({c[(i + 1) % 4][0]} - {c[i][0]}) ** 2 + ({c[(i + 1) % 4][1]} - {c[i][1]}) ** 2)" for i in range(4)]
    angle = [f"degrees(acos(greatest(-1, least(1, (({c[i - 1][0]} - {c[i][0]}) * ({c[(i + 1) % 4][0]} - {c[i][0]}) + ({c[i - 1][1]} - {c[i][1]}) * ({c[(i + 1) % 4][1]} - {c[i][1]})) / nullif({side[i - 1]} * {side[i]}, 0)))))" for i in range(4)]
    return f"SELECT kind, ({' + '.join(side)}) / 4 AS side, least({', '.join(angle)}) AS angle FROM bx"


ORACLES = {
    "clipped_boxes": f"WITH {_BX} {_clip_sql(WIDTH, HEIGHT, 'kind IN (' + ', '.join(repr(k) for k in MOVING) + f') AND score >= {LEAST_SCORE}')}",
    "grounded_boxes": f"WITH {_BX} {_clip_sql(WIDTH - 1, HEIGHT - 1, 'kind IS NULL OR kind <> ' + chr(39) + 'vehicle' + chr(39))}",
    "key_frames": f"WITH {_FR} SELECT pass_id, t_ns, place FROM fr WHERE place % 30 = 0 OR place = n - 1",
    "strided_frames": f"WITH {_FR} SELECT pass_id, t_ns, place FROM fr WHERE place % 5 = 0 AND place < 200",
    "drawn_frames": f"WITH {_FR} SELECT pass_id, t_ns FROM (SELECT pass_id, t_ns, row_number() OVER (PARTITION BY pass_id ORDER BY md5('7|' || pass_id || '|' || t_ns), t_ns) AS k FROM fr) WHERE k <= 8",
    "best_detections": f"WITH {_BX} SELECT pass_id, second, kind, round(score, 6) AS score, obs_row, source FROM (SELECT *, row_number() OVER (PARTITION BY pass_id, second, kind ORDER BY score DESC, obs_row) AS k FROM (SELECT *, t_ns // 1000000000 AS second FROM bx WHERE kind IS NOT NULL AND score >= {LEAST_SCORE})) WHERE k = 1",
    "merged_passes": f"WITH {_BX} SELECT pass_id, second, round(score, 6) AS score, obs_row, kind FROM (SELECT *, row_number() OVER (PARTITION BY pass_id, second ORDER BY score DESC, CASE WHEN source = 'detector' THEN 0 ELSE 1 END, obs_row) AS k FROM (SELECT *, t_ns // 1000000000 AS second FROM bx)) WHERE k = 1",
    "composed_cells": f"""WITH {_OBS} SELECT pass_id, ci, cj, CASE WHEN logit > 0 THEN kind END AS kind, round(logit, 6) AS logit FROM (SELECT *, row_number() OVER (PARTITION BY pass_id, ci, cj ORDER BY logit DESC, kind) AS k
 FROM (SELECT pass_id, floor(x / 0.5)::BIGINT AS ci, floor(y / 0.5)::BIGINT AS cj, kind, 1 - coalesce(pos_sigma_m, 0.6::DOUBLE) * 2 AS logit FROM obs WHERE kind IS NOT NULL)) WHERE k = 1""",
    "label_frames": f"""WITH {_FRAMES}, {_COMP}, c AS (SELECT component, count(*) AS n_rows, count(DISTINCT (pass_id, t_ns)) AS n_frames, count(DISTINCT pass_id) AS n_passes FROM comp GROUP BY 1)
 SELECT component, replace(component, '_', ' ') AS shown, coalesce(n_rows, 0) AS n_rows, coalesce(n_frames, 0) AS n_frames, coalesce(n_passes, 0) AS n_passes, n_rows IS NULL AS never FROM (VALUES {_KNOWN}) k(component) LEFT JOIN c USING (component)""",
    "unknown_labels": f"""WITH {_FRAMES}, {_COMP}, c AS (SELECT DISTINCT pass_id, component FROM comp WHERE component IS NOT NULL), w AS (SELECT DISTINCT pass_id, worst_component AS component FROM frames WHERE worst_component IS NOT NULL)
 SELECT component, count(*) AS n_passes, 'no severity' AS why FROM c WHERE component NOT IN (SELECT * FROM (VALUES {_KNOWN}) k(component)) GROUP BY 1 UNION ALL SELECT component, count(*), 'not listed' FROM w ANTI JOIN c USING (pass_id, component) GROUP BY 1""",
    "quad_checks": f"WITH {_BX}, q AS ({_quad_sql()}) SELECT kind, count(*) AS n, count_if(NOT coalesce(side >= 25 AND angle >= 60, false)) AS n_rejected, round(max(side), 4) AS largest_side, round(min(angle), 4) AS least_angle FROM q GROUP BY 1",
    "mark_views": f"WITH {_OBS} SELECT pass_id, id, count(*) AS n_views, min(image) AS first_image, max(image) AS last_image, count(*) >= 10 AS usable FROM (SELECT pass_id, id, t_ns // 200000000 AS image, count(*) AS n FROM obs GROUP BY 1, 2, 3) WHERE n = 1 GROUP BY 1, 2",
    "seen_fractions": f"""WITH {_OBS}, {_FR}, i AS (SELECT DISTINCT pass_id, t_ns // 1000000000 AS image FROM fr), v AS (SELECT DISTINCT pass_id, t_ns // 1000000000 AS image FROM obs), n AS (SELECT i.pass_id, count(*) AS n_images, count(v.image) AS n_with FROM i LEFT JOIN v ON i.pass_id = v.pass_id AND i.image = v.image GROUP BY 1)
 SELECT pass_id, n_images, n_with, round(n_with / n_images, 6) AS fraction, n_with / n_images < 0.8 AS fallback FROM n""",
}

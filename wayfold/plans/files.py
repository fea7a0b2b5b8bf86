"""Queries that write a table in a format of the recording tool chain, into the shared folder, and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.plans.perception import _OBS, placed
from wayfold.sources import formats as X
from wayfold.sources.checkpoints import shared_path
from wayfold.sources.tables import read_table


def jsonl_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frames through JSON lines, as written and then appended to."""
    f = read_table(spark, folder, "video_frames").select("frame_row", "pass_id", "frame_index", "t_ns", "file")
    path = shared_path(spark, "jsonl")
    X.write_jsonl(f.filter("frame_row % 2 = 0"), path)
    X.append_jsonl(f.filter("frame_row % 2 = 1"), path)
    return X.read_jsonl(spark, path, "frame_row bigint, pass_id string, frame_index bigint, t_ns bigint, file string")


def frame_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """An index of one file and frame per instant, read back in order."""
    f = read_table(spark, folder, "video_frames").filter("t_ns IS NOT NULL AND t_ns <> 0").groupBy("t_ns").agg(F.min(F.struct("frame_row", "frame_index", "pass_id")).alias("m"))
    path = shared_path(spark, "index")
    X.write_jsonl(f.select(F.concat_ws("/", "m.pass_id", F.format_string("%06d.png", "m.frame_index")).alias("file"), "t_ns", F.col("m.frame_index").alias("frame_index")), path)
    return X.read_frames_index(spark, path)


def probed_frames(spark: SparkSession, folder: str) -> DataFrame:
    """Frame times read from probe documents, one per pass, made of its frames: every other has a best estimate, unset ones none."""
    f = read_table(spark, folder, "video_frames").withColumn("s", F.format_string("%d.%09d", F.expr("t_ns div 1000000000 - 1514764800"), F.expr("t_ns % 1000000000")))
    s = F.when((F.col("t_ns") != 0), F.col("s"))
    doc = F.struct(F.when(F.col("frame_row") % 2 == 0, s).alias("best_effort_timestamp_time"), F.coalesce(s, F.lit("N/A")).alias("pts_time"))
    docs = f.groupBy("pass_id", "frame_index").agg(F.min(F.struct("frame_row", doc.alias("d"))).alias("m")).groupBy("pass_id", F.expr("frame_index div 500").alias("part")).agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("frame_index", "m.d"))), lambda x: x["d"]).alias("frames"))).alias("payload"))
    return X.probe_frames(docs, "payload").groupBy("pass_id").agg(F.count("*").alias("n"), F.min(F.expr("t_ns div 1000")).alias("first_us"), F.max(F.expr("t_ns div 1000")).alias("last_us"))


def gold_points(spark: SparkSession, folder: str) -> DataFrame:
    """Placed obstacles as lines of labelled points, read back and counted by cell of 5 m and label."""
    path = shared_path(spark, "gold")
    X.write_gold_points(placed(spark, folder).select("x", "y", "z", F.expr("CASE WHEN kind = 'person' THEN 1 WHEN kind = 'vehicle' THEN 2 ELSE -1 END").alias("label")), path)
    p = X.read_gold_points(spark, path)
    return p.groupBy("label", F.floor(F.col("x") / 5).alias("cx")).agg(F.count("*").alias("n"), F.round(F.max("z"), 6).alias("top"))


def sfm_models(spark: SparkSession, folder: str) -> DataFrame:
    """A model made of rigs as cameras, seconds of passes as images and tracks as points, written as text and read back: per camera
    its intrinsics, images, points seen, and the error weighted by the tracks."""
    o = placed(spark, folder).withColumn("image", F.expr("xxhash64(pass_id, t_ns div 1000000000)")).withColumn("image_id", F.expr("cast(pmod(image, 2000000000) AS int)"))
    ids = o.select("rig_id").distinct().withColumn("camera_id", F.expr("cast(pmod(xxhash64(rig_id), 1000000) AS int)"))
    cameras = ids.select("camera_id", F.lit("SIMPLE_RADIAL").alias("model"), F.lit(1280).alias("width"), F.lit(720).alias("height"), F.array(F.lit(900.0), F.lit(639.5), F.lit(359.5), F.lit(-0.01)).alias("params"))
    point = F.expr("cast(pmod(xxhash64(pass_id, id), 4000000000) AS bigint)")
    images = o.join(ids, "rig_id").groupBy("image_id", "camera_id").agg(F.concat_ws("_", F.lit("im"), F.min("obs_row").cast("string")).alias("name"), F.sort_array(F.collect_set(F.struct(F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), point.alias("point3D_id")))).alias("observations"))
    images = images.select("image_id", F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 0.0)]).alias("qvec"), F.array(*[F.lit(x) for x in (0.5, 0.0, -1.0)]).alias("tvec"), "camera_id", "name", "observations")
    points = o.groupBy(point.alias("point3D_id")).agg(F.min_by(F.array("x", "y", "z"), "obs_row").alias("xyz"), F.round(F.avg(F.coalesce("pos_sigma_m", F.lit(0.5))), 6).alias("error"), F.sort_array(F.collect_set(F.struct("image_id", F.lit(0).alias("idx")))).alias("track"))
    path = shared_path(spark, "sfm")
    X.write_sfm_model(cameras, images, points.withColumn("rgb", F.array(*[F.lit(128)] * 3)), path)
    c, i, p = X.read_sfm_model(spark, path)
    k = X.camera_parameters(F.col("model"), F.col("params"))
    seen = i.select("camera_id", "image_id", F.explode_outer("observations").alias("s")).groupBy("camera_id").agg(F.count_distinct("image_id").alias("n_images"), F.count("s").alias("n_seen"), F.count_distinct("s.point3D_id").alias("n_points"))
    error = F.broadcast(X.reprojection_error(p).select(F.round("error_px", 6).alias("error_px")))
    return c.select("camera_id", *[k[n].alias(n) for n in ("fx", "fy", "cx", "k1", "k2")]).join(seen, "camera_id").join(error).drop("camera_id")


def manifest_updates(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest after its verified rows are written over the first row of each id; rows that would move to another split are held back."""
    r = read_table(spark, folder, "raw_records").select("rec_no", "id", F.lower(F.trim("split")).alias("split"), "verified")
    table = r.groupBy("id").agg(F.min_by(F.struct("rec_no", "split"), "rec_no").alias("m")).select("id", "m.*")
    rows = r.filter("verified").groupBy("id").agg(F.max_by(F.struct("rec_no", "split"), "rec_no").alias("m")).select("id", "m.*")
    held = X.moved_splits(table, rows, "id", "split").select("id")
    return X.upsert(table, rows.join(held, "id", "left_anti"), "id")


def record_uses(spark: SparkSession, folder: str) -> DataFrame:
    """Uses allowed to the records of each kind, by licences taken from kind and backups."""
    name = F.when(F.col("kind") == "lot", "CC-BY-4.0").when(F.col("kind") == "scan", "CC-BY-NC-4.0").otherwise("own")
    status = F.when(F.col("verified"), "clear").otherwise("unverified")
    r = read_table(spark, folder, "raw_records").select("kind", X.license_class(name, status).alias("licence"), F.when(F.size("backups") > 1, "documented").otherwise("undocumented").alias("provenance"))
    uses = r.withColumn("uses", X.allowed_uses(F.col("licence"), F.col("provenance")))
    train = uses.select("*", F.when(F.array_contains("uses", "train"), X.required_use(F.col("licence"), F.col("provenance"), "train", F.col("kind"))).alias("trains"))
    return train.groupBy("kind", "licence", "provenance", F.array_join(F.array_sort("uses"), ",").alias("uses")).agg(F.count("*").alias("n"), F.count("trains").alias("n_train"))


def metric_log(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of four tables appended to a metric log and read back, through a document of their sum."""
    path, sums = shared_path(spark, "metrics"), {}
    for table in ("ego_states", "obstacles", "risk_frames", "raw_records"):
        sums[table] = float(read_table(spark, folder, table).count())
        X.append_metric(spark, path, "counts", table, sums[table])
    doc = shared_path(spark, "document")
    X.write_json(X.load_metrics(spark, path).agg(F.sum("value").alias("total"), F.count("*").alias("n")), doc)
    total = X.read_json(spark, doc, "total double, n bigint")
    return X.load_metrics(spark, path).select("metric", "value").join(F.broadcast(total.select("total")))


QUERIES = {q.__name__: q for q in (jsonl_frames, frame_indexes, probed_frames, gold_points, sfm_models, manifest_updates, record_uses, metric_log)}

ORACLES = {
    "jsonl_frames": "SELECT frame_row, pass_id, frame_index, t_ns, file FROM video_frames",
    "frame_indexes": "SELECT pass_id || '/' || lpad(frame_index::VARCHAR, 6, '0') || '.png' AS file, t_ns, frame_index FROM (SELECT *, row_number() OVER (PARTITION BY t_ns ORDER BY frame_row) AS k FROM video_frames WHERE t_ns IS NOT NULL AND t_ns <> 0) WHERE k = 1",
    "probed_frames": "SELECT pass_id, count(*) AS n, min((t_ns - 1514764800000000000) // 1000) AS first_us, max((t_ns - 1514764800000000000) // 1000) AS last_us FROM (SELECT *, row_number() OVER (PARTITION BY pass_id, frame_index ORDER BY frame_row) AS k FROM video_frames) WHERE k = 1 AND t_ns IS NOT NULL AND t_ns <> 0 GROUP BY 1",
    "gold_points": f"WITH {_OBS} SELECT CASE WHEN kind = 'person' THEN 1 WHEN kind = 'vehicle' THEN 2 ELSE -1 END AS label, floor(x / 5)::BIGINT AS cx, count(*) AS n, round(max(z), 6) AS top FROM obs GROUP BY 1, 2",
    "sfm_models": f"""WITH {_OBS}, o AS (SELECT *, t_ns // 1000000000 AS sec FROM obs), im AS (SELECT DISTINCT rig_id, pass_id, sec, id, round(x, 3) AS x, round(y, 3) AS y FROM o), c AS (SELECT rig_id, count(DISTINCT (pass_id, sec)) AS n_images, count(*) AS n_seen, count(DISTINCT (pass_id, id)) AS n_points FROM im GROUP BY 1),
 p AS (SELECT round(avg(coalesce(pos_sigma_m, 0.5)), 6) AS e, count(DISTINCT sec) AS w FROM o GROUP BY pass_id, id) SELECT 900::DOUBLE AS fx, 900::DOUBLE AS fy, 639.5::DOUBLE AS cx, -0.01::DOUBLE AS k1, 0::DOUBLE AS k2, n_images, n_seen, n_points, (SELECT round(sum(e * w) / sum(w), 6) FROM p) AS error_px FROM c""",
    "manifest_updates": """WITH r AS (SELECT rec_no, id, lower(trim(split)) AS split, verified FROM raw_records), t AS (SELECT id, rec_no, split FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_no) AS k FROM r) WHERE k = 1),
 n AS (SELECT id, rec_no, split FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_no DESC) AS k FROM r WHERE verified) WHERE k = 1), g AS (SELECT n.* FROM n LEFT JOIN t USING (id) WHERE NOT coalesce(n.split <> t.split, false))
 SELECT id, rec_no, split FROM g UNION ALL SELECT id, rec_no, split FROM t WHERE id NOT IN (SELECT id FROM g WHERE id IS NOT NULL)""",
    "metric_log": " UNION ALL ".join(f"SELECT '{t}' AS metric, (SELECT count(*) FROM {t})::DOUBLE AS value, ((SELECT count(*) FROM ego_states) + (SELECT count(*) FROM obstacles) + (SELECT count(*) FROM risk_frames) + (SELECT count(*) FROM raw_records))::DOUBLE AS total" for t in ("ego_states", "obstacles", "risk_frames", "raw_records")),
    "record_uses": """WITH l AS (SELECT kind, CASE WHEN verified THEN CASE kind WHEN 'lot' THEN 'permissive' WHEN 'scan' THEN 'noncommercial' ELSE 'unverified' END ELSE 'unverified' END AS licence, CASE WHEN len(backups) > 1 THEN 'documented' ELSE 'undocumented' END AS provenance FROM raw_records)
 SELECT kind, licence, provenance, CASE licence WHEN 'permissive' THEN CASE provenance WHEN 'documented' THEN 'private_eval,publish_media,publish_results,rehearsal,train' ELSE 'private_eval,publish_results,rehearsal,train' END WHEN 'noncommercial' THEN 'private_eval,publish_results,rehearsal' ELSE '' END AS uses, count(*) AS n, count_if(licence = 'permissive') AS n_train FROM l GROUP BY ALL""",
}

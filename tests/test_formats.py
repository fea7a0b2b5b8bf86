"""Readers and writers on small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from wayfold.sources import formats as X

SCHEMA = "a bigint, b string, c struct<d: array<double>>"


def test_jsonl_round_trip_and_faults(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", ([1.5, None],)), (None, None, None)], SCHEMA)
    X.write_jsonl(df, str(tmp_path / "j"))
    X.append_jsonl(df.limit(1), str(tmp_path / "j"))
    assert sorted(map(str, X.read_jsonl(spark, str(tmp_path / "j"), SCHEMA).collect())) == sorted(map(str, df.collect() + df.limit(1).collect()))
    for bad in ("{nope", '{"a": 1, "z": 2}'):
        (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n' + bad + "\n")
        with pytest.raises(Exception, match="not a record|unknown field"):
            X.read_jsonl(spark, str(tmp_path / "bad.jsonl"), SCHEMA).collect()


def test_metrics(spark, tmp_path):
    path = str(tmp_path / "m")
    assert X.load_metrics(spark, path).count() == 0
    X.append_metric(spark, path, "T1", "error", 0.5)
    X.append_metric(spark, path, "T1", "error", 0.25, "dev")
    got = X.load_metrics(spark, path).orderBy("value").collect()
    assert [r["value"] for r in got] == [0.25, 0.5] and got[0]["ts"].endswith("Z")


def test_digests(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert X.file_digests(spark, str(tmp_path)).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_probe(spark):
    doc = {"frames": [{"best_effort_timestamp_time": "0.5", "pts_time": "9"}, {"pts_time": "1.25"}, {"best_effort_timestamp_time": "N/A"}, {}]}
    df = spark.createDataFrame([("v", json.dumps(doc))], "file string, payload string")
    assert [r["t_ns"] for r in X.probe_frames(df, "payload").orderBy("frame").collect()] == [500000000, 1250000000]


@pytest.mark.parametrize("scale, unit", [(1.0, "s"), (1e3, "ms"), (1e9, "ns")])
def test_imu_wide_and_units(spark, tmp_path, scale, unit):
    lines = ["Time,Gyro X (rad),GyroY,gyroz".replace(" X (rad)", "X")] + [f"{i * 0.005 * scale},{i},1,2" for i in range(400)] + ["oops,1,2,3"]
    (tmp_path / "imu.csv").write_text("\n".join(lines))
    got = X.read_imu(spark, str(tmp_path / "imu.csv"))
    assert got.count() == 400 and got.agg(F.max("t_ns")).first()[0] == pytest.approx(399 * 5_000_000, abs=2)


def test_imu_long(spark, tmp_path):
    lines = ["sensor,seconds_elapsed,x,y,z"] + [f"{s},{i * 0.01},{i},0,0" for i in range(100) for s in ("Gyroscope", "Accel")]
    (tmp_path / "imu.csv").write_text("\n".join(lines))
    assert X.read_imu(spark, str(tmp_path / "imu.csv")).count() == 100
    (tmp_path / "no.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        X.read_imu(spark, str(tmp_path / "no.csv"))


def test_points_and_ply(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# x y z label\n1 2 3 4\n\n1.5 2 3 77 88 -1\n")
    assert [tuple(r) for r in X.read_gold_points(spark, str(tmp_path / "g.txt")).collect()] == [(1.0, 2.0, 3.0, 4), (1.5, 2.0, 3.0, -1)]
    (tmp_path / "b.txt").write_text("1 2 3 0.5\n")
    with pytest.raises(Exception, match="not a labelled point"):
        X.read_gold_points(spark, str(tmp_path / "b.txt")).collect()
    (tmp_path / "p.ply").write_bytes(b"ply\nformat ascii 1.0\nelement vertex 42\nend_header\n\xff\xfe")
    assert X.ply_vertex_counts(spark, str(tmp_path / "p.ply")).first()["n_vertices"] == 42


def test_sfm_text(spark, tmp_path):
    (tmp_path / "cameras.txt").write_text("# c\n1 PINHOLE 1280 720 900 900 639.5 359.5\n")
    (tmp_path / "images.txt").write_text("# i\n1 1 0 0 0 0 0 1 1 a.png\n10 20 5 30 40 -1\n2 1 0 0 0 0 0 2 1 b.png\n\n")
    (tmp_path / "points.txt").write_text("5 1 2 3 255 0 0 0.5 1 0 2 3\n6 1 2 3 0 0 0 2.0\n")
    assert X.read_sfm_cameras(spark, str(tmp_path / "cameras.txt")).first()["params"] == [900.0, 900.0, 639.5, 359.5]
    images = X.read_sfm_images(spark, str(tmp_path / "images.txt")).orderBy("image_id").collect()
    assert [(r["name"], len(r["observations"])) for r in images] == [("a.png", 2), ("b.png", 0)]
    points = X.read_sfm_points(spark, str(tmp_path / "points.txt"))
    assert X.reprojection_error(points).first()["error_px"] == pytest.approx((0.5 * 2 + 2.0) / 3)


def test_manifest_and_licences(spark):
    old, new = spark.createDataFrame([("a", "dev", 1), ("b", "test", 2)], "id string, split string, v int"), spark.createDataFrame([("b", "dev", 3), ("c", "dev", 4)], "id string, split string, v int")
    assert sorted(map(tuple, X.upsert(old, new, "id").collect())) == [("a", "dev", 1), ("b", "dev", 3), ("c", "dev", 4)]
    assert [tuple(r) for r in X.moved_splits(old, new, "id", "split").collect()] == [("b", "test", "dev")]
    rows = [("MIT", "clear", "documented"), ("MIT", "clear", "undocumented"), ("odd", "clear", "documented"), ("MIT", "conflicting", "documented")]
    df = spark.createDataFrame(rows, "l string, s string, p string").withColumn("k", X.license_class(F.col("l"), F.col("s")))
    got = [(r["k"], len(r["u"])) for r in df.select("k", X.allowed_uses(F.col("k"), F.col("p")).alias("u")).collect()]
    assert got == [("permissive", 5), ("permissive", 4), ("unverified", 0), ("conflicting", 2)]

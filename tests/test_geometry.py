"""Detections, planes, odometry, clouds and files on small fixtures with known answers."""

import math
import random
import struct
from statistics import median

import pytest
from pyspark.sql import functions as F

from wayfold.functions import frames as G
from wayfold.operators import clouds, detections, odometry, planes
from wayfold.operators.medians import exact_quantiles
from wayfold.sources import formats


def test_boxes_are_cut_and_dropped(spark):
    rows = [(1, -5.0, 2.0, 10.0, 8.0, "car", 0.9), (2, 50.0, 0.0, 60.0, 5.0, " Car ", 0.8), (3, 3.0, 3.0, 3.0, 9.0, "dog", 0.9), (4, None, 0.0, 1.0, 1.0, None, None)]
    df = spark.createDataFrame(rows, "n int, x0 double, y0 double, x1 double, y1 double, label string, score double")
    assert [tuple(r)[:5] for r in detections.clipped(df, 20, 6).collect()] == [(1, 0.0, 2.0, 10.0, 6.0)]
    assert {r["n"] for r in detections.without_labels(df, "label", ["CAR"]).collect()} == {3, 4}
    assert {r["n"] for r in detections.wanted(df, "label", "score", ["car", "dog"], 0.9).collect()} == {1, 3}
    assert detections.clipped(df.limit(0), 20, 6).count() == 0


def test_hits_need_equal_numbers(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], ["a", "b"]), (2, [], ["x"]), (3, None, None)], "n int, boxes array<double>, labels array<string>")
    assert sorted(tuple(r) for r in detections.hits(df, ["n"], {"boxes": "b", "labels": "l"}).collect()) == [(1, 1.0, "a"), (1, 2.0, "b")]
    bad = spark.createDataFrame([(1, [1.0], [])], "n int, boxes array<double>, labels array<string>")
    with pytest.raises(Exception, match="differ in number"):
        detections.hits(bad, ["n"], {"boxes": "b", "labels": "l"}).collect()


def test_frames_are_chosen(spark):
    df = spark.createDataFrame([("p", t) for t in range(10)] + [("q", 5)], "k string, t int")
    assert {(r["k"], r["t"]) for r in detections.keyframes(df, "k", "t", 4).collect()} == {("p", 0), ("p", 4), ("p", 8), ("p", 9), ("q", 5)}
    assert {r["t"] for r in detections.strided(df, "k", "t", 3, 2).filter("k = 'p'").collect()} == {0, 3}
    assert detections.drawn_frames(df, "k", "t", 3, 1).count() == 4
    with pytest.raises(ValueError):
        detections.keyframes(df, "k", "t", 0)


def test_best_and_composed(spark):
    rows = [(1, "b", 0.5, 2), (1, "a", 0.5, 1), (1, "c", None, 0), (2, "a", -1.0, 3)]
    df = spark.createDataFrame(rows, "px int, label string, logit double, ord int")
    assert detections.best_per(df, ["px"], "logit", "ord", ["label"]).filter("px = 1").first()["label"] == "a"
    assert {r["px"]: r["label"] for r in detections.composed(df, ["px"], "label", "logit").collect()} == {1: "a", 2: None}


def test_marks_and_fractions(spark):
    v = spark.createDataFrame([("s", 1, 7), ("s", 2, 7), ("s", 2, 8), ("s", 3, 8), ("s", 3, 8)], "s string, image int, mark int")
    got = {r["mark"]: (r["n_views"], r["usable"]) for r in detections.mark_tracks(v, "s", "image", "mark").collect()}
    assert got == {7: (2, True), 8: (1, False)}
    images = spark.createDataFrame([("s", i) for i in range(1, 5)] + [("e", 1)], "s string, image int")
    f = {r["s"]: (r["fraction"], r["fallback"]) for r in detections.seen_fractions(images, v, "s", "image", fallback_below=0.5).collect()}
    assert f == {"s": (0.75, False), "e": (0.0, True)}


def test_quads(spark):
    side, angle = detections.quad_quality([(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    r = spark.range(1).select(side.alias("s"), angle.alias("a")).first()
    assert r["s"] == 4 and r["a"] == pytest.approx(90)


def test_planes(spark):
    rng = random.Random(1)
    n = [0.1, -0.2, 1.0]
    size = math.sqrt(sum(x * x for x in n))
    rows = []
    for i in range(300):
        x, y = rng.uniform(-5, 5), rng.uniform(-5, 5)
        z = (1.5 - n[0] * x - n[1] * y) / n[2]
        rows.append(("a", i, x, y, z if i % 5 else z + rng.uniform(1, 4)))
    rows += [("b", 900, 0.0, 0.0, 0.0), ("b", 901, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, row int, x double, y double, z double")
    fit = planes.fitted_planes(df.filter("row % 5 <> 0 AND k = 'a'"), "k").first()
    assert [fit["nx"], fit["ny"], fit["nz"], fit["d"]] == pytest.approx([x / size for x in n] + [-1.5 / size], abs=1e-6) and fit["spread"] < 1e-9
    assert planes.fitted_planes(df.filter("k = 'b'"), "k").first()["nx"] is None
    best = planes.sampled_planes(df, "k", "row", threshold=0.05, tries=16, seed=1, most_tilt_deg=40.0).collect()
    assert len(best) == 1 and best[0]["n_inliers"] == 240 and best[0]["nz"] == pytest.approx(n[2] / size, abs=1e-6)


def test_motions_against_wrong_pairs(spark):
    rng, yaw = random.Random(2), 0.3
    rows = []
    for i in range(100):
        x, y = rng.uniform(-5, 5), rng.uniform(-5, 5)
        u, v = math.cos(yaw) * x - math.sin(yaw) * y + 1, math.sin(yaw) * x + math.cos(yaw) * y - 2
        rows.append(("a", i, x, y, u + (9 if i % 4 == 0 else 0), v))
    df = spark.createDataFrame(rows, "k string, row int, x double, y double, u double, v double")
    r = planes.sampled_motions(df, "k", "row", threshold=0.1, tries=12, seed=1, least=10).first()
    assert (r["n"], r["n_inliers"]) == (100, 75) and [r["yaw"], r["dx"], r["dy"]] == pytest.approx([0.3, 1, -2], abs=1e-9)


def test_pose_motions_and_drift(spark):
    poses = [("p", i * 10**9, 2.0 * math.sin(0.1 * i) / 0.1, 2.0 * (1 - math.cos(0.1 * i)) / 0.1, 0.1 * i) for i in range(4)] + [("one", 5, 1.0, 1.0, 0.0)]
    got = odometry.pose_motions(spark.createDataFrame(poses, "k string, t bigint, x double, y double, yaw double"), "k", "t").collect()
    for r in got:
        want = (0, 0) if r["k"] == "one" else (2 * math.sin(0.1) / 0.1, 0.1)
        assert (r["speed_mps"], r["yaw_rate_radps"]) == pytest.approx(want)
    ends = spark.createDataFrame([(0.0, 0.0, 0.0, 10.0, 1.0, 0.1, 5.0, 5.0, math.pi / 2, 5.0, 15.0, math.pi / 2)], ", ".join(f"{p}{c}{i} double" for p in "et" for i in (0, 1) for c in "xya"))
    d = odometry.drift(ends).first()
    assert (d["displacement_m"], d["endpoint_error_m"], d["drift_frac"], d["heading_error_deg"]) == pytest.approx((10, 1, 0.1, math.degrees(0.1)))


def test_integrals_between_instants(spark):
    s = spark.createDataFrame([("p", 10**9, 1.0), ("p", 3 * 10**9, 3.0)], "k string, t bigint, r double")
    g = spark.createDataFrame([("p", 0), ("p", 2 * 10**9), ("p", 3 * 10**9), ("p", 5 * 10**9), ("none", 7)], "k string, t bigint")
    got = {(r["k"], r["t"] // 10**9): r for r in odometry.running_integral(s, g, "k", "t", "r").collect()}
    assert [got["p", t]["integral"] for t in (0, 2, 3, 5)] == pytest.approx([-1.0, 1.5, 4.0, 10.0])
    assert [(got["p", t]["below"], got["p", t]["upto"]) for t in (0, 2, 3, 5)] == [(0, 0), (1, 1), (1, 2), (2, 2)]
    assert got["none", 0]["integral"] is None


def test_depth_of_boxes(spark):
    c, n = math.cos(0.2), math.sin(0.2)
    eye = G.vec(0.0, 0.0, 1.5)
    down = G.vec(c - n * 0.5, 0.0, -n - c * 0.5)
    level = G.vec(1.0, 0.0, 0.0)
    r = spark.range(1).select(G.ground_sigma(eye, level, down).alias("s"), G.height_over(eye, level, F.lit(4.0), F.lit(0.0)).alias("h"), F.array(*G.pushed(eye, F.lit(3.0), F.lit(4.0), F.lit(5.0))).alias("p"), G.planned_sigma(F.lit(2.0)).alias("w")).first()
    assert r["s"] == math.inf and r["h"] == 1.5 and r["p"] == pytest.approx([6.0, 8.0]) and r["w"] == pytest.approx(0.11)


def test_joints(spark):
    df = spark.createDataFrame([(math.pi / 2,), (2.5,)], "q double").withColumn("swing", G.joint_motion("revolute", G.vec(0.0, 0.0, 3.0), F.col("q"), -2.0, 2.0)).withColumn("slide", G.joint_motion("prismatic", G.vec(0.0, 2.0, 0.0), F.col("q"), 0.0, 2.0)).withColumn("fixed", G.joint_motion("fixed", G.vec(0.0, 0.0, 1.0), F.col("q"), 0, 0))
    a, b = df.select("q", *[G.moved(F.col(c), G.vec(1.0, 2.0, 3.0)).alias(c) for c in ("swing", "slide", "fixed")], F.col("swing").isNull().alias("out")).orderBy("q").collect()
    assert a["swing"] == pytest.approx([-2, 1, 3]) and a["slide"] == pytest.approx([1, 2 + math.pi / 2, 3]) and a["fixed"] == [1, 2, 3]
    assert b["out"] and not a["out"]
    with pytest.raises(ValueError):
        G.joint_motion("ball", G.vec(0.0, 0.0, 1.0), F.col("q"), 0, 0)


def test_spacing_looks_as_far_as_it_must(spark):
    rng = random.Random(3)
    pts = [("a", i, rng.uniform(0, 3), rng.uniform(0, 3), 0.0) for i in range(60)] + [("a", 100, 200.0, 0.0, 0.0), ("a", 101, 0.0, 0.0, 0.0), ("b", 200, 1.0, 1.0, 1.0), ("b", 201, 1.0, 1.0, 1.0)]
    got = {r["row"]: r["spacing"] for r in clouds.nearest_spacing(spark.createDataFrame(pts, "k string, row int, x double, y double, z double"), "k", "row").collect()}
    for k, row, *p in pts[:62]:
        assert got[row] == pytest.approx(min(math.dist(p, q) for j, r, *q in pts if j == k and r != row))
    assert 200 not in got


def test_faces(spark):
    df = spark.createDataFrame([("a", 0.1, 0.1, 0.1), ("a", 1.1, 0.1, 0.1), ("a", 0.2, 0.2, 0.2)], "k string, x double, y double, z double")
    r = clouds.exposed_faces(df, "k", 1.0).first()
    assert (r["n_voxels"], r["n_faces"], r["area"]) == (2, 10, 10.0)


def test_quantiles_are_exact_also_when_a_bracket_misses(spark):
    rng = random.Random(4)
    rows = [(None, i % 3, rng.gauss(0, 1)) for i in range(4001)] + [("b", 0, float(i)) for i in range(5)] + [("c", 0, None)]
    df = spark.createDataFrame(rows, "k string, h int, v double")
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "h", "v", {"low": 0.1, "mid": 0.5, "top": 1.0}, k=8).collect()}
    vals = sorted(v for k, _, v in rows if k is None)
    assert got[None]["mid"] == median(vals) and got[None]["low"] == pytest.approx(vals[400]) and got[None]["top"] == vals[-1]
    assert (got["b"]["low"], got["b"]["mid"], got["b"]["top"]) == pytest.approx((0.4, 2.0, 4.0)) and "c" not in got


def test_rasters(spark):
    given = struct.pack("<6f", 1.5, -2.0, 0.0, math.inf, 1e-40, 3.25)
    values, good = struct.unpack("<6f", given), b"3&2&1&" + given
    df = spark.createDataFrame([("a", bytearray(good)), ("short", bytearray(good[:-1])), ("none", None)], "name string, raw binary")
    got = {(r["name"], r["row"], r["col"]): r["value"] for r in formats.pixels_of_raster(df, "raw", ["name"]).collect()}
    assert [got["a", i // 3, i % 3] for i in range(6)] == list(values) and got["short", None, None] is None


def test_sfm_model_there_and_back(spark, tmp_path):
    cameras = spark.createDataFrame([(1, "OPENCV", 10, 20, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0])], "camera_id int, model string, width int, height int, params array<double>")
    images = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], [0.5, 0.0, 1.0], 1, "a.png", [(1.5, 2.5, 7)]), (2, [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.0], 1, "b.png", [])], "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, observations array<struct<x: double, y: double, point3D_id: bigint>>")
    points = spark.createDataFrame([(7, [0.0, 1.0, 2.0], [1, 2, 3], 0.5, [(1, 0), (2, 3)]), (8, [1.0, 1.0, 1.0], [0, 0, 0], 0.25, [])], "point3D_id bigint, xyz array<double>, rgb array<int>, error double, track array<struct<image_id: int, idx: int>>")
    formats.write_sfm_model(cameras, images, points, str(tmp_path / "m"))
    c, i, p = formats.read_sfm_model(spark, str(tmp_path / "m"))
    k = formats.camera_parameters(F.col("model"), F.col("params"))
    assert tuple(c.select(k["fx"].alias("a"), k["p2"].alias("b")).first()) == (1.0, 8.0)
    assert {r["name"]: len(r["observations"]) for r in i.collect()} == {"a.png": 1, "b.png": 0}
    assert {r["point3D_id"]: r["error"] for r in p.collect()} == {7: 0.5, 8: 0.25}


def test_documents_and_indexes(spark, tmp_path):
    one = spark.createDataFrame([(2, "x")], "b int, a string")
    formats.write_json(one, str(tmp_path / "d"))
    assert tuple(formats.read_json(spark, str(tmp_path / "d"), "a string, b int").first()) == ("x", 2)
    with pytest.raises(Exception, match="one row"):
        formats.write_json(one.unionAll(one), str(tmp_path / "e"))
    formats.write_jsonl(spark.createDataFrame([("f2", 9, 2), ("f1", 5, 1)], "file string, t_ns bigint, frame_index bigint"), str(tmp_path / "i"))
    assert [r["file"] for r in formats.read_frames_index(spark, str(tmp_path / "i")).collect()] == ["f1", "f2"]
    formats.append_jsonl(spark.createDataFrame([("f3", 9, 3)], "file string, t_ns bigint, frame_index bigint"), str(tmp_path / "i"))
    with pytest.raises(Exception, match="two frames"):
        formats.read_frames_index(spark, str(tmp_path / "i")).collect()


def test_uses_are_required(spark):
    df = spark.createDataFrame([("d", "permissive"), ("e", "none")], "name string, kind string")
    use = formats.required_use(F.col("kind"), F.lit("documented"), "train", F.col("name"))
    assert df.filter("name = 'd'").select(use.alias("x")).first()["x"] == "d"
    with pytest.raises(Exception, match="not allowed"):
        df.select(use.alias("x")).collect()
    with pytest.raises(ValueError):
        formats.required_use(F.col("kind"), F.lit(""), "sell", F.col("name"))


def test_enclosing_boxes(spark):
    rng = random.Random(7)
    a = 0.4
    turned = [(math.cos(a) * x - math.sin(a) * y + 3, math.sin(a) * x + math.cos(a) * y) for x, y in [(0, 0), (4, 0), (4, 2), (0, 2)] + [(rng.uniform(0, 4), rng.uniform(0, 2)) for _ in range(200)]]
    rows = [("r", i, *p) for i, p in enumerate(turned)] + [("line", 900, 0.0, 0.0), ("line", 901, 3.0, 4.0), ("dot", 902, 1.0, 1.0), ("dot", 903, 1.0, 1.0), (None, 904, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, row int, x double, y double")
    for parts in (1, 16):
        got = {r["k"]: r for r in clouds.enclosing_boxes(df, "k", "row", parts=parts).collect()}
        assert set(got) == {"r", "line", "dot"} and got["r"]["n_corners"] == 4
        centre = (math.cos(a) * 2 - math.sin(a) * 1 + 3, math.sin(a) * 2 + math.cos(a) * 1)
        assert (got["r"]["area"], got["r"]["x"], got["r"]["y"]) == pytest.approx((8.0, *centre))
        assert got["line"]["area"] == pytest.approx(0) and max(got["line"]["along"], got["line"]["across"]) == pytest.approx(5) and got["dot"]["area"] == 0

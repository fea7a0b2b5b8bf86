"""Operators whose state runs along a pass, against plain loops and known answers."""

import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfold.functions import frames as G
from wayfold.operators import evaluation as E
from wayfold.operators import occupancy, sweep, tracking
from wayfold.operators.levels import level_rank
from wayfold.operators.risk import graded
from wayfold.streaming import alerts

FRAMES = "pass_id string, t_ns bigint, raw int, release int"


def test_ladder_known_answers():
    s, tick = alerts.Ladder(), 100_000_000
    raw = [0, 3, 0, 2, 3, 3] + [0] * 12
    got = [s.step(i * tick, r, r) for i, r in enumerate(raw)]
    assert got[:6] == [0, 0, 0, 0, 2, 2] and got[6:11] == [2] * 5 and got[11] == 0
    with pytest.raises(ValueError):
        s.step(0, 0, 0)


def made_frames():
    rng = random.Random(4)
    rows = []
    for key in ("a", "b", "c"):
        t = 0
        for _ in range(80):
            t += rng.choice([50, 100, 200]) * 1_000_000
            raw = rng.choice([0, 0, 1, 2, 3])
            rows.append((key, t, raw, min(3, raw + rng.choice([0, 0, 1]))))
    return rows


def test_batch_holds_levels_as_a_loop(spark):
    rows = made_frames()
    df = spark.createDataFrame(rows, FRAMES)
    got = {(r["pass_id"], r["t_ns"]): r["level"] for r in alerts.held_levels(df).collect()}
    for _, part in itertools.groupby(rows, key=lambda r: r[0]):
        s = alerts.Ladder()
        for key, t, raw, release in part:
            assert got[key, t] == s.step(t, raw, release)
    assert alerts.held_levels(df.limit(0)).count() == 0


def test_stream_holds_the_same_levels(spark, tmp_path):
    rows = sorted(made_frames(), key=lambda r: r[1])
    want = {(r["pass_id"], r["t_ns"]): r["level"] for r in alerts.held_levels(spark.createDataFrame(rows, FRAMES)).collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for i in range(3):
        pd.DataFrame(rows[i * 80 : (i + 1) * 80], columns=["pass_id", "t_ns", "raw", "release"]).to_json(tmp_path / f"part{i}.json", orient="records", lines=True)
        time.sleep(0.02)
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = alerts.stream_levels(stream).writeStream.format("memory").queryName("held").outputMode("append").option("checkpointLocation", str(tmp_path / "_cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["pass_id"], r["t_ns"]): r["level"] for r in spark.table("held").collect()}
    assert got == want


def test_stream_orders_a_batch_and_tells_late_frames(spark, tmp_path):
    rows = sorted(made_frames(), key=lambda r: r[1])
    want = {(r["pass_id"], r["t_ns"]): r["level"] for r in alerts.held_levels(spark.createDataFrame(rows, FRAMES)).collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    for i, part in enumerate((mixed, [rows[3], ("a", 1, 0, 0)])):
        pd.DataFrame(part, columns=["pass_id", "t_ns", "raw", "release"]).to_json(tmp_path / f"part{i}.json", orient="records", lines=True)
        time.sleep(0.02)
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    q = alerts.stream_levels(stream).writeStream.format("memory").queryName("mixed").outputMode("append").option("checkpointLocation", str(tmp_path / "_cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    out = spark.table("mixed").collect()
    assert {(r["pass_id"], r["t_ns"]): r["level"] for r in out if not r["late"]} == want
    assert sorted((r["pass_id"], r["t_ns"], r["level"]) for r in out if r["late"]) == sorted([(rows[3][0], rows[3][1], None), ("a", 1, None)])


def test_assignment_is_least(spark):
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 2), (4, 4)):
        cost = rng.random((n, m))
        pairs = tracking.assign(cost)
        best = min(sum(cost[i, j] for i, j in zip(rows, cols)) for k in [min(n, m)] for rows in itertools.permutations(range(n), k) for cols in itertools.combinations(range(m), k))
        assert len(pairs) == min(n, m) and sum(cost[i, j] for i, j in pairs) == pytest.approx(best)
    assert tracking.assign(np.zeros((0, 0))) == []


def test_a_walker_is_one_track(spark):
    rows = [("p", i * 100_000_000, 3.0, 2.0 - 0.12 * i, 0.9, "person") for i in range(40)] + [("q", 0, None, 1.0, 0.9, None)]
    df = spark.createDataFrame(rows, "pass_id string, t_ns bigint, x double, y double, score double, kind string")
    got = tracking.track(df).orderBy("t_ns").collect()
    assert {r["track"] for r in got} == {0} and len(got) == 38
    assert got[-1]["vy"] == pytest.approx(-1.2, abs=0.15) and got[-1]["vx"] == pytest.approx(0, abs=0.15)


def pair(spark, component, box, speed, curvature=0.0, t_max=3.0):
    c = [x for x in sweep.COMPONENTS if x[0] == component][0]
    row = ("p", 0, component, 1, *c[1:3], *c[4:6], *box, speed, curvature, t_max)
    names = "pass_id string, t_ns bigint, component string, obstacle_id bigint, xmin double, ymin double, xmax double, ymax double, ox0 double, oy0 double, ox1 double, oy1 double, speed double, curvature double, t_max double"
    return sweep.clearances(spark.createDataFrame([row], names)).first()


def test_sweep_known_answers(spark):
    pole = (-1.53, -1.03, -1.47, -0.97)
    back = pair(spark, "rear_right_bumper_corner", pole, -1.0)
    assert back["ttc_s"] == pytest.approx(0.37, abs=0.006) and back["min_distance_m"] == 0
    still = pair(spark, "rear_right_bumper_corner", pole, 0.0, t_max=0.0)
    assert still["ttc_s"] is None and still["min_distance_m"] == pytest.approx(0.37, abs=1e-6)
    away = pair(spark, "rear_right_bumper_corner", pole, 1.0)
    assert away["ttc_s"] is None and away["t_closest_s"] == 0


def test_levels_and_grades(spark):
    texts = ["None", " CAUT.", "warn", "crit ", "2", "c", "", None, "Warning.", "\tCritical", "foe", "12"]
    df = spark.createDataFrame([(x,) for x in texts], "v string")
    assert [r[0] for r in df.select(level_rank("v")).collect()] == [0, 1, 2, 3, 2, None, None, None, 2, 3, None, None]
    rows = [(1.5, None, None), (0.99, None, None), (0.49, None, None), (0.24, None, None), (0.0, 2.9, None), (0.0, 1.9, None), (0.0, 0.9, None), (0.2, None, 2.5), (0.2, None, 1.5), (0.2, None, 0.5), (0.2, None, 3.5)]
    df = spark.createDataFrame(rows, "d double, t double, c double")
    assert [r[0] for r in df.select(graded(F.col("d"), F.col("t"), F.col("c"))).collect()] == [0, 1, 2, 3, 1, 2, 3, 1, 2, 3, 0]


def test_episodes_and_false_alarms(spark):
    s = 10**9
    rows = [("p", t * s, 2 if t in (10, 11, 30) else 0) for t in range(0, 61)]
    df = spark.createDataFrame(rows, "pass_id string, t_ns bigint, rank int")
    found = E.episodes(df, "pass_id", "t_ns", F.col("rank") >= 2)
    assert sorted((r["start_ns"], r["end_ns"]) for r in found.collect()) == [(10 * s, 11 * s), (30 * s, 30 * s)]
    for events, want in (([("p", int(12.5 * s))], 1.0), ([], 2.0)):
        ev = spark.createDataFrame(events, "pass_id string, t_event_ns bigint")
        assert E.false_alarm_rate(df, found, ev, "pass_id", "t_ns").first()["per_min"] == want


def test_iou(spark):
    df = spark.createDataFrame(list(zip("001110", "00011x")), "p string, t string")
    assert {r["class"]: round(r["iou"], 6) for r in E.iou_per_class(df, "p", "t", ["0", "1", "7"]).collect()} == {"0": 0.5, "1": round(2 / 3, 6)}


def test_clusters_and_radius(spark):
    cells = [("p", 0, 0), ("p", 1, 1), ("p", 2, 0), ("p", 5, 5), ("q", 1, 0)]
    df = spark.createDataFrame(cells, "k string, ci int, cj int")
    got = {(r["k"], r["ci"], r["cj"]): r["cluster"] for r in occupancy.cell_clusters(df, "k").collect()}
    assert got["p", 2, 0] == got["p", 1, 1] == "0:0" and got["p", 5, 5] == "5:5" and got["q", 1, 0] == "1:0"
    rng = random.Random(1)
    pts = [(i, *[rng.uniform(-2, 2) for _ in range(3)]) for i in range(150)] + [(999, None, 0.0, 0.0)]
    a = spark.createDataFrame(pts, "i int, x double, y double, z double").withColumn("k", F.lit(1))
    pairs = {(r["i"], r["j"]) for r in occupancy.within_radius(a, a.withColumnRenamed("i", "j"), ["k"], ["x", "y", "z"], 0.7, "i", "j").collect()}
    assert pairs == {(p[0], q[0]) for p in pts[:-1] for q in pts[:-1] if sum((x - y) ** 2 for x, y in zip(p[1:], q[1:])) <= 0.49}


def test_frames_round_trip(spark):
    df = spark.createDataFrame([(0.3, -1.2, 2.0)], "a double, b double, c double").select(G.rot("z", F.col("a")).alias("r"), F.array("a", "b", "c").alias("v"))
    t = df.select("v", "r", G.transform_of(F.col("r"), F.col("v")).alias("t")).withColumn("back", G.inverted(F.col("t")))
    row = t.select(G.moved(F.col("back"), F.col("v")).alias("p"), G.is_rotation(F.col("r")).alias("ok"), G.angle_of(F.col("r")).alias("angle"), G.yaw_of(F.col("t")).alias("yaw")).first()
    assert row["p"] == pytest.approx([0, 0, 0], abs=1e-12) and row["ok"] and row["angle"] == pytest.approx(0.3) and row["yaw"] == pytest.approx(0.3)
    x = spark.range(1).select(G.normal_cdf(F.lit(1.0)).alias("a"), G.normal_cdf(F.lit(-1.0)).alias("b")).first()
    assert x["a"] == pytest.approx(0.841344746, abs=1e-6) and x["b"] == pytest.approx(0.158655254, abs=1e-6)

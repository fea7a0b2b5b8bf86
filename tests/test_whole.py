"""Queries and operators keep every row of the job: known answers on small tables, written as files."""

import pytest

from wayfold.plans import registry

Q = registry.QUERIES
TICK = 100_000_000
COMPONENT = "struct<component string, min_distance_m double, ttc_s double, t_closest_s double, p_contact double, severity double, risk double, obstacle_id bigint>"
RISK = f"risk_row bigint, pass_id string, rig_id string, t_ns bigint, ego_speed_mps double, per_component array<{COMPONENT}>, p_any_contact double, expected_damage double, worst_component string, alert_level string"
OBSTACLE = "obs_row bigint, pass_id string, rig_id string, t_ns bigint, id bigint, kind string, center_veh array<double>, extent array<double>, velocity_veh array<double>, pos_sigma_m double, source string"


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_frames_without_components_are_graded(spark, tmp_path):
    """Contact, nothing, contact, ...: the quiet frames end each streak, so no level is ever raised."""
    near = [("rear_bumper", 0.0, 0.5, 0.5, 1.0, 1.2, 1.2, 1)]
    rows = [(i, "p", "r", (i + 1) * TICK, 1.0, [] if i % 2 else near, 0.0, 0.0, None, "none") for i in range(8)]
    save(spark, tmp_path, "risk_frames", rows, RISK)
    save(spark, tmp_path, "obstacles", [(0, "p", "r", TICK, 1, "static_geom", [0.0] * 3, [1.0] * 3, None, None, "detector")], OBSTACLE)
    got = {r["t_ns"]: r.asDict() for r in Q["risk_frames_summary"](spark, str(tmp_path)).collect()}
    assert len(got) == 8
    assert got[2 * TICK] == {"pass_id": "p", "t_ns": 2 * TICK, "p_any": 0.0, "damage": 0.0, "worst": None, "first_ttc": None, "level": 0, "release": 0, "n": 0}
    assert got[TICK]["level"] == 3 and got[TICK]["n"] == 1 and got[TICK]["damage"] == pytest.approx(1.2 * 0.5)
    held = [r["level"] for r in Q["held_alerts"](spark, str(tmp_path)).orderBy("t_ns").collect()]
    assert held == [0] * 8
    assert [tuple(r) for r in Q["alert_flicker"](spark, str(tmp_path)).collect()] == [("p", 7, 0, 8)]
    for name in ("risk_probability_levels", "risk_level_agreement"):
        assert {r["level"]: r["n_frames"] for r in Q[name](spark, str(tmp_path)).collect()} == {0: 4, 3: 4}
    assert sorted(r["box_risk"] for r in Q["risk_baseline"](spark, str(tmp_path)).collect()) == [0.0] * 4 + [0.5] * 4


EGO = "ego_row bigint, pass_id string, rig_id string, t_ns bigint, speed_mps double, yaw_rate_radps double"


def test_obstacles_meet_ego_states_across_cells(spark, tmp_path):
    """An obstacle on either side of a border of 100 ms, several states in one cell, and one too far off."""
    ego = [(0, "p", "r", 1_090_000_000, 1.0, 0.0), (1, "p", "r", 1_310_000_000, -1.0, 0.0), (2, "p", "r", 1_390_000_000, -2.0, 0.0), (3, "p", "r", 3_000_000_000, -1.0, 0.0)]
    at = [1_110_000_000, 1_350_000_000, 1_360_000_000, 2_939_999_999]  # 20 ms over a border; a tie; nearer the later; 1 ns beyond 60 ms
    save(spark, tmp_path, "ego_states", ego, EGO)
    save(spark, tmp_path, "obstacles", [(i, "p", "r", t, i, "static_geom", [-2.0, 0.0, 0.5], [0.4] * 3, None, None, "detector") for i, t in enumerate(at)], OBSTACLE)
    got = {r["t_ns"]: r for r in Q["swept_frames"](spark, str(tmp_path)).filter("component = 'rear_bumper'").collect()}
    assert sorted(got) == at[:3]
    assert got[at[0]]["ttc_s"] is None and got[at[0]]["min_distance_m"] == pytest.approx(0.7)
    assert got[at[1]]["ttc_s"] == pytest.approx(0.7, abs=0.006) and got[at[2]]["ttc_s"] == pytest.approx(0.35, abs=0.006)


def test_fan_of_every_state(spark, tmp_path):
    """Forward, backward, standing; a speed without a yaw rate has its fan too."""
    ego = [(0, "p", "r", TICK, 1.0, 0.0), (1, "p", "r", 2 * TICK, -2.0, None), (2, "p", "r", 3 * TICK, 0.05, 0.0), (3, "p", "r", 4 * TICK, None, 0.0)]
    save(spark, tmp_path, "ego_states", ego, EGO)
    got = {(r["t_ns"], r["curvature"], r["i"]): r for r in Q["motion_fan"](spark, str(tmp_path)).collect()}
    assert len(got) == 2 * 7 * 31 + 7
    assert got[TICK, 0.0, 30]["x"] == pytest.approx(3.0) and got[2 * TICK, 0.0, 30]["x"] == pytest.approx(-6.0)
    assert got[2 * TICK, 0.2, 30]["heading"] == pytest.approx(-1.2) and got[3 * TICK, 0.2, 0]["x"] == 0


def test_every_component_has_its_overlap(spark, tmp_path):
    near = lambda c: [(c, 0.1, None, None, 0.0, 1.0, 0.0, 1)]
    said = [("front_left_wheel", "front_left_wheel"), ("front_left_wheel", "rear_right_bumper_corner"), (None, "underbody"), ("something_new", "underbody")]
    rows = [(i, "p", "r", (i + 1) * TICK, 1.0, near(c), 0.0, 0.0, w, "none") for i, (w, c) in enumerate(said)]
    save(spark, tmp_path, "risk_frames", rows, RISK)
    got = {r["class"]: (r["iou"], r["n_union"]) for r in Q["level_iou"](spark, str(tmp_path)).collect()}
    assert got == {"front_left_wheel": (0.5, 2), "rear_right_bumper_corner": (0.0, 1), "underbody": (0.0, 2), "something_new": (0.0, 1)}


def test_every_record_has_its_id(spark, tmp_path):
    dates = ["2018-01-02", "02.01.2018", "20180102", None, "soon", "2018-13-45"]
    save(spark, tmp_path, "raw_records", [(i, f"pole_{i}", "video", "A b.mp4", d) for i, d in enumerate(dates)], "rec_no bigint, id string, kind string, source_name string, date string")
    got = {r["rec_no"]: r for r in Q["record_ids"](spark, str(tmp_path)).collect()}
    assert [got[i]["made_id"] for i in range(6)] == ["video_20180102_a_b_00", "video_20180102_a_b_01", "video_20180102_a_b_02", None, None, None]
    assert all(r["made_stratum"] == "pole" and r["made_split"] in ("dev", "test") for r in got.values())


def test_readings_count_by_the_field_used(spark, tmp_path):
    """Each state has one field that can't be used; the other one still counts."""
    s = 10**9
    ego = [(0, "p", "r", s, 0.0, 0.1), (1, "p", "r", 2 * s, 4.0, None), (2, "p", "r", 3 * s, float("nan"), 0.3), (3, "p", "r", 4 * s, 0.0, 500.0)]
    save(spark, tmp_path, "ego_states", ego, EGO)
    save(spark, tmp_path, "video_frames", [("p", 3 * s // 2), ("p", 3 * s)], "pass_id string, t_ns bigint")
    assert {r["t_ns"]: r["speed_mps"] for r in Q["speed_at_frames"](spark, str(tmp_path)).collect()} == {3 * s // 2: 2.0, 3 * s: 2.0}
    assert [tuple(r) for r in Q["yaw_turned"](spark, str(tmp_path)).collect()] == [("p", 2, 0.4)]


def test_lags_are_sought_as_far_as_the_rig_states(spark, tmp_path):
    """One bump of speed, 4 s earlier in the risk frames: found by the rig that allows 5 s, not by that of 1 s."""
    bump = lambda i: float(max(0, 6 - abs(i - 40)))
    cells = {"a": ("far", 200), "b": ("near", 200), "c": ("slow", 400)}
    ego, risk = [], []
    for p, (rig, ms) in cells.items():
        for i in range(120):
            ego.append((len(ego), p, rig, (i * ms + 1) * 1_000_000, bump(i), None))
            risk.append((len(risk), p, rig, (i * ms + 1) * 1_000_000, bump(i + 4000 // ms), [], 0.0, 0.0, None, "none"))
    save(spark, tmp_path, "ego_states", ego, EGO)
    save(spark, tmp_path, "risk_frames", risk, RISK)
    save(spark, tmp_path, "rig_sync", [("far", 5.0, 5.0), ("near", 5.0, 1.0), ("slow", 2.5, 5.0)], "rig_id string, resample_hz double, max_offset_s double")
    got = {r["pass_id"]: (r["lag"], r["lag_s"]) for r in Q["clock_lags"](spark, str(tmp_path)).collect()}
    assert got["a"] == (20, pytest.approx(4.0, abs=0.1)) and got["c"] == (10, pytest.approx(4.0, abs=0.2))
    assert "b" not in got or abs(got["b"][0]) <= 5


def test_masks_beside_boxes_in_the_plane_of_the_camera(spark, tmp_path):
    """The pixels of a box next to the camera's own plane go beyond any integer; it is dropped and the others keep their masks."""
    from wayfold.plans.detections import C, N, UP

    ahead = [[8.0, 0.5, 0.5], [9.0, 0.5, 0.5], [8.5, -1.0, 0.5]]
    beside = [N * (z - 0.5 - UP) / C + 0.5 + off for z, off in ((0.5, 1e-9), (3.0, -1e-9))]
    rows = [(i, "p", "r", (i + 1) * TICK, 1 if i < 2 else 2, "person", at, [1.0] * 3, None, None, "detector") for i, at in enumerate(ahead)]
    save(spark, tmp_path / "a", "obstacles", rows, OBSTACLE)
    rows += [(i + 3, "p", "r", (i + 4) * TICK, 1, "person", [x, 0.5, z], [1.0] * 3, None, None, "detector") for i, (x, z) in enumerate(zip(beside, (0.5, 3.0)))]
    save(spark, tmp_path / "b", "obstacles", rows, OBSTACLE)
    want, got = (sorted(map(tuple, Q["mask_obstacles"](spark, str(tmp_path / x)).collect())) for x in "ab")
    assert [r[:2] for r in want] == [("p", 1), ("p", 2)] and got == want

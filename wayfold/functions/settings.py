"""Constants that results depend on."""

from __future__ import annotations

# Severity of a component, multiplier by obstacle kind, and pairs that override their product.
DEFAULT_SEVERITY = 1.0
SEVERITY = {
    "front_bumper": 1.2,
    "rear_bumper": 1.2,
    "front_left_bumper_corner": 1.5,
    "front_right_bumper_corner": 1.5,
    "rear_left_bumper_corner": 1.5,
    "rear_right_bumper_corner": 1.5,
    "left_mirror": 2.0,
    "right_mirror": 2.0,
    "front_door_left": 2.5,
    "front_door_right": 2.5,
    "rear_door_left": 2.5,
    "rear_door_right": 2.5,
    "liftgate": 2.5,
    "wheel_front_left": 0.6,
    "wheel_front_right": 0.6,
    "wheel_rear_left": 0.6,
    "wheel_rear_right": 0.6,
    "underbody": 3.0,
}
KIND_MULTIPLIER = {"person": 50.0, "cyclist": 40.0, "vehicle": 3.0, "static_geom": 1.0, "unknown": 1.5}
SEVERITY_OVERRIDE = {
    ("underbody", "static_geom"): 4.0,
    ("wheel_front_left", "static_geom"): 0.4,
    ("wheel_front_right", "static_geom"): 0.4,
    ("wheel_rear_left", "static_geom"): 0.4,
    ("wheel_rear_right", "static_geom"): 0.4,
}

# The vehicle's tables name the wheels the other way round; both names mean the same component.
for _end in ("front", "rear"):
    for _side in ("left", "right"):
        SEVERITY[f"{_end}_{_side}_wheel"] = SEVERITY[f"wheel_{_end}_{_side}"]
        SEVERITY_OVERRIDE[f"{_end}_{_side}_wheel", "static_geom"] = SEVERITY_OVERRIDE[f"wheel_{_end}_{_side}", "static_geom"]

# Speed factor, alert ladder (distance, time to contact, probability) and its hysteresis.
REFERENCE_SPEED, LEAST_FACTOR, MOST_FACTOR = 2.0, 0.2, 3.0
LADDER = {"caution": (1.00, 3.0, 0.20), "warning": (0.50, 2.0, 0.50), "critical": (0.25, 1.0, 0.80)}
FRAMES_UP, FRAMES_DOWN, DWELL_S, DISTANCE_BAND, TTC_BAND = 2, 6, 0.60, 0.10, 0.30

# Motion fan.
HORIZON_S, STEP_S, CURVATURES, LEAST_SPEED = 3.0, 0.1, [-0.20, -0.12, -0.05, 0.0, 0.05, 0.12, 0.20], 0.10
COMPONENT_MARGIN, OBSTACLE_MARGIN, REPORT_DISTANCE = 0.05, 0.05, 2.0

# Timing reports, sync, splits, evaluation.
GAP_FACTOR, VFR_JITTER = 1.8, 0.05
TRUSTED_CORRELATION = 0.30
SPLIT_RATIO, SPLIT_SEED = 0.70, 20260924
FALSE_ALARM_HORIZON_S = 3.0

# Tracking and occupancy.
ACCEL_STD, MEASUREMENT_STD, START_VELOCITY_VAR = 1.0, 0.15, 4.0
GATE, RECOVER_GATE, HIGH_SCORE, LOW_SCORE, MAX_AGE, MIN_HITS = 9.21, 18.42, 0.50, 0.10, 30, 3
CELL, GRID_SIZE, HEIGHT_BAND, OBSTACLE_HEIGHT, PERSIST_S = 0.05, 12.0, (-0.20, 2.50), 0.05, 20.0
DEPTH_BUCKETS, DEPTH_TOLERANCE = [1.0, 3.0, 5.0, 10.0], 0.25

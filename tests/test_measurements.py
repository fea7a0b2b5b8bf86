"""Implausible readings and regular grids against brute force on small fixtures."""

import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from wayfold.operators.grid import regular_grid
from wayfold.operators.medians import exact_medians
from wayfold.operators.sequence import neighbours, with_block
from wayfold.operators.spikes import Measure, fence_rows, flag_rows

M = [Measure("v", ["v"], lambda v: F.abs(v) > 15, lambda v: v == 0)]
SCHEMA = "row bigint, rig string, pass string, t bigint, v double, tbl string"


def brute(rows):
    series, steps = {}, {}
    for row, rig, key, t, v, _ in rows:
        if t is not None and v is not None:
            series.setdefault((rig, key), {}).setdefault((t, repr(v)), (v, []))[1].append(row)
    ordered = {k: [d[x] for x in sorted(d, key=lambda x: x[0])] for k, d in series.items()}
    for (rig, _), seq in ordered.items():
        fin = [v for v, _ in seq if math.isfinite(v)]
        steps.setdefault(rig, []).extend(abs(b - a) for a, b in zip(fin, fin[1:]) if a != b)
    out = set()
    for (rig, _), seq in ordered.items():
        bad = {i for i, (v, _) in enumerate(seq) if not math.isfinite(v) or abs(v) > 15}
        for i in range(len(seq)):
            j = i
            while j < len(seq) and repr(seq[j][0]) == repr(seq[i][0]):
                j += 1
            if j - i >= 6 and seq[i][0] != 0:
                bad.update(range(i, j))
        fin = [i for i, (v, _) in enumerate(seq) if math.isfinite(v)]
        for q in range(3, len(fin) - 3):
            v = seq[fin[q]][0]
            a, b = (median(seq[fin[q + s * d]][0] for d in (1, 2, 3)) for s in (-1, 1))
            u = median(steps[rig]) if steps[rig] else None
            if u is not None and (v - a) * (v - b) > 0 and min(abs(v - a), abs(v - b)) > 9 * u:
                bad.add(fin[q])
        out.update(r for i in bad for r in seq[i][1])
    return out


def made(seed, n=400):
    rng = random.Random(seed)
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([50, 60, 900])
        v = round(math.sin(i / 9) * 3 + rng.gauss(0, 0.05), 4)
        kind = rng.random()
        v = None if kind < 0.03 else math.nan if kind < 0.05 else math.inf if kind < 0.06 else v + 9 if kind < 0.1 else 20.0 if kind < 0.11 else v
        key = rng.choice(["a", "a", "a", "b", None])
        stuck = 1.25 if i % 100 > 80 else v
        rows.append((i, "r1" if key != "b" else "r2", key, t if rng.random() > 0.02 else None, 0.0 if i % 150 > 140 else stuck, "x"))
        if rng.random() < 0.1:
            rows.append((n + i, *rows[-1][1:]))
    return rows


@pytest.mark.parametrize("block", [10**12, 2000, 100])
def test_flags_as_brute_force_whatever_the_blocks(spark, block):
    rows = made(7)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r[0] for r in flag_rows(df, "row", "rig", ["pass"], "t", M, block=block).collect()}
    assert got == brute(rows)


def test_flags_of_nothing_and_of_nulls(spark):
    for rows in ([], [(1, None, None, None, None, None)], [(1, "r", "p", 5, None, None), (1, "r", "p", 5, None, None)]):
        assert flag_rows(spark.createDataFrame(rows, SCHEMA), "row", "rig", ["pass"], "t", M).collect() == []


def test_a_reading_repeated_with_another_field_counts_once(spark):
    """Three equal speeds, each in two rows of different yaw rates, are three readings and no run of six; six of them are one.
    The series of two rigs of one pass stand apart."""
    two = [Measure("v", ["v"], still=lambda v: v == 0), Measure("w", ["w"], still=lambda w: w == 0)]
    rows = lambda n, rig, at: [(at + 2 * i + j, rig, "p", at + i, 1.5, [0.1 * (at + i) + 0.01, None][j]) for i in range(n) for j in (0, 1)]
    given = rows(3, "r", 0) + rows(6, "r2", 100) + rows(5, "r3", 200) + rows(5, "r4", 205)
    df = spark.createDataFrame(given, "row bigint, rig string, pass string, t bigint, v double, w double")
    for block in (10**12, 2):
        got = sorted((r["row"], r["field"], r["frozen"]) for r in flag_rows(df, "row", "rig", ["pass"], "t", two, block=block).collect())
        assert got == [(100 + i, "v", True) for i in range(12)]


def test_neighbours_cross_empty_blocks(spark):
    df = spark.createDataFrame([("k", t, float(t) if t % 3 == 0 else None) for t in range(0, 40, 2)], "k string, t bigint, v double")
    got = {r["t"]: (r["v__prev"], r["v__next"]) for r in neighbours(with_block(df, "t", 4), ["k"], "t", {"v": 2}).collect()}
    assert got[14] == ([12.0, 6.0], [18.0, 24.0])
    assert got[0] == ([], [6.0, 12.0])


def test_exact_medians(spark):
    rng = random.Random(3)
    rows = [("a", i % 5, rng.choice([rng.gauss(0, 1), 0.5])) for i in range(5001)] + [("b", 0, 1.0), ("b", 1, 4.0), ("c", 0, None), ("d", 0, math.nan)]
    got = {r[0]: r[1] for r in exact_medians(spark.createDataFrame(rows, "s string, h int, v double"), ["s"], "h", "v", 128).collect()}
    assert got == {"a": median(v for s, _, v in rows if s == "a"), "b": 2.5}


def test_fences(spark):
    rows = [(i, "r", i * 10**9, float(i % 10)) for i in range(100)] + [(200, "r", 5, 500.0), (201, "r", None, 9e9), (202, "r", 7, None), (203, "r", 8, math.nan)]
    df = spark.createDataFrame(rows, "row bigint, rig string, t bigint, v double")
    assert [r["row"] for r in fence_rows(df, "row", "rig", "t", "v").collect()] == [200]


def test_grid(spark):
    rng = random.Random(1)
    ts = sorted(rng.sample(range(1, 20_000), 60))
    rows = [("p", "r", t, 2.0 * t + 5) for t in ts if not 8000 < t < 11000]
    rows += [rows[3], ("p", "r", None, 1.0), ("p", "r", 0, 1.0), ("q", "other", 5, 1.0), ("one", "r", 9, 3.0)]
    df = spark.createDataFrame(rows, "pass string, rig string, t bigint, v double")
    rates = spark.createDataFrame([("r", 2e6), ("none", None)], "rig string, hz double")
    got = regular_grid(df, rates, "pass", "rig", "t", "v", "hz").collect()
    own = sorted(r["slot"] for r in got if r["pass"] == "p")
    t0, t1 = min(r[2] for r in rows[:-5]), max(r[2] for r in rows[:-5])
    assert own == list(range((t1 - t0) // 500 + 1)) and {r["pass"] for r in got} == {"p", "one"}
    filled = {(r[2] - t0) // 500 for r in rows[:-5]}
    for r in got:
        if r["pass"] == "p":
            assert r["missing"] == (r["slot"] not in filled) and r["slot_t_ns"] == t0 + 500 * r["slot"]
            if r["value"] is not None:
                assert r["value"] == pytest.approx(2.0 * (r["slot_t_ns"] + 250) + 5, rel=1e-6)
    assert any(r["value"] is None for r in got)
    assert regular_grid(df.limit(0), rates, "pass", "rig", "t", "v", "hz").count() == 0

"""Each query of the core against its SQL twin on the smallest test data."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from wayfold.plans import registry


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for f in Path(data).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, data, db, name):
    got = registry.QUERIES[name](spark, data)
    cols = sorted(got.columns)
    want = db.sql(registry.ORACLES[name])
    assert sorted(want.columns) == cols
    a = Counter(tuple(map(plain, r)) for r in got.select(*cols).collect())
    b = Counter(tuple(map(plain, r)) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())
    assert a == b


def test_every_sql_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_core_stands_alone():
    """Nothing outside the subpackage for training data imports it."""
    root = Path(__file__).resolve().parents[1] / "wayfold"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "wayfold.llm" not in f.read_text(), f
    assert os.path.exists(root)

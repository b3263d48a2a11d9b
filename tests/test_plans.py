"""The plans against the checking engine on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from harvestry.plans import registry, transforms

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


def rows(columns, data):
    norm = lambda v: "" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(norm(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql() | transforms.oracle_sql()))
def test_plan(spark, duck, name):
    df = (registry.queries() | transforms.queries())[name](spark, DATA)
    got = duck.execute((registry.oracle_sql() | transforms.oracle_sql())[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in got.description], got.fetchall())


def test_skill_forms_agree(spark):
    a, b = (transforms.queries()[n](spark, DATA) for n in ("skill_longest_match", "skill_longest_match_native"))
    assert rows(a.columns, a.collect()) == rows(b.columns, b.collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

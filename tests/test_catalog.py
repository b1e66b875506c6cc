"""Registered queries give the rows of their SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

from loomtext.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    plain = lambda v: None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v
    own = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(own(plain(v)) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf, duck, name):
    assert rows(catalog.queries()[name](spark, sf).toPandas()) == rows(duck.execute(catalog.oracle_sql()[name]).df())


def test_enhanced(spark, sf):
    """The one query that SQL cannot express, against the regex package."""
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"z10_enhance"}
    regex = pytest.importorskip("regex")
    names = {r.p_partkey: r.p_name for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    for r in catalog.queries()["z10_enhance"](spark, sf).collect():
        m = regex.search("(?e)(?:red){e<=1}", names[r.p_partkey])
        assert r.x == (m and m.group()), names[r.p_partkey]

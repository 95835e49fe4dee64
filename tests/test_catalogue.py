"""Every query of the analytics catalogue against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from loomline.plans import catalogue, more  # noqa: F401  more adds to the catalogue

SF = "/root/testdata/sf0.001"
#: Queries whose rows come in the order that their SQL gives.
ORDERED = {"models_ranked", "models_fitting_first", "files_collated", "map_display_order", "catalog_sort_cost", "top10_files", "top10_folders"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b)
    return a == b


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert got
        return
    told = db.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(told.columns)
    at = [told.columns.index(c) for c in columns]
    want, mine = [tuple(r[i] for i in at) for r in told.fetchall()], [tuple(r[c] for c in columns) for r in got]
    if name not in ORDERED:
        want, mine = sorted(want, key=repr), sorted(mine, key=repr)
    assert len(mine) == len(want)
    assert all(same(x, y) for a, b in zip(mine, want) for x, y in zip(a, b))

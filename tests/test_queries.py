"""Every registered query against its DuckDB SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from siltgrid.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or hasattr(v, "dtype") and v.dtype == bool:
        return str(int(v))
    return f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows(registry.queries()[name](spark, SF).toPandas()) == rows(duck.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"m09_random_forest"}))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_forest_scores_every_odd_scene(spark):
    out = registry.queries()["m09_random_forest"](spark, SF).toPandas()
    assert (out[["tp", "fp", "fn", "tn"]].sum(axis=1) > 0).all() and out["iou"].max() > 0.5


def test_registry_is_whole():
    assert len(registry.queries()) > 100 and set(registry.oracle_sql()) <= set(registry.queries())
    with pytest.raises(ValueError):
        registry.query("p01_project_rename")(lambda s, d: None)


def against_sql(spark, folder, name, **tables):
    """The query's rows and the SQL's, on tables of few keys."""
    c = duckdb.connect()
    for table, select in tables.items():
        c.sql(f"COPY ({select}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return rows(registry.queries()[name](spark, str(folder)).toPandas()), rows(c.sql(registry.oracle_sql()[name]).df())


def test_a_line_of_no_length_in_a_plot_does_not_count(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "j18_lines_by_plot", supplier="SELECT unnest([1497, 1499, 1500])::BIGINT AS s_suppkey, 1 AS s_nationkey")
    assert got == want

"""Every query of the catalog against its SQL, on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from weftline import catalog

FOLDER = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no sample tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, duck, name):
    df, rel = catalog.QUERIES[name](spark, FOLDER), duck.sql(catalog.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    got = sorted(str(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    assert got == sorted(str(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


def test_entry_point():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


def test_joins_read_whole_tables(spark, duck):
    joins = [n for n in catalog.SQL if n.startswith("join_")]
    assert len(joins) >= 16 and not any("%" in catalog.SQL[n] for n in joins)
    assert not any("%" in catalog.QUERIES[n](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString() for n in joins)
    lines, empty = (duck.sql(f"SELECT count(*) FROM {x}").fetchall()[0][0] for x in ("lineitem", "orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"))
    assert empty
    assert catalog.QUERIES["join_inner"](spark, FOLDER).count() == lines
    assert all(catalog.QUERIES[f"join_{n}"](spark, FOLDER).count() == lines + empty for n in ("left", "full", "right"))
    assert all(catalog.QUERIES[f"join_{n}"](spark, FOLDER).count() == empty for n in ("anti", "right_anti"))

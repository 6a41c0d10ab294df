"""What Spark makes of pipelines: scans read few columns and filter, and nothing is shuffled without need."""

import contextlib
import io
import os
import re

import pytest

from weftline import Storage, TransformerPipeline, catalog
from weftline.operators import Filter, GroupBy, Join, MathOperator, SelectColumns


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.range(100).selectExpr("id AS k", "id % 7 AS g", "cast(id AS double) AS v", "cast(id AS string) AS s").write.parquet(f"{path}/facts.parquet")
    spark.range(7).selectExpr("id AS g", "cast(id AS string) AS name", "id AS spare").write.parquet(f"{path}/groups.parquet")
    return path


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    text = out.getvalue()
    return {
        "read": [set(re.findall(r"(\w+):", x)) for x in re.findall(r"ReadSchema: struct<([^\n]*)>", text)],
        "pushed": " ".join(re.findall(r"PushedFilters: ([^\n]*)", text)),
        "exchanges": len(re.findall(r"^\(\d+\) Exchange", text, re.M)),
        "python": bool(re.search("Python|Pandas|Arrow", text)),
    }


def test_filters_and_columns_reach_the_scan(spark, folder):
    steps = [MathOperator(strategy={"new_column_name": "w", "strategy": [{"column": "v"}, {"constant": 2}], "operations": ["mul"]}), Filter(input_col="g", operator="is_in", value=[1, 2]), SelectColumns(columns=["k", "w"])]
    p = plan(TransformerPipeline(steps).run(spark.read.parquet(f"{folder}/facts.parquet"), verbose=False))
    assert p["read"] == [{"k", "g", "v"}] and "In(g, [1,2])" in p["pushed"] and p["exchanges"] == 0 and not p["python"]


def test_joins_read_what_they_need(spark, folder):
    store = Storage()
    store.set("groups", spark.read.parquet(f"{folder}/groups.parquet"))
    steps = [Join(store_key="groups", how="left", on="g", broadcast=True, store=store), Filter(input_col="name", operator="starts_with", value="1"), GroupBy(groupby_columns="name", aggregations={"sum": "v"})]
    p = plan(TransformerPipeline(steps, store=store).run(spark.read.parquet(f"{folder}/facts.parquet"), verbose=False))
    assert sorted(map(sorted, p["read"])) == [["g", "name"], ["g", "v"]] and "StringStartsWith(name,1)" in p["pushed"] and p["exchanges"] == 1


def test_rows_and_splits_need_no_shuffle(spark, folder):
    df = spark.read.parquet(f"{folder}/facts.parquet")
    rows = TransformerPipeline([SelectColumns(columns=["k", "v"])], apply_to_rows={"input_col": "v", "operator": "gt", "value": 5}, otherwise=[SelectColumns(columns=["k", "v"])])
    p = plan(rows.run(df, verbose=False))
    assert p["exchanges"] == 0 and p["read"] == [{"k", "v"}]
    split = TransformerPipeline({"a": [SelectColumns(columns=["k"])], "b": [SelectColumns(columns=["k"])]}, split_function=lambda df: {"a": df.filter("v > 5"), "b": df.filter("v < 1")})
    p = plan(split.run(df, verbose=False))
    assert p["exchanges"] == 0 and p["read"] == [{"k", "v"}] and "Or(GreaterThan(v,5.0),LessThan(v,1.0))" in p["pushed"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no sample tables")
@pytest.mark.parametrize("name", ["window_rows", "lag", "dedup_subset", "pivot_len", "groupby_sum"])
def test_one_shuffle(spark, name):
    p = plan(catalog.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert p["exchanges"] == 1 and not p["python"]

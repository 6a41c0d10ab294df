"""Failures in actions, traced to their steps."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from weftline.operators import AddLiterals, Filter, SelectColumns, SparkSqlFunction, WithColumns
from weftline.plans import TransformerPipeline
from weftline.sources import Storage


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(i, f"{i}" if i != 7 else "seven") for i in range(10)], "i int, s string")


def strict(df):
    return df.withColumn("n", F.col("s").cast("int"))


def steps():
    return [AddLiterals(data=[{"alias": "one", "value": 1}]), WithColumns(columns="s", method="str.strip_chars"), strict, SelectColumns(columns=["i", "n"]), AddLiterals(data=[{"alias": "two", "value": 2}])]


def failing(pipeline, out):
    with pytest.raises(PySparkException) as info, pipeline.watch():
        out.collect()
    return "".join(getattr(info.value, "__notes__", []))


def test_the_step_of_a_cast_is_found(df):
    store = Storage()
    p = TransformerPipeline(steps(), store=store)
    told = failing(p, p.run(df, verbose=False))
    assert "FAIL_DF_function:strict" in told and "fn_strict_" in told
    kept = store.get("FAIL_DF_function:strict")
    assert kept.columns == ["i", "s", "one"] and kept.count() == 10


def test_few_frames_are_computed(df, monkeypatch):
    from weftline.plans import failures

    seen = []
    fails = failures._fails
    monkeypatch.setattr(failures, "_fails", lambda *a: seen.append(1) or fails(*a))
    p = TransformerPipeline([*[AddLiterals(data=[{"alias": f"c{i}", "value": i}]) for i in range(20)], strict, *[AddLiterals(data=[{"alias": f"d{i}", "value": i}]) for i in range(20)]], store=Storage())
    assert "fn_strict_" in failing(p, p.run(df, verbose=False)) and len(seen) <= 7


def test_inside_forks(df):
    store = Storage()
    p = TransformerPipeline([Filter(input_col="i", operator="lt", value=9), strict], apply_to_rows={"input_col": "i", "operator": "gt", "value": 2}, allow_missing_columns=True, store=store)
    assert "FAIL_DF_function:strict" in failing(p, p.run(df, verbose=False))
    assert sorted(r.i for r in store.get("FAIL_DF_function:strict").collect()) == [3, 4, 5, 6, 7, 8]
    one_scan = TransformerPipeline([SparkSqlFunction(column="s", function="raise_error", args=["s"])], branch={"end": "append"}, store=store)
    assert "FAIL_DF_transformer:SparkSqlFunction" in failing(one_scan, one_scan.run(df, verbose=False))


def test_what_does_not_come_from_a_step(spark, df):
    store = Storage()
    p = TransformerPipeline([SelectColumns(columns=["i"])], store=store)
    out = p.run(df, verbose=False)
    with p.watch():
        assert out.count() == 10
    assert failing(p, out.withColumn("bad", F.raise_error(F.lit("mine")))) == "" and not store.list_keys()
    bad = strict(df)
    told = failing(p2 := TransformerPipeline([AddLiterals(data=[{"alias": "x", "value": 1}])], store=store), p2.run(bad, verbose=False))
    assert "AddLiterals" in told  # the frame given fails already, so that the first step is told
    with pytest.raises(ZeroDivisionError), p.watch():
        1 / 0  # noqa: B018

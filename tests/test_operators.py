import inspect

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline import operators as O
from weftline.sources import Storage


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", [n for n in O.__all__ if n[0].isupper() and n not in ("LazyWrapper", "Transformer")])
def test_shape_of_operators(name):
    cls = getattr(O, name)
    assert issubclass(cls, O.Transformer) and cls.__doc__
    params = list(inspect.signature(cls.__init__).parameters.values())[1:]
    assert all(p.kind is p.KEYWORD_ONLY for p in params)


def test_parameters_are_remembered():
    t = O.Filter(input_col="a", operator="gt", value=1)
    assert t.transformer_init_parameters == {"input_col": "a", "operator": "gt", "value": 1}
    t.set_description("positive")
    assert t.get_description() == "positive"


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame([(1.0, "a", None), (None, "b", "x"), (float("nan"), None, "y"), (4.0, None, None)], "v double, s string, `t.u` string")


def test_filter(nulls):
    keep = O.Filter(input_col="v", operator="gt", value=2).transform(nulls)
    remove = O.Filter(input_col="v", operator="gt", value=2, perform="remove").transform(nulls)
    assert keep.count() == 2 and remove.count() == 2  # NaN is larger than all
    assert O.Filter(input_col="t.u", operator="is_null").transform(nulls).count() == 2
    for op in ("ne", "is_not_in", "is_not_null", "is_not_nan"):
        with pytest.raises(ValueError):
            O.Filter(input_col="v", operator=op, value=1 if op == "ne" else None, perform="remove")


def test_drop_nulls(nulls):
    assert O.DropNulls().transform(nulls).count() == 0
    assert O.DropNulls(columns="v").transform(nulls).count() == 2
    assert O.DropNulls(columns=["s", "t.u"], how="all").transform(nulls).count() == 3
    assert O.DropNulls(thresh=2).transform(nulls).count() == 2
    assert O.DropNulls(regex="nothing").transform(nulls).count() == 0


def test_projections(nulls, spark):
    assert O.SelectColumns(columns="t.u", glob="s").transform(nulls).columns == ["t.u", "s"]
    assert O.DropColumns(columns=["t.u", "zz"]).transform(nulls).columns == ["v", "s"]
    with pytest.raises(AssertionError):
        O.DropColumns(columns="zz", allow_excess_columns=False).transform(nulls)
    with pytest.raises(AssertionError):
        O.SelectColumns()
    swapped = O.RenameColumns(mapping={"v": "s", "s": "v"}).transform(nulls)
    assert swapped.columns == ["s", "v", "t.u"] and swapped.dtypes[0] == ("s", "double")
    assert O.RenameColumns(regex_pattern=r"\.", regex_replacement="").transform(nulls).columns[-1] == "tu"
    assert O.RenameColumns(mapping={"zz": "y"}, fail_on_missing_columns=False).transform(nulls).columns == nulls.columns
    for bad in ({"columns": "a", "columns_renamed": ["b", "c"]},):
        with pytest.raises(ValueError):
            O.RenameColumns(**bad)
    for bad in ({}, {"mapping": {"zz": "y"}}):
        with pytest.raises(AssertionError):
            O.RenameColumns(**bad).transform(nulls)
    with pytest.raises(ValueError):
        O.RenameColumns(mapping={"v": "s"}).transform(nulls)


def test_casts(spark):
    df = spark.createDataFrame([("7", 3.7, ["1", "x"])], "a string, b double, c array<string>")
    plain = O.Cast(cast={"a": "int", "b": "int32", "zz": "int"}).transform(df)
    assert plain.dtypes[:2] == [("a", "bigint"), ("b", "int")] and plain.first()[:2] == (7, 3)
    nested = O.Cast(cast={"a": "int", "c": "array<int>"}).transform(df)
    assert nested.dtypes == [("a", "int"), ("b", "double"), ("c", "array<int>")]
    assert nested.first().c == [1, None]
    assert O.Cast(cast={"c": "str", "a": "double"}).transform(df).dtypes[0] == ("a", "double")
    with pytest.raises(ValueError):
        O.Cast(cast={"a": "uint8"})


def test_literals(spark):
    df = O.AddLiterals(data=[{"alias": "x", "value": 1, "cast": "int8"}, {"alias": "n"}]).transform(spark.range(1))
    assert df.dtypes == [("id", "bigint"), ("x", "tinyint"), ("n", "string")] and tuple(df.first()) == (0, 1, None)
    with pytest.raises(KeyError):
        O.AddLiterals(data=[{"value": 1}])
    with pytest.raises(TypeError):
        O.AddLiterals(data=[{"alias": 1}])
    with pytest.raises(ValueError):
        O.AddLiterals(data=[{"alias": "a", "cast": "nothing"}])


def test_math(spark):
    df = spark.createDataFrame([(6, 3), (1, 0), (None, 2)], "a int, b int")
    out = O.MathOperator(
        strategy=[
            {"new_column_name": "a", "strategy": [{"column": "a"}, {"constant": 1}, {"column": "b"}], "operations": ["add", "mul"]},
            {"new_column_name": "q", "strategy": [{"column": "a"}, {"column": "b"}], "operations": ["div"]},
        ]
    ).transform(df)
    assert [tuple(r) for r in out.collect()] == [(21, 3, 2.0), (0, 0, None), (None, 2, None)]  # q sees the old a
    for bad in (
        {"new_column_name": "x", "strategy": [{"column": "a"}], "operations": ["add"]},
        {"new_column_name": "x", "strategy": [{"column": "a"}, {"column": "b"}], "operations": ["mod"]},
        {"new_column_name": "x", "strategy": [{"column": "a", "constant": 1}], "operations": []},
    ):
        with pytest.raises(ValueError):
            O.MathOperator(strategy=bad)


def test_when(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (9, "c")], "v int, n string")
    arms = [{"input_col": "v", "operator": "gt", "value": 5, "output_constant": "big"}, {"input_col": "v", "operator": "is_null", "output_column": "n"}]
    assert [r.o for r in O.When(output_col="o", conditions=arms, otherwise_constant="small").transform(df).collect()] == ["small", "b", "big"]
    with pytest.raises(ValueError):
        O.When(output_col="o", conditions=arms)
    with pytest.raises(ValueError):
        O.When(output_col="o", conditions=arms, otherwise_constant=1, cast_output="nothing")


def test_columns_and_horizontal(spark):
    df = spark.createDataFrame([(" A ", 1, None), ("b", None, 3)], "s string, x int, y int")
    out = O.WithColumns(columns=["s"], method="str.strip_chars", prefix="p_").transform(df)
    assert [r.p_s for r in out.collect()] == ["A", "b"]
    assert O.WithColumns(glob="no*", method="abs").transform(df).columns == df.columns
    with pytest.raises(ValueError):
        O.WithColumns(columns=["x", "y"], method="abs", alias="z").transform(df)
    with pytest.raises(AssertionError):
        O.WithColumns(columns="x", method="abs", alias="z", prefix="p")
    for name, want in {"sum_horizontal": [1, 3], "mean_horizontal": [1.0, 3.0], "max_horizontal": [1, 3], "min_horizontal": [1, 3], "coalesce": [1, 3]}.items():
        assert [r.o for r in O.HorizontalFunction(output_col="o", function=name, columns=["x", "y"]).transform(df).collect()] == want
    assert [r.o for r in O.HorizontalFunction(output_col="o", function="max_horizontal", columns="x").transform(df).collect()] == [1, None]
    with pytest.raises(ValueError):
        O.HorizontalFunction(output_col="o", function="nothing", columns="x")


def test_maps(spark):
    df = spark.createDataFrame([(1, None, "z")], "a int, b int, c string")
    made = O.ColumnsToMap(output_column="m", columns=["a", "b"]).transform(df)
    assert made.first().m == {"a": 1, "b": None}
    assert O.ColumnsToMap(output_column="m", columns=["a", "c"], drop_input_columns=True).transform(df).columns == ["b", "m"]
    out = O.MapToColumns(input_column="m", output_columns={"a": "x", "q": "y"}).transform(made)
    assert out.select("x", "y").first() == (1, None)
    for bad in ([["a"]], [["a", "x"], ["b", "x"]], 5):
        with pytest.raises(TypeError):
            O.MapToColumns(input_column="m", output_columns=bad)
    with pytest.raises(AssertionError):
        O.MapToColumns(input_column="m", output_columns=[])
    with pytest.raises(TypeError):
        O.MapToColumns(input_column="a", output_columns=["x"]).transform(made)


def test_spark_functions(spark):
    df = spark.createDataFrame([([2, 1, None],), (None,)], "d array<int>")
    assert [r.d for r in O.SparkSqlFunction(column="d", function="sort_array", args=["d"]).transform(df).collect()] == [[None, 1, 2], None]
    assert [r.e for r in O.SparkColumnMethod(input_column="d", method="getItem", args=[0], output_column="e").transform(df).collect()] == [2, None]
    for cls, kw in ((O.SparkSqlFunction, {"column": "d", "function": "nope"}), (O.SparkColumnMethod, {"input_column": "d", "method": "nope"})):
        with pytest.raises(ValueError):
            cls(**kw)


def test_group_by(spark):
    df = spark.createDataFrame([("a", 1, 1), ("a", None, 3), ("b", 5, 5)], "k string, v int, w int")
    out = O.GroupBy(groupby_columns="k", aggregations=[{"agg": "n_unique", "col": "v", "alias": "u"}, {"agg": "len", "col": "v", "alias": "n"}, {"agg": "count", "col": "v"}]).transform(df)
    assert rows(out) == [("a", 2, 2, 1), ("b", 1, 1, 1)]
    assert O.GroupBy(groupby_columns="k", aggregations={"sum": ["v", "w"]}, prefix="s_").transform(df).columns == ["k", "s_v", "s_w"]
    assert O.GroupBy(groupby_columns="k", aggregations={"sum": "v"}).transform(df).columns == ["k", "v"]
    with pytest.raises(AssertionError):
        O.GroupBy(aggregations={"sum": ["v"]})
    with pytest.raises(ValueError):
        O.GroupBy(groupby_columns="k", aggregations=[{"agg": "abs", "col": "v"}])
    with pytest.raises(ValueError):
        O.GroupBy(groupby_columns="k", aggregations=[{"agg": "sum", "col": "v"}], prefix="x")


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(g, i, (7 * i) % 5) for g in "ab" for i in range(8)], "g string, i int, v int").repartition(3)


@pytest.mark.parametrize("frame", [{}, {"rows_between": [-1, 2]}, {"rows_between": ["start", "end"]}, {"range_between": [-2, 0]}])
@pytest.mark.parametrize("ascending", [True, False])
def test_windows(series, frame, ascending):
    out = O.AggregateOverWindow(partition_cols="g", order_cols="i", ascending=ascending, aggregations=[{"agg": "sum", "col": "v", "alias": "s"}, {"agg": "mean", "col": "v", "alias": "v"}], **frame).transform(series)
    w = Window.partitionBy("g").orderBy(F.col("i").asc() if ascending else F.col("i").desc())
    ends = {"start": Window.unboundedPreceding, "end": Window.unboundedFollowing}
    if "rows_between" in frame:
        w = w.rowsBetween(*[ends.get(x, x) for x in frame["rows_between"]])
    if "range_between" in frame:
        w = w.rangeBetween(*frame["range_between"])
    assert out.columns == ["g", "i", "s", "v"]
    assert rows(out) == rows(series.select("g", "i", F.sum("v").over(w).alias("s"), F.avg("v").over(w).alias("v")))


def test_window_rules(series):
    agg = {"agg": "countDistinct", "col": "v", "alias": "d"}
    assert {r.d for r in O.AggregateOverWindow(aggregations=agg).transform(series).collect()} == {5}
    for error, kw in [
        (AssertionError, {"aggregations": {**agg, "alias": "g"}, "partition_cols": "g"}),
        (AssertionError, {"aggregations": agg, "order_cols": "i", "rows_between": [0, 1], "range_between": [0, 1]}),
        (ValueError, {"aggregations": agg, "range_between": [0, 1]}),
        (ValueError, {"aggregations": agg, "rows_between": ["end", 0]}),
        (ValueError, {"aggregations": agg, "rows_between": [None, 0]}),
        (ValueError, {"aggregations": agg, "order_cols": ["i", "v"], "ascending": [True, False, True]}),
        (ValueError, {"aggregations": {**agg, "agg": "mode"}}),
        (KeyError, {"aggregations": {"agg": "sum", "col": "v"}}),
    ]:
        with pytest.raises(error):
            O.AggregateOverWindow(**kw)
    out = O.LagOverWindow(partition_cols="g", order_cols="i", lag_col="v", lag=-1, output_col="next").transform(series)
    assert rows(out) == rows(series.select("*", F.lead("v", 1).over(Window.partitionBy("g").orderBy("i")).alias("next")))
    with pytest.raises(ValueError):
        O.LagOverWindow(order_cols="i", lag_col="v", lag=1, output_col="x", rows_between=[0, 1])


def test_pivot(spark):
    df = spark.createDataFrame([(1, "jan", 10, 1), (1, "feb", 20, None), (2, "jan", None, 3), (2, None, 7, 4)], "id int, m string, v int, w int")
    one = O.Pivot(pivot_col="m", id_cols="id", values_cols="v", aggregate_function="sum").transform(df)
    assert one.columns == ["id", "null", "feb", "jan"] and rows(one) == [(1, None, 20, 10), (2, 7, None, None)]
    two = O.Pivot(pivot_col="m", id_cols="id", aggregate_function="len", pivot_values=["jan"]).transform(df)
    assert two.columns == ["id", "v_jan", "w_jan"] and rows(two) == [(1, 1, 1), (2, 1, 1)]
    first = O.Pivot(pivot_col="m", id_cols="id", values_cols="v").transform(df)
    assert rows(first) == [(1, None, 20, 10), (2, 7, None, None)]
    with pytest.raises(ValueError):
        O.Pivot(pivot_col="m", id_cols="id", max_values=2).transform(df)
    with pytest.raises(AssertionError):
        O.Pivot(pivot_col="m")
    with pytest.raises(ValueError):
        O.Pivot(pivot_col="m", id_cols="id", aggregate_function="mode")


def test_unpivot(spark):
    df = spark.createDataFrame([(1, 5, None, "x")], "id int, a int, b int, c string")
    assert rows(O.Unpivot(id_cols="id", melt_cols=["a", "b"]).transform(df)) == [(1, "a", 5), (1, "b", None)]
    assert rows(O.Unpivot(melt_cols=["a", "c"]).transform(df)) == [("a", "5"), ("c", "x")]
    assert O.Unpivot(id_cols="id", melt_regex="^zz").transform(df).columns == ["id", "variable", "value"]
    with pytest.raises(AssertionError):
        O.Unpivot(id_cols="id")


def test_explode(spark):
    df = spark.createDataFrame([("r", [1, None], {"k": 1}), ("e", [], {}), ("n", None, None)], "n string, a array<int>, m map<string,int>")
    assert rows(O.SparkExplode(input_col="a").transform(df).select("n", "a")) == [("e", None), ("n", None), ("r", 1), ("r", None)]
    assert O.SparkExplode(input_col="a", outer=False, output_cols="x").transform(df).count() == 2
    out = O.SparkExplode(input_col="m", output_cols=["n", "v"], drop_after=True).transform(df)
    assert out.columns == ["a", "n", "v"] and out.count() == 3
    for kw in ({"input_col": "m"}, {"input_col": "n"}):
        with pytest.raises(AssertionError):
            O.SparkExplode(**kw).transform(df)
    with pytest.raises(AssertionError):
        O.SparkExplode(input_col="m", output_cols=["k"])


def test_frames(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (2, None)], "k int, s string")
    assert rows(O.SparkDropDuplicates(columns="k").transform(df)) == [(1, "b"), (2, None)]
    assert O.SparkDropDuplicates().transform(df).count() == 3
    assert O.Repartition(num_partitions=5, columns="k").transform(df).rdd.getNumPartitions() == 5
    assert O.Repartition(rows_per_partition=2).transform(df).rdd.getNumPartitions() == 2
    assert O.Repartition().transform(df).rdd.getNumPartitions() == 4
    assert O.CoalescePartitions(num_partitions=1).transform(df).rdd.getNumPartitions() == 1
    with pytest.raises(AssertionError):
        O.Repartition(columns=["k", "k"])
    with pytest.raises(AssertionError):
        O.Repartition(num_partitions=1, columns="zz").transform(df)
    held = O.Persist().transform(df)
    assert held.is_cached and O.Cache().transform(held) is held
    held.unpersist()
    sort = O.DataFrameMethod(method="sort", args=["s"], kwargs={"descending": True})
    assert [r.s for r in sort.transform(df).collect()] == [None, None, "b", "a"]
    assert O.DataFrameMethod(method="explode", args=["l"]).transform(df.withColumn("l", F.array(F.lit(1), F.lit(2)))).count() == 8


def test_checks(spark):
    df = spark.range(3)
    for t in (O.AssertCount(expected=3), O.AssertCount(min_count=1, max_count=3), O.AssertNotEmpty(), O.AssertContainsColumns(columns="id"), O.PrintSchema(), O.LogDataSkew(), O.CpuInfo(n_partitions=2)):
        assert t.transform(df) is df
    for t in (O.AssertCount(expected=2), O.AssertCount(max_count=2), O.AssertContainsColumns(columns=["id", "x"])):
        with pytest.raises(AssertionError):
            t.transform(df)
    with pytest.raises(AssertionError):
        O.AssertNotEmpty(df_name="mine").transform(df.limit(0))
    with pytest.raises(ValueError):
        O.AssertCount()


def test_append(spark):
    store = Storage()
    store.set("other", spark.createDataFrame([("x", 1.5)], "c1 string, c3 double"))
    df = spark.createDataFrame([("a", 1)], "c1 string, c2 bigint")
    with pytest.raises(ValueError):
        O.AppendDataFrame(store_key="other", store=store).transform(df)
    out = O.AppendDataFrame(store_key="other", allow_missing_cols=True, store=store).transform(df)
    assert rows(out) == [("a", 1, None), ("x", None, 1.5)]


def test_lazy(spark):
    store = Storage()
    store.set("limit", 1)
    t = O.LazyWrapper(O.Filter, input_col="id", operator="is_in", value=[(store, "limit"), 2])
    assert rows(t.transform(spark.range(4))) == [(1,), (2,)]
    store.set("limit", 3)
    assert rows(t.transform(spark.range(4))) == [(2,), (3,)]

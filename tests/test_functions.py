import datetime
import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.conditions import OPERATORS, check_condition, condition, null_to_false
from weftline.functions.frames import (
    cast_to_schema,
    compare_dfs,
    drop_duplicates_no_randomness,
    get_data_skew,
    get_default_spark_partitions,
    hash_dataframe,
    is_broadcast,
    split_df,
    to_schema,
)
from weftline.functions.methods import COLUMN_METHODS, column_method, frame_method
from weftline.functions.ordered import with_deferred
from weftline.functions.selectors import col, select_columns
from weftline.functions.pandas_frames import assert_pandas_df_equal, return_different_rows_in_pandas_dataframes
from weftline.functions.types import portable, resolve, resolve_all
from weftline.functions.workers import lib_in_spark_workers, lib_version_in_spark_workers, udf_ensure_package_in_spark_workers, udf_lib_version_in_spark_workers

NAMES = ["a", "b1", "b2", "c.d", "Total"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ({}, []),
        ({"columns": "b2"}, ["b2"]),
        ({"columns": ["b2", "a"]}, ["b2", "a"]),
        ({"regex": "b|T"}, ["b1", "b2", "Total"]),
        ({"glob": "b*"}, ["b1", "b2"]),
        ({"columns": ["b2"], "regex": "^b", "glob": "c*"}, ["b2", "b1", "c.d"]),
        ({"startswith": "b"}, ["b1", "b2"]),
        ({"endswith": ["1", "d"]}, ["b1", "c.d"]),
        ({"columns": ["x", "a"], "allow_excess_columns": True}, ["x", "a"]),
    ],
)
def test_selection(given, want):
    assert select_columns(NAMES, **given) == want


@pytest.mark.parametrize("given", [{"columns": ["a", "a"]}, {"columns": "x"}, {"startswith": "a", "endswith": "b"}, {"startswith": "a", "regex": "b"}])
def test_bad_selection(given):
    with pytest.raises(AssertionError):
        select_columns(NAMES, **given)


def test_types():
    assert resolve("Int64") == "bigint" and resolve("float32") == "float" and portable("datetime[ms]") == "timestamp"
    assert resolve_all({"a": "int", "b": "float"}) == {"a": "bigint", "b": "double"}
    assert resolve_all({"a": "int", "b": "array<int>"}) == {"a": "int", "b": "array<int>"}
    for bad in ("uint8", "datetime[ns]", "no type"):
        with pytest.raises(ValueError):
            resolve(bad)


PEOPLE = [(25.0, 1.0, "Alice", "on"), (None, float("nan"), "bob", None), (40.0, None, None, "off"), (12.0, 3.0, "Carla", "on")]


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(PEOPLE, "age double, score double, name string, status string")


@pytest.mark.parametrize(
    ("args", "want"),
    [
        (("age", "eq", 25), [True, None, False, False]),
        (("age", "ne", 25), [False, None, True, True]),
        (("age", "lt", None, "score"), [False, None, None, False]),
        (("age", "ge", 25), [True, None, True, False]),
        (("age", "is_null"), [False, True, False, False]),
        (("age", "is_not_null"), [True, False, True, True]),
        (("score", "is_nan"), [False, True, False, False]),
        (("score", "is_not_nan"), [True, False, True, True]),
        (("name", "contains", "[Aa]li|Ca"), [True, False, None, True]),
        (("name", "starts_with", "a"), [False, False, None, False]),
        (("name", "ends_with", "a"), [False, False, None, True]),
        (("status", "is_in", ["on"]), [True, None, False, True]),
        (("status", "is_in", []), [False, False, False, False]),
        (("status", "is_not_in", ["on"]), [False, True, True, False]),
        (("age", "is_between", [12, 25]), [True, None, False, True]),
    ],
)
def test_conditions(people, args, want):
    got = [r[0] for r in people.select(condition(*args)).collect()]
    if args[:2] == ("status", "is_in") and not args[2]:
        got = [bool(x) for x in got]
    assert got == want
    assert [r[0] for r in people.select(null_to_false(condition(*args))).collect()] == [bool(x) for x in got]


@pytest.mark.parametrize(
    ("error", "args"),
    [
        (ValueError, ("like", 1)), (ValueError, ("eq",)), (ValueError, ("eq", 1, "b")), (ValueError, ("is_null", 1)), (TypeError, ("contains", 1)), (TypeError, ("is_in", "abc")),
        (ValueError, ("is_in", [1, None])), (ValueError, ("is_between", [1])), (ValueError, ("is_between", None, "b")),
    ],
)
def test_bad_conditions(error, args):
    with pytest.raises(error):
        check_condition(*args)


def test_all_operators_are_known():
    assert len(OPERATORS) == 16


def test_string_methods(spark):
    df = spark.createDataFrame([("  aXb-7 ",), (None,)], "s string")
    run = lambda m, *a, **k: df.select(column_method(m)(col("s"), *a, **k)).first()[0]
    assert run("str.strip_chars") == "aXb-7" and run("str.strip_chars", " 7") == "aXb-"
    assert run("str.replace", "[a-z]", "_") == "  _Xb-7 " and run("str.replace", ".", "", literal=True) == "  aXb-7 "
    assert run("str.replace_all", "[a-z]", "_") == "  _X_-7 " and run("str.slice", -3, 2) == "-7"
    assert run("str.head", -2) == "  aXb-" and run("str.tail", 2) == "7 " and run("str.contains", "X.") is True
    df = spark.createDataFrame([("-5",)], "s string")
    assert df.select(column_method("str.zfill")(col("s"), 4)).first()[0] == "-005"
    with pytest.raises(ValueError):
        column_method("str.a.b")
    with pytest.raises(ValueError):
        column_method("no_such")
    with pytest.raises(ValueError):
        COLUMN_METHODS["shift"](F.lit(1))
    with pytest.raises(ValueError):
        frame_method("no_such")


def test_as_of_join(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 10), (3, "b", 1), (4, None, 7)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 4, 40), ("a", 10, 100), ("b", 2, 20), (None, 1, 1)], "k string, t int, v int")
    back = frame_method("join_asof")(left, right, on="t", by="k")
    ahead = frame_method("join_asof")(left, right, on="t", by="k", strategy="forward")
    assert {r.id: r.v for r in back.collect()} == {1: 40, 2: 100, 3: None, 4: None}
    assert {r.id: r.v for r in ahead.collect()} == {1: 100, 2: 100, 3: 20, 4: None}


def test_cast_to_schema(spark):
    df = spark.createDataFrame([(1, "2", [1])], "a int, b string, c array<int>")
    to = T.StructType.fromDDL("c array<bigint>, b int, a int")
    assert cast_to_schema(df, to).schema.simpleString() == "struct<c:array<bigint>,b:int,a:int>"
    with pytest.raises(AssertionError):
        cast_to_schema(df, T.StructType.fromDDL("a int"))


@pytest.mark.parametrize("name", ["md5", "crc32", "sha1", "sha2", "xxhash64"])
def test_hashes(spark, name):
    df = spark.createDataFrame([("x", 1.5), (None, None)], "c1 string, c2 double")
    again = df.select("c2", "c1")
    a, b = (sorted(str(r.h) for r in hash_dataframe(d, name, "h").collect()) for d in (df, again))
    assert a == b and len(set(a)) == 2
    assert df.select(hash_dataframe(df, name, return_func=True)).count() == 2


def test_compare(spark):
    df = spark.range(5).selectExpr("id", "id % 2 AS k")
    assert compare_dfs(df, df.select("k", "id")) == (None, None)
    for other in (df.limit(4), df.withColumn("z", F.lit(1)), df.withColumn("k", F.lit("a")), df.withColumn("k", F.lit(5).cast("bigint"))):
        with pytest.raises(AssertionError):
            compare_dfs(df, other)
    odd = df.withColumn("k", F.when(F.col("id") == 3, 9).otherwise(F.col("k")))
    a, b = compare_dfs(df, odd, return_mismatched_rows=True)
    assert [tuple(r) for r in a.collect()] == [(3, 1)] and [tuple(r) for r in b.collect()] == [(3, 9)]
    assert compare_dfs(df, odd, columns="id") == (None, None)


def test_deterministic_deduplication(spark):
    rows = [("x", 1, "b", [1]), ("x", 2, "a", [1]), ("y", None, None, None), (None, 3, "c", [2])]
    df = spark.createDataFrame(rows, "k string, n int, s string, l array<int>").select("n", "l", "k", "s")
    one = drop_duplicates_no_randomness(df, "k")
    assert one.columns == ["k", "n", "s", "l"]
    assert {tuple(r)[:3] for r in one.collect()} == {("x", 2, "b"), ("y", None, None), (None, 3, "c")}
    assert sorted(map(str, one.collect())) == sorted(map(str, drop_duplicates_no_randomness(df.orderBy(F.desc("n")), ["k"]).collect()))


def test_partitions_and_workers(spark):
    df = spark.range(0, 10, 1, 3).union(spark.range(0).repartition(2))
    skew = get_data_skew(df)
    assert skew.rows == 10 and skew.max == 4 and skew.min in (0, 3)
    assert get_default_spark_partitions(df) == 4
    assert is_broadcast(df.join(F.broadcast(spark.range(3)), "id")) and not is_broadcast(spark.range(3))
    assert lib_in_spark_workers(spark, "json") and not lib_in_spark_workers(spark, "no_such_module")
    assert lib_version_in_spark_workers(spark, "numpy")[0].isdigit()
    with pytest.raises(RuntimeError):
        lib_version_in_spark_workers(spark, "no_such_module")
    df = spark.range(2)
    assert df.select(udf_ensure_package_in_spark_workers("numpy")("id")).first()[0] is True
    assert df.select(udf_lib_version_in_spark_workers("no_such_module")("id")).first()[0] is None


def test_split_and_schemas(people):
    a, b = split_df(people, "age", "gt", 20)
    assert a.count() == 2 and b.count() == 2
    assert all(f.schema == people.schema for f in to_schema([a, b.select(*reversed(b.columns))], people.schema))


def test_package_reaches_workers(tmp_path):
    """A driver that is elsewhere, with the package on its own path only."""
    import subprocess
    import sys

    from .conftest import ROOT

    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
from weftline.functions.workers import lib_in_spark_workers
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("found", lib_in_spark_workers(s, "weftline.functions.types"))
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "found True" in out.stdout, out.stderr[-2000:]


def test_pandas_frames():
    import numpy as np
    import pandas as pd

    a = pd.DataFrame({"x": [1, 2, 2], "y": [[1], {"k": {1, 2}}, np.array([3])]})
    b = a.iloc[[2, 0, 1]][["y", "x"]].assign(y=[[3], [1], {"k": {2, 1}}])
    assert_pandas_df_equal(a, b)
    c = pd.DataFrame({"x": [1, 2, 2], "y": [[1], [3], [3]]})
    one, two = return_different_rows_in_pandas_dataframes(a, c)
    assert one["y"].tolist() == [{"k": {1, 2}}] and two["y"].tolist() == [[3]]
    for bad in (c, a.head(2), a.rename(columns={"x": "z"})):
        with pytest.raises(AssertionError):
            assert_pandas_df_equal(a, bad)
    assert_pandas_df_equal(a, c, assert_not_deep=True)


D = datetime.datetime
T0 = D(2024, 2, 29, 13, 45, 59, 123456)
#: method, input, arguments, keywords, what comes out
CASES = [
    ("abs", -2.5, [], {}, 2.5), ("round", 2.345, [2], {}, 2.35), ("cast", "7", ["int"], {}, 7), ("floor", -2.5, [], {}, -3), ("ceil", -2.5, [], {}, -2), ("sqrt", 9.0, [], {}, 3.0),
    ("exp", 1.0, [], {}, math.e), ("log", 8.0, [2], {}, 3.0), ("log", math.e, [], {}, 1.0), ("sin", 1.0, [], {}, math.sin(1)), ("cos", 1.0, [], {}, math.cos(1)), ("tan", 1.0, [], {}, math.tan(1)),
    ("pow", 3.0, [2], {}, 9.0), ("sign", -3.0, [], {}, -1.0), ("clip", 7.0, [0.0, 5.0], {}, 5.0), ("is_finite", float("inf"), [], {}, False), ("is_finite", 1.0, [], {}, True),
    ("fill_null", None, [4], {}, 4), ("fill_null", None, [], {"strategy": "zero"}, 0), ("fill_null", None, [], {"strategy": "one"}, 1), ("fill_nan", float("nan"), [1.5], {}, 1.5),
    ("is_null", None, [], {}, True), ("is_not_null", 1, [], {}, True), ("is_nan", float("nan"), [], {}, True), ("is_in", 2, [[1, 2]], {}, True), ("is_between", 2, [2, 3], {}, True),
    ("replace_strict", "a", [["a", "b"], [1, 2]], {}, 1), ("replace_strict", "z", [{"a": 1}], {"default": 9}, 9),
    ("str.to_lowercase", "Ab", [], {}, "ab"), ("str.to_uppercase", "Ab", [], {}, "AB"), ("str.to_titlecase", "ab cd", [], {}, "Ab Cd"), ("str.replace_all", "a.b.", [".", "-"], {"literal": True}, "a-b-"),
    ("str.replace", "a1b1", [r"(\d)", "<$1>"], {}, "a<1>b1"), ("str.replace", "xaabb", [r"(a)\1", "${1}!"], {}, "xa!bb"), ("str.replace", "a$b", ["$", r"\$1"], {"literal": True}, r"a\$1b"), ("str.replace", "none", ["z", "y"], {}, "none"),
    ("str.starts_with", "abc", ["ab"], {}, True), ("str.ends_with", "abc", ["bc"], {}, True), ("str.len_chars", "é", [], {}, 1), ("str.len_bytes", "é", [], {}, 2), ("str.split", "a.b", ["."], {}, ["a", "b"]),
    ("str.strip_chars_start", "  a ", [], {}, "a "), ("str.strip_chars_end", " a  ", [], {}, " a"), ("str.zfill", "+7", [4], {}, "+007"), ("str.contains", "a.c", ["."], {"literal": True}, True),
    ("str.to_date", "29/02/24", ["%d/%m/%y"], {}, datetime.date(2024, 2, 29)), ("str.to_date", "2024-02-29", [], {}, datetime.date(2024, 2, 29)), ("str.to_date", "no", ["%Y"], {}, None),
    ("str.to_datetime", "2024-02-29T13:45:59", ["%Y-%m-%dT%H:%M:%S"], {}, D(2024, 2, 29, 13, 45, 59)), ("str.to_datetime", "2024-02-29 13:45:59.123456", ["%F %T%.f"], {}, T0), ("str.to_datetime", "20240229", ["yyyyMMdd"], {}, D(2024, 2, 29)),
    ("dt.year", T0, [], {}, 2024), ("dt.month", T0, [], {}, 2), ("dt.quarter", T0, [], {}, 1), ("dt.week", T0, [], {}, 9), ("dt.day", T0, [], {}, 29), ("dt.hour", T0, [], {}, 13), ("dt.minute", T0, [], {}, 45), ("dt.second", T0, [], {}, 59),
    ("dt.millisecond", T0, [], {}, 123), ("dt.microsecond", T0, [], {}, 123456), ("dt.nanosecond", T0, [], {}, 123456000), ("dt.ordinal_day", T0, [], {}, 60), ("dt.weekday", T0, [], {}, 4), ("dt.date", T0, [], {}, datetime.date(2024, 2, 29)),
    ("dt.timestamp", T0, [], {}, 1709214359123456), ("dt.timestamp", T0, ["ms"], {}, 1709214359123), ("dt.timestamp", T0, ["ns"], {}, 1709214359123456000), ("dt.timestamp", D(1969, 12, 31, 23, 59, 59, 999500), ["ms"], {}, -1),
    ("dt.to_string", T0, ["%Y-%m-%d %H:%M"], {}, "2024-02-29 13:45"), ("dt.to_string", T0, ["%d of %B, %j%%"], {}, "29 of February, 060%"), ("dt.to_string", T0, ["yyyy"], {}, "2024"), ("dt.to_string", T0, ["%H:%M:%S%.3f"], {}, "13:45:59.123"),
    ("dt.truncate", T0, ["1y"], {}, D(2024, 1, 1)), ("dt.truncate", T0, ["1q"], {}, D(2024, 1, 1)), ("dt.truncate", T0, ["1mo"], {}, D(2024, 2, 1)), ("dt.truncate", T0, ["5mo"], {}, D(2023, 10, 1)), ("dt.truncate", T0, ["1w"], {}, D(2024, 2, 26)),
    ("dt.truncate", T0, ["2w"], {}, D(2024, 2, 19)), ("dt.truncate", T0, ["1d"], {}, D(2024, 2, 29)), ("dt.truncate", T0, ["4d"], {}, D(2024, 2, 27)), ("dt.truncate", T0, ["1h"], {}, D(2024, 2, 29, 13)), ("dt.truncate", T0, ["15m"], {}, D(2024, 2, 29, 13, 45)),
    ("dt.truncate", T0, ["7s"], {}, D(2024, 2, 29, 13, 45, 53)), ("dt.truncate", T0, ["10ms"], {}, D(2024, 2, 29, 13, 45, 59, 120000)), ("dt.truncate", D(1969, 12, 31, 23, 50), ["1h"], {}, D(1969, 12, 31, 23)), ("dt.truncate", D(1969, 12, 31, 23, 50), ["2d"], {}, D(1969, 12, 30)),
    ("dt.offset_by", T0, ["1y"], {}, D(2025, 2, 28, 13, 45, 59, 123456)), ("dt.offset_by", T0, ["-1mo2h"], {}, D(2024, 1, 29, 11, 45, 59, 123456)), ("dt.offset_by", T0, ["1d12h1us"], {}, D(2024, 3, 2, 1, 45, 59, 123457)),
    ("dt.convert_time_zone", T0, ["Asia/Tokyo"], {}, D(2024, 2, 29, 22, 45, 59, 123456)), ("dt.replace_time_zone", T0, ["Asia/Tokyo"], {}, D(2024, 2, 29, 4, 45, 59, 123456)),
    ("list.len", [1, 2], [], {}, 2), ("list.sort", [2, 1], [], {}, [1, 2]), ("list.unique", [1, 1], [], {}, [1]), ("list.contains", [1, 2], [2], {}, True), ("list.get", [1, 2], [5], {}, None), ("list.max", [1, 2], [], {}, 2), ("list.min", [1, 2], [], {}, 1),
]
SPANS = {"days": -1, "hours": -25, "minutes": -1501, "seconds": -90061, "milliseconds": -90061500, "microseconds": -90061500000, "nanoseconds": -90061500000000}


def test_column_methods(spark):
    columns = []
    for i, (name, value, args, kwargs, _) in enumerate(CASES):
        given = F.lit(value) if not isinstance(value, list) else F.array(*map(F.lit, value))
        given = given.cast("int") if value is None else given
        columns.append(column_method(name)(given, *args, **kwargs).alias(f"c{i}"))
    got = spark.range(1).select(*columns).first()
    for (name, value, args, kwargs, want), out in zip(CASES, got, strict=True):
        out = out.replace(tzinfo=None) if isinstance(out, datetime.datetime) else out
        assert out == (pytest.approx(want) if isinstance(want, float) else want), (name, value, args, kwargs)
    span = F.lit(datetime.timedelta(days=-1, hours=-1, minutes=-1, seconds=-1, milliseconds=-500))
    got = spark.range(1).select(*[column_method(f"dt.total_{k}")(span).alias(k) for k in SPANS]).first()
    assert got.asDict() == SPANS
    assert spark.range(1).select(column_method("struct.field")(F.struct(F.lit(3).alias("x")), "x")).first()[0] == 3


@pytest.mark.parametrize(
    ("name", "args"), [("dt.truncate", ["1x"]), ("dt.truncate", ["0d"]), ("dt.truncate", ["1d1h"]), ("dt.truncate", ["month"]), ("dt.to_string", ["%Q"]), ("str.to_date", ["%"]), ("dt.offset_by", ["soon"]), ("dt.timestamp", ["s"]), ("fill_null", []), ("rank", ["best"]), ("str.replace", ["a", "$0"])]
)
def test_bad_arguments(spark, name, args):
    with pytest.raises(ValueError):
        column_method(name)(F.lit("x"), *args)


def test_ordered_methods(spark):
    rows = [(1, "a", 5.0), (2, "a", None), (3, "a", 5.0), (4, "a", 1.0), (5, "b", 2.0)]
    df = spark.createDataFrame(rows, "i int, k string, x double")

    def run(name, *args, c="x", **kwargs):
        out = with_deferred(df, {"out": column_method(name)(col(c), *args, **kwargs)}).orderBy("i")
        return [r.out for r in out.collect()]

    by = {"order_by": "i", "partition_by": "k"}
    assert run("shift", **by) == [None, 5.0, None, 5.0, None] and run("diff", c="i", **by) == [None, 1, 1, 1, None]
    assert run("cum_sum", **by) == [5.0, 5.0, 10.0, 11.0, 2.0] and run("cum_max", **by) == [5.0, 5.0, 5.0, 5.0, 2.0] and run("cum_min", **by) == [5.0, 5.0, 5.0, 1.0, 2.0]
    assert run("cum_count", **by) == [1, 1, 2, 3, 1]
    assert run("rank") == [3.5, None, 3.5, 1.0, 2.0] and run("rank", "max") == [4, None, 4, 1, 2] and run("rank", "min") == [3, None, 3, 1, 2]
    assert run("rank", "dense", descending=True) == [1, None, 1, 3, 2] and sorted(run("rank", "ordinal"), key=str) == [1, 2, 3, 4, None]
    assert run("rank", "average", partition_by="k") == [2.5, None, 2.5, 1.0, 1.0] and run("rank", "min", c="k", order_by="i") == [1, 2, 3, 4, 5]
    assert run("rolling_sum", 2, **by) == [None, None, None, 6.0, None] and run("rolling_sum", 2, min_samples=1, **by) == [5.0, 5.0, 5.0, 6.0, 2.0]
    assert run("rolling_mean", 2, **by) == [None, None, None, 3.0, None] and run("rolling_min", 2, **by)[3] == 1.0 and run("rolling_max", 2, **by)[3] == 5.0
    assert run("rolling_median", 3, min_samples=2, **by) == [None, None, 5.0, 3.0, None] and run("rolling_median", 3, min_samples=2, order_by="i") == [None, None, 5.0, 3.0, 2.0]
    assert run("rolling_var", 2, **by)[3] == 8.0 and run("rolling_std", 2, **by)[3] == pytest.approx(8**0.5)
    assert run("fill_null", strategy="forward", **by) == [5.0, 5.0, 5.0, 1.0, 2.0] and run("fill_null", strategy="backward", **by) == [5.0, 5.0, 5.0, 1.0, 2.0]
    assert run("is_first_distinct", order_by="i") == [True, True, False, True, True] and run("is_last_distinct", order_by="i", partition_by="k") == [False, True, True, True, True]
    assert run("is_duplicated") == [True, False, True, False, False] and run("is_unique") == [False, True, False, True, True]


def test_every_method_is_tested():
    named = {c[0] for c in CASES} | {f"dt.total_{k}" for k in SPANS}
    text = open(__file__, encoding="utf-8").read()
    assert not [m for m in COLUMN_METHODS if m not in named and f'"{m}"' not in text]


def test_frame_methods(spark):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, []), (3, "c", None)], "i int, s string, l array<int>")
    run = lambda m, *a, **k: [tuple(r) for r in frame_method(m)(df, *a, **k).orderBy("i").collect()]
    assert run("tail", 1, by="i") == [(3, "c", None)] and frame_method("rename")(df, {"s": "t"}).columns == ["i", "t", "l"]
    assert frame_method("drop")(df, "s", ["l"]).columns == ["i"] and frame_method("select")(df, "l", "i").columns == ["l", "i"]
    assert run("drop_nulls", "s") == [(1, "a", [1, 2]), (3, "c", None)] and run("drop_nulls") == [(1, "a", [1, 2])]
    assert [r.i for r in frame_method("gather_every")(df, 2, order_by="i").orderBy("i").collect()] == sorted(r.i for r in df.collect())[::2]
    assert [r.i for r in frame_method("gather_every")(df, 2, 1, order_by="i").orderBy("i").collect()] == sorted(r.i for r in df.collect())[1::2]
    with pytest.raises(ValueError):
        frame_method("gather_every")(df, 2)
    melted = frame_method("unpivot")(df.select("i", F.col("i").alias("j"), F.lit(None).cast("int").alias("none")), index="i", variable_name="what")
    assert melted.columns == ["i", "what", "value"] and sorted((r.what, r.value) for r in melted.collect() if r.i == 1) == sorted([("j", 1), ("none", None)])
    assert [r.n for r in frame_method("with_row_index")(df, "n", order_by="i").orderBy("i").collect()] == [0, 1, 2]
    assert run("explode", "l") == [(1, "a", 1), (1, "a", 2), (2, None, None), (3, "c", None)]
    assert run("filter", "i > 1", "s IS NOT NULL") == [(3, "c", None)]
    assert [r.j for r in frame_method("with_columns")(df, j="i * 2").orderBy("i").collect()] == [2, 4, 6]
    assert frame_method("null_count")(df).first().asDict() == {"i": 0, "s": 1, "l": 1}


def test_comparison_tells_where_nulls_are(spark):
    one = spark.createDataFrame([("x", None), ("a-b", "c")], "a string, b string")
    two = spark.createDataFrame([(None, "x"), ("a", "b-c")], "a string, b string")
    with pytest.raises(AssertionError):
        compare_dfs(one, two)
    more, less = compare_dfs(one, two, return_mismatched_rows=True)
    assert more.count() == less.count() == 2 and compare_dfs(one, one.repartition(3)) == (None, None)
    nan = spark.createDataFrame([(float("nan"), {"k": 1})], "x double, m map<string,int>")
    assert compare_dfs(nan, nan) == (None, None)

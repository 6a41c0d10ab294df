"""Queries over the sample tables, one or more for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.frames import cast_to_schema, compare_dfs, drop_duplicates_no_randomness, hash_dataframe, is_broadcast
from weftline.functions.workers import udf_ensure_package_in_spark_workers
from weftline.operators import (
    AddLiterals,
    AggregateOverWindow,
    AppendDataFrame,
    AssertContainsColumns,
    AssertCount,
    AssertNotEmpty,
    Cache,
    Cast,
    CoalescePartitions,
    ColumnsToMap,
    CpuInfo,
    DataFrameMethod,
    DropColumns,
    DropNulls,
    Filter,
    GroupBy,
    HorizontalFunction,
    Join,
    LagOverWindow,
    LogDataSkew,
    MapToColumns,
    MathOperator,
    Persist,
    Pivot,
    PrintSchema,
    RenameColumns,
    Repartition,
    SelectColumns,
    SparkColumnMethod,
    SparkDropDuplicates,
    SparkExplode,
    SparkSqlFunction,
    Unpivot,
    When,
    WithColumns,
)
from weftline.plans import TransformerPipeline, load_pipeline
from weftline.plans.hooks import NoOpHooks
from weftline.sources import Storage, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, source: str, steps: Any, sql: str | None, **options: Any) -> None:
    """A query that runs a pipeline on one table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Storage()
        given = steps(spark, sf_dir, store) if callable(steps) else steps
        return TransformerPipeline(given, **options, store=store).run(read_table(spark, sf_dir, source), verbose=False)

    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def query(sql: str | None) -> Callable[[Callable], Callable]:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Orders with their lines where they have any: the sample tables hold no NULL of their own.
_LEFT_LINES = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, l_quantity, l_discount, l_returnflag FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey"


def _orders_and_lines(spark: SparkSession, sf_dir: str, store: Storage) -> list:
    store.set("lines", read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity", "l_discount", "l_returnflag"]))
    return [
        SelectColumns(columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]),
        Join(store_key="lines", how="left", left_on="o_orderkey", right_on="l_orderkey", store=store),
    ]


def _then(*steps: Any) -> Callable[[SparkSession, str, Storage], list]:
    return lambda spark, sf_dir, store: [*_orders_and_lines(spark, sf_dir, store), *steps]


# Filter: each predicate, kept and removed
_NAN = "CASE WHEN l_quantity > 40 THEN 'nan'::DOUBLE ELSE l_quantity END"
_PREDICATES: list[tuple[str, dict[str, Any], str]] = [
    ("eq", {"input_col": "l_returnflag", "operator": "eq", "value": "A"}, "l_returnflag = 'A'"),
    ("ne", {"input_col": "l_returnflag", "operator": "ne", "value": "A"}, "l_returnflag <> 'A'"),
    ("lt", {"input_col": "l_quantity", "operator": "lt", "value": 10}, "l_quantity < 10"),
    ("le", {"input_col": "l_quantity", "operator": "le", "value": 10}, "l_quantity <= 10"),
    ("gt", {"input_col": "l_quantity", "operator": "gt", "value": 30}, "l_quantity > 30"),
    ("ge", {"input_col": "l_quantity", "operator": "ge", "value": 30}, "l_quantity >= 30"),
    ("compare_col", {"input_col": "o_custkey", "operator": "lt", "compare_col": "o_orderkey"}, "o_custkey < o_orderkey"),
    ("is_null", {"input_col": "l_quantity", "operator": "is_null"}, "l_quantity IS NULL"),
    ("is_not_null", {"input_col": "l_quantity", "operator": "is_not_null"}, "l_quantity IS NOT NULL"),
    ("is_nan", {"input_col": "q", "operator": "is_nan"}, f"coalesce(isnan({_NAN}), false)"),
    ("is_not_nan", {"input_col": "q", "operator": "is_not_nan"}, f"NOT coalesce(isnan({_NAN}), false)"),
    ("contains", {"input_col": "l_returnflag", "operator": "contains", "value": "[AN]"}, "regexp_matches(l_returnflag, '[AN]')"),
    ("starts_with", {"input_col": "l_returnflag", "operator": "starts_with", "value": "R"}, "starts_with(l_returnflag, 'R')"),
    ("ends_with", {"input_col": "o_orderstatus", "operator": "ends_with", "value": "F"}, "ends_with(o_orderstatus, 'F')"),
    ("is_in", {"input_col": "l_returnflag", "operator": "is_in", "value": ["A", "R"]}, "l_returnflag IN ('A', 'R')"),
    ("is_not_in", {"input_col": "l_returnflag", "operator": "is_not_in", "value": ["A", "R"]}, "NOT coalesce(l_returnflag IN ('A', 'R'), false)"),
    ("is_between", {"input_col": "l_quantity", "operator": "is_between", "value": [5, 12]}, "l_quantity BETWEEN 5 AND 12"),
]
_NAN_STEP = When(output_col="q", conditions=[{"input_col": "l_quantity", "operator": "gt", "value": 40, "output_constant": float("nan")}], otherwise_col="l_quantity")
for _name, _args, _sql in _PREDICATES:
    _steps = [_NAN_STEP] if _args["input_col"] == "q" else []
    add(f"filter_{_name}", "orders", _then(*_steps, Filter(**_args), DropColumns(columns="q")), f"SELECT * FROM ({_LEFT_LINES}) WHERE {_sql}")
    if _args["operator"] not in ("ne", "is_not_in", "is_not_null", "is_not_nan"):
        add(
            f"filter_remove_{_name}",
            "orders",
            _then(*_steps, Filter(**_args, perform="remove"), DropColumns(columns="q")),
            f"SELECT * FROM ({_LEFT_LINES}) WHERE NOT coalesce({_sql}, false)",
        )

# DropNulls
add("drop_nulls_any", "orders", _then(DropNulls()), f"SELECT * FROM ({_LEFT_LINES}) WHERE l_quantity IS NOT NULL")
add("drop_nulls_all", "orders", _then(DropNulls(how="all", glob="l_*")), f"SELECT * FROM ({_LEFT_LINES}) WHERE l_quantity IS NOT NULL")
add("drop_nulls_thresh", "orders", _then(DropNulls(thresh=5)), f"SELECT * FROM ({_LEFT_LINES}) WHERE l_quantity IS NOT NULL")
add(
    "drop_nulls_nan",
    "orders",
    _then(_NAN_STEP, DropNulls(columns="q"), DropColumns(columns="q")),
    f"SELECT * FROM ({_LEFT_LINES}) WHERE l_quantity IS NOT NULL AND l_quantity <= 40",
)

# projections
add("select_columns", "lineitem", [SelectColumns(columns=["l_tax", "l_orderkey"], regex="^l_ret", glob="*key")], "SELECT l_tax, l_orderkey, l_returnflag, l_partkey, l_suppkey FROM lineitem")
add("select_startswith", "customer", [SelectColumns(startswith=["c_c", "c_n"])], "SELECT c_custkey, c_name, c_nationkey FROM customer")
add("drop_columns", "lineitem", [DropColumns(regex="date|flag", columns=["l_tax", "no_such_column"])], "SELECT * EXCLUDE (l_shipdate, l_returnflag, l_tax) FROM lineitem")
add("rename_mapping", "nation", [RenameColumns(mapping={"n_name": "n_regionkey", "n_regionkey": "n_name"})], "SELECT n_nationkey, n_name AS n_regionkey, n_regionkey AS n_name FROM nation")
add("rename_lists", "region", [RenameColumns(columns=["r_name"], columns_renamed=["region"])], "SELECT r_regionkey, r_name AS region FROM region")
add("rename_regex", "nation", [RenameColumns(regex_pattern="^n_", regex_replacement="")], "SELECT n_nationkey AS nationkey, n_name AS name, n_regionkey AS regionkey FROM nation")
add(
    "cast_portable",
    "orders",
    [SelectColumns(columns=["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate"]), Cast(cast={"o_orderkey": "str", "o_totalprice": "int", "o_orderstatus": "int32", "o_orderdate": "date"})],
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS o_totalprice, TRY_CAST(o_orderstatus AS INTEGER) AS o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders",
)
add(
    "cast_native",
    "part",
    [SelectColumns(columns=["p_partkey", "p_size", "p_retailprice"]), Cast(cast={"p_retailprice": "decimal(10,2)", "p_size": "int", "p_partkey": "string"}), Cast(cast={"p_retailprice": "double"})],
    "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_size, CAST(CAST(p_retailprice AS DECIMAL(10, 2)) AS DOUBLE) AS p_retailprice FROM part",
)
add(
    "add_literals",
    "region",
    [AddLiterals(data=[{"alias": "n", "value": 3, "cast": "int64"}, {"alias": "s", "value": "x"}, {"alias": "none", "cast": "double"}, {"alias": "r_name", "value": "all"}])],
    "SELECT r_regionkey, 'all' AS r_name, CAST(3 AS BIGINT) AS n, 'x' AS s, CAST(NULL AS DOUBLE) AS none FROM region",
)
add(
    "with_columns_strings",
    "customer",
    [
        SelectColumns(columns=["c_custkey", "c_name", "c_mktsegment"]),
        WithColumns(columns=["c_name", "c_mktsegment"], method="str.to_lowercase", suffix="_low"),
        WithColumns(columns="c_name", method="str.replace_all", args=["[0-9]+", "#"]),
        WithColumns(columns="c_mktsegment", method="str.slice", args=[1, 3], alias="cut"),
    ],
    "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#', 'g') AS c_name, c_mktsegment, lower(c_name) AS c_name_low, lower(c_mktsegment) AS c_mktsegment_low, substr(c_mktsegment, 2, 3) AS cut FROM customer",
)
add(
    "with_columns_numbers",
    "lineitem",
    [
        SelectColumns(columns=["l_orderkey", "l_discount", "l_tax", "l_extendedprice"]),
        WithColumns(columns=["l_discount", "l_tax"], method="round", args=[1]),
        WithColumns(columns="l_extendedprice", method="clip", kwargs={"lower_bound": 1000.0, "upper_bound": 50000.0}, prefix="cut_"),
        WithColumns(glob="nothing*", method="abs"),
    ],
    "SELECT l_orderkey, round(l_discount, 1) AS l_discount, round(l_tax, 1) AS l_tax, l_extendedprice, least(greatest(l_extendedprice, 1000.0), 50000.0)::DOUBLE AS cut_l_extendedprice FROM lineitem",
)
add(
    "with_columns_dates",
    "orders",
    [
        SelectColumns(columns=["o_orderkey", "o_orderdate"]),
        WithColumns(columns="o_orderdate", method="dt.year", alias="y"),
        WithColumns(columns="o_orderdate", method="dt.ordinal_day", alias="d"),
        WithColumns(columns="o_orderdate", method="dt.weekday", alias="w"),
        DropColumns(columns="o_orderdate"),
    ],
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(dayofyear(o_orderdate) AS INTEGER) AS d, CAST(isodow(o_orderdate) AS INTEGER) AS w FROM orders",
)
add(
    "with_columns_cum_sum",
    "orders",
    [
        SelectColumns(columns=["o_orderkey", "o_custkey"]),
        WithColumns(columns="o_orderkey", method="cum_sum", kwargs={"order_by": "o_orderkey", "partition_by": "o_custkey"}, alias="running"),
        WithColumns(columns="o_orderkey", method="rank", args=["min"], kwargs={"order_by": "o_orderkey", "partition_by": "o_custkey"}, alias="place"),
    ],
    "SELECT o_orderkey, o_custkey, CAST(sum(o_orderkey) OVER w AS BIGINT) AS running, CAST(rank() OVER w AS INTEGER) AS place FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
)


def _horizontal(name: str, columns: list[str], function: str, sql: str, **kwargs: Any) -> None:
    add(
        f"horizontal_{name}",
        "orders",
        _then(HorizontalFunction(output_col="out", function=function, columns=columns, kwargs=kwargs or None), SelectColumns(columns=["o_orderkey", "l_quantity", "out"])),
        f"SELECT o_orderkey, l_quantity, {sql} AS out FROM ({_LEFT_LINES})",
    )


_horizontal("coalesce", ["l_returnflag", "o_orderstatus"], "coalesce", "coalesce(l_returnflag, o_orderstatus)")
_horizontal("concat_skip", ["o_orderstatus", "l_returnflag"], "concat_str", "concat_ws('-', o_orderstatus, l_returnflag)", separator="-", ignore_nulls=True)
_horizontal("concat_null", ["o_orderstatus", "l_returnflag"], "concat_str", "o_orderstatus || '-' || l_returnflag", separator="-")
_horizontal("max", ["l_quantity", "l_discount"], "max_horizontal", "greatest(l_quantity, l_discount)")
_horizontal("min", ["l_quantity", "l_discount"], "min_horizontal", "least(l_quantity, l_discount)")
_horizontal("sum", ["l_quantity", "o_totalprice"], "sum_horizontal", "coalesce(l_quantity, 0) + coalesce(o_totalprice, 0)")
_horizontal("mean", ["l_quantity", "o_totalprice"], "mean_horizontal", "(coalesce(l_quantity, 0) + o_totalprice) / (1 + CASE WHEN l_quantity IS NULL THEN 0 ELSE 1 END)")
_horizontal("format", ["o_orderkey", "o_orderstatus"], "format", "'order ' || o_orderkey || ' is ' || o_orderstatus", template="order {} is {}")
add(
    "horizontal_all_any",
    "orders",
    _then(
        SparkColumnMethod(input_column="l_quantity", output_column="big", method="isNotNull"),
        When(output_col="cheap", conditions=[{"input_col": "l_quantity", "operator": "lt", "value": 20, "output_constant": True}], otherwise_constant=False),
        HorizontalFunction(output_col="both", function="all_horizontal", columns=["big", "cheap"]),
        HorizontalFunction(output_col="either", function="any_horizontal", columns=["big", "cheap"], kwargs={"ignore_nulls": True}),
        SelectColumns(columns=["o_orderkey", "l_quantity", "both", "either"]),
    ),
    f"SELECT o_orderkey, l_quantity, coalesce(l_quantity < 20, false) AS both, l_quantity IS NOT NULL AS either FROM ({_LEFT_LINES})",
)
add(
    "math_left_to_right",
    "lineitem",
    [
        MathOperator(
            strategy=[
                {"new_column_name": "net", "strategy": [{"column": "l_extendedprice"}, {"column": "l_tax"}, {"constant": 2}], "operations": ["add", "mul"]},
                {"new_column_name": "ratio", "strategy": [{"column": "l_quantity"}, {"column": "l_discount"}], "operations": ["div"]},
                {"new_column_name": "square", "strategy": [{"column": "l_quantity", "cast": "int"}, {"constant": 2}, {"constant": 1}], "operations": ["pow", "sub"], "cast": "int64"},
            ]
        ),
        SelectColumns(columns=["l_orderkey", "net", "ratio", "square"]),
    ],
    "SELECT l_orderkey, (l_extendedprice + l_tax) * 2 AS net, l_quantity / nullif(l_discount, 0) AS ratio, CAST(pow(l_quantity, 2) - 1 AS BIGINT) AS square FROM lineitem",
)
add(
    "when_tiers",
    "orders",
    _then(
        When(
            output_col="tier",
            conditions=[
                {"input_col": "l_quantity", "operator": "gt", "value": 40, "output_constant": "high"},
                {"input_col": "l_quantity", "operator": "gt", "value": 20, "output_constant": "middle"},
                {"input_col": "l_quantity", "operator": "is_null", "output_col": "o_orderstatus"},
            ],
            otherwise_constant="low",
        )
    ),
    f"SELECT *, CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'middle' WHEN l_quantity IS NULL THEN o_orderstatus ELSE 'low' END AS tier FROM ({_LEFT_LINES})",
)
add(
    "when_cast",
    "customer",
    [SelectColumns(columns=["c_custkey", "c_acctbal"]), When(output_col="v", conditions=[{"input_col": "c_acctbal", "operator": "lt", "value": 0, "output_constant": 0}], otherwise_col="c_acctbal", cast_output="Int64")],
    "SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 0 ELSE CAST(trunc(c_acctbal) AS BIGINT) END AS v FROM customer",
)
add(
    "columns_to_map_to_columns",
    "customer",
    [
        ColumnsToMap(output_column="m", columns=["c_name", "c_nationkey"], cast_values="string", drop_input_columns=True),
        MapToColumns(input_column="m", output_columns=[["c_name", "name"], ["c_nationkey", "nation"], ["none", "none"]]),
        DropColumns(columns="m"),
    ],
    "SELECT c_custkey, c_acctbal, c_mktsegment, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, CAST(NULL AS VARCHAR) AS none FROM customer",
)
add("spark_column_method", "customer", [SparkColumnMethod(input_column="c_name", output_column="seven", method="contains", args=["7"]), SelectColumns(columns=["c_custkey", "seven"])], "SELECT c_custkey, contains(c_name, '7') AS seven FROM customer")
add(
    "spark_sql_function",
    "embeddings",
    [SparkSqlFunction(column="sorted", function="sort_array", args=["embedding"], kwargs={"asc": False}), SparkSqlFunction(column="top", function="element_at", args=["sorted", 1]), SelectColumns(columns=["vec_id", "top"])],
    "SELECT vec_id, list_max(embedding) AS top FROM embeddings",
)

# aggregation
for _agg, _sql in {
    "sum": "round(sum(l_extendedprice), 2)", "mean": "round(avg(l_extendedprice), 4)", "median": "median(l_extendedprice)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)",
    "std": "round(stddev_samp(l_extendedprice), 4)", "var": "round(var_samp(l_extendedprice) / 1e6, 4)", "count": "count(l_extendedprice)", "len": "count(*)", "n_unique": "count(DISTINCT l_extendedprice)",
}.items():
    _after = []
    if _agg == "var":
        _after = [MathOperator(strategy={"new_column_name": "v", "strategy": [{"column": "v"}, {"constant": 1e6}], "operations": ["div"]})]
    if _agg in ("sum", "mean", "std", "var"):
        _after += [WithColumns(columns="v", method="round", args=[2 if _agg == "sum" else 4])]
    add(
        f"groupby_{_agg}",
        "lineitem",
        [GroupBy(groupby_columns=["l_returnflag", "l_linestatus"], aggregations={"agg": _agg, "col": "l_extendedprice", "alias": "v"}), *_after],
        f"SELECT l_returnflag, l_linestatus, {_sql} AS v FROM lineitem GROUP BY ALL",
    )
add(
    "groupby_prefix",
    "lineitem",
    [GroupBy(groupby_regex="flag$", aggregations={"max": ["l_quantity", "l_tax"]}, prefix="max_", suffix="_x")],
    "SELECT l_returnflag, max(l_quantity) AS max_l_quantity_x, max(l_tax) AS max_l_tax_x FROM lineitem GROUP BY 1",
)
add(
    "groupby_first_last",
    "events",
    [GroupBy(groupby_columns="user_id", aggregations=[{"agg": "first", "col": "event_type", "alias": "a", "order_by": "event_id"}, {"agg": "last", "col": "event_type", "alias": "z", "order_by": "event_id"}])],
    "SELECT user_id, arg_min(event_type, event_id) AS a, arg_max(event_type, event_id) AS z FROM events GROUP BY 1",
)
add("assert_count", "region", [AssertCount(expected=5), AssertCount(min_count=1, max_count=10), AssertNotEmpty(), AssertContainsColumns(columns=["r_name"]), PrintSchema()], "SELECT * FROM region")

# joins
_O = "SELECT o_orderkey, o_orderstatus FROM orders"
_W = "SELECT l_orderkey AS o_orderkey, l_returnflag AS o_orderstatus, l_quantity FROM lineitem"


def _join(name: str, sql: str, lines_left: bool = False, **options: Any) -> None:
    """A join of all orders and all lines. Orders without lines are the rows without a match; ``lines_left`` has them on the right."""

    @query(sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Storage()
        left = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
        right = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("o_orderstatus"), "l_quantity")
        if lines_left:
            left, right = right, left
        if "left_on" in options:
            right = right.withColumnRenamed("o_orderkey", "key")
        store.set("right", right)
        return Join(store_key="right", store=store, **options).transform(left)

    QUERIES[f"join_{name}"] = QUERIES.pop("run")
    SQL[f"join_{name}"] = SQL.pop("run")


_BOTH = "l.o_orderkey, l.o_orderstatus, r.o_orderstatus AS o_orderstatus_right, l_quantity"
_LINES = "l.o_orderstatus, l_quantity, r.o_orderstatus AS o_orderstatus_right"
_join("inner", f"SELECT {_BOTH} FROM ({_O}) l JOIN ({_W}) r USING (o_orderkey)", how="inner", on="o_orderkey")
_join("left", f"SELECT {_BOTH} FROM ({_O}) l LEFT JOIN ({_W}) r USING (o_orderkey)", how="left", on="o_orderkey")
_join("full", f"SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, {_LINES} FROM ({_W}) l FULL JOIN ({_O}) r ON l.o_orderkey = r.o_orderkey", lines_left=True, how="full", on="o_orderkey")
_join("full_keys", f"SELECT l.o_orderkey, r.o_orderkey AS key, {_LINES} FROM ({_W}) l FULL JOIN ({_O}) r ON l.o_orderkey = r.o_orderkey", lines_left=True, how="full", left_on="o_orderkey", right_on="key")
_join("full_uncoalesced", f"SELECT l.o_orderkey, r.o_orderkey AS o_orderkey_right, {_LINES} FROM ({_W}) l FULL JOIN ({_O}) r ON l.o_orderkey = r.o_orderkey", lines_left=True, how="full", on="o_orderkey", coalesce_keys=False)
_join("semi", f"SELECT * FROM ({_O}) l SEMI JOIN ({_W}) r USING (o_orderkey)", how="semi", on="o_orderkey")
_join("anti", f"SELECT * FROM ({_O}) l ANTI JOIN ({_W}) r USING (o_orderkey)", how="anti", on="o_orderkey")
_join("right", f"SELECT r.o_orderkey, r.o_orderstatus, l.o_orderstatus AS o_orderstatus_right, l_quantity FROM ({_O}) r LEFT JOIN ({_W}) l USING (o_orderkey)", lines_left=True, how="right", on="o_orderkey")
_join("right_semi", f"SELECT * FROM ({_O}) l SEMI JOIN ({_W}) r USING (o_orderkey)", lines_left=True, how="rightsemi", on="o_orderkey")
_join("right_anti", f"SELECT * FROM ({_O}) l ANTI JOIN ({_W}) r USING (o_orderkey)", lines_left=True, how="right_anti", on="o_orderkey")
_join("different_keys", f"SELECT {_BOTH.replace('_right', '_line')} FROM ({_O}) l JOIN ({_W}) r USING (o_orderkey)", how="inner", left_on="o_orderkey", right_on="key", suffix="_line")


def _hot_join(how: str, sql: str) -> None:
    """Events by kind, where it is one of two that have most of them, else by their own number, with counts of kinds and customers' numbers."""

    @query(sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = Storage()
        events = read_table(spark, sf_dir, "events", ["event_id", "event_type"])
        kinds = events.groupBy(F.col("event_type").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        store.set("right", kinds.unionByName(read_table(spark, sf_dir, "customer").select(F.expr("concat('e', 2 * c_custkey)").alias("k"), F.col("c_custkey").alias("n"))))
        left = events.select("event_id", F.expr("CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE concat('e', event_id) END").alias("k"))
        return Join(store_key="right", how=how, on="k", spread_hot_keys=True, store=store).transform(left)

    QUERIES[f"join_hot_{how}"] = QUERIES.pop("run")
    SQL[f"join_hot_{how}"] = SQL.pop("run")


_HOT = (
    "FROM (SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'e' || event_id END AS k FROM events) l {} JOIN"
    " (SELECT event_type AS k, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'e' || 2 * c_custkey, c_custkey FROM customer) r ON l.k = r.k"
)
_hot_join("inner", f"SELECT event_id, l.k, n {_HOT.format('')}")
_hot_join("left", f"SELECT event_id, l.k, n {_HOT.format('LEFT')}")
_hot_join("full", f"SELECT event_id, coalesce(l.k, r.k) AS k, n {_HOT.format('FULL')}")


@query("SELECT n.*, r.r_regionkey, r.r_name FROM nation n, region r")
def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Storage()
    store.set("regions", read_table(spark, sf_dir, "region"))
    return Join(store_key="regions", how="cross", store=store).transform(read_table(spark, sf_dir, "nation"))


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Storage()
    store.set("nations", read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]))
    joined = Join(store_key="nations", how="inner", left_on="c_nationkey", right_on="n_nationkey", broadcast=True, store=store).transform(read_table(spark, sf_dir, "customer"))
    return joined.select("c_custkey", "c_name", "n_name")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, NULL::BIGINT AS s_suppkey FROM customer UNION ALL SELECT NULL, s_name, s_nationkey, s_acctbal, NULL, s_suppkey FROM supplier")
def append_missing_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Storage()
    store.set("suppliers", RenameColumns(mapping={"s_name": "c_name", "s_nationkey": "c_nationkey", "s_acctbal": "c_acctbal"}).transform(read_table(spark, sf_dir, "supplier")))
    return AppendDataFrame(store_key="suppliers", allow_missing_cols=True, store=store).transform(read_table(spark, sf_dir, "customer"))


# windows
_WIN = {"partition_cols": "user_id", "order_cols": ["ts", "event_id"]}
add(
    "window_rows",
    "events",
    [AggregateOverWindow(**_WIN, rows_between=[-2, 1], aggregations=[{"agg": "sum", "col": "event_id", "alias": "s"}, {"agg": "max", "col": "value", "alias": "m"}, {"agg": "count", "col": "value", "alias": "n"}]), SelectColumns(columns=["event_id", "s", "m", "n"])],
    "SELECT event_id, CAST(sum(event_id) OVER w AS BIGINT) AS s, max(value) OVER w AS m, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)",
)
add(
    "window_range",
    "orders",
    [AggregateOverWindow(partition_cols="o_custkey", order_cols="o_orderkey", range_between=["start", 500], aggregations={"agg": "count", "col": "o_orderkey", "alias": "n"}), SelectColumns(columns=["o_orderkey", "n"])],
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN UNBOUNDED PRECEDING AND 500 FOLLOWING) AS n FROM orders",
)
add(
    "window_descending",
    "events",
    [AggregateOverWindow(**_WIN, ascending=[False, True], rows_between=["start", 0], aggregations=[{"agg": "first", "col": "event_id", "alias": "f"}, {"agg": "last", "col": "event_id", "alias": "l"}]), SelectColumns(columns=["event_id", "f", "l"])],
    "SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
)
add(
    "window_count_distinct",
    "events",
    [AggregateOverWindow(partition_cols="user_id", aggregations=[{"agg": "countDistinct", "col": "event_type", "alias": "kinds"}, {"agg": "min", "col": "value", "alias": "value"}]), SelectColumns(columns=["event_id", "kinds", "value"])],
    "SELECT event_id, kinds, value FROM (SELECT event_id, user_id FROM events) JOIN (SELECT user_id, count(DISTINCT event_type) AS kinds, min(value) AS value FROM events GROUP BY 1) USING (user_id)",
)
add("lag", "events", [LagOverWindow(**_WIN, lag_col="value", lag=1, output_col="before"), SelectColumns(columns=["event_id", "before"])], "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events")
add("lead", "events", [LagOverWindow(**_WIN, lag_col="event_type", lag=-2, output_col="after"), SelectColumns(columns=["event_id", "after"])], "SELECT event_id, lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events")

# reshaping
add(
    "pivot_sum",
    "orders",
    [SelectColumns(columns=["o_orderpriority", "o_orderstatus", "o_orderkey"]), Pivot(pivot_col="o_orderstatus", id_cols="o_orderpriority", aggregate_function="sum", values_cols="o_orderkey")],
    "SELECT o_orderpriority, CAST(sum(o_orderkey) FILTER (o_orderstatus = 'F') AS BIGINT) AS F, CAST(sum(o_orderkey) FILTER (o_orderstatus = 'O') AS BIGINT) AS O, CAST(sum(o_orderkey) FILTER (o_orderstatus = 'P') AS BIGINT) AS P FROM orders GROUP BY 1",
)
add(
    "pivot_several",
    "lineitem",
    [Pivot(pivot_col="l_linestatus", id_cols="l_returnflag", aggregate_function="max", values_cols=["l_quantity", "l_tax"], separator=".")],
    """SELECT l_returnflag, max(l_quantity) FILTER (l_linestatus = 'F') AS "l_quantity.F", max(l_quantity) FILTER (l_linestatus = 'O') AS "l_quantity.O", max(l_tax) FILTER (l_linestatus = 'F') AS "l_tax.F", max(l_tax) FILTER (l_linestatus = 'O') AS "l_tax.O" FROM lineitem GROUP BY 1""",
)
add("pivot_len", "events", [Pivot(pivot_col="event_type", id_cols="user_id", aggregate_function="len", values_cols="value", pivot_values=["click", "view"])], "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
add(
    "unpivot",
    "orders",
    _then(SelectColumns(columns=["o_orderkey", "l_quantity", "l_discount"]), Unpivot(id_cols="o_orderkey", melt_regex="^l_", variable_col="what", value_col="v")),
    f"SELECT o_orderkey, 'l_quantity' AS what, l_quantity AS v FROM ({_LEFT_LINES}) UNION ALL SELECT o_orderkey, 'l_discount', l_discount FROM ({_LEFT_LINES})",
)
add("unpivot_mixed", "nation", [Unpivot(id_cols="n_nationkey", melt_cols=["n_name", "n_regionkey"])], "SELECT n_nationkey, 'n_name' AS variable, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', CAST(n_regionkey AS VARCHAR) FROM nation")
add("explode_array", "embeddings", [SparkExplode(input_col="embedding", output_cols="x", drop_after=True)], "SELECT vec_id, label, unnest(embedding) AS x FROM embeddings")
add(
    "explode_map",
    "supplier",
    [ColumnsToMap(output_column="m", columns=["s_name", "s_acctbal"]), SparkExplode(input_col="m", output_cols=["k", "v"], drop_after=True), SelectColumns(columns=["s_suppkey", "k", "v"])],
    "SELECT s_suppkey, 's_name' AS k, s_name AS v FROM supplier UNION ALL SELECT s_suppkey, 's_acctbal', CAST(s_acctbal AS VARCHAR) FROM supplier",
)

# whole frames
add("sort_head", "orders", [DataFrameMethod(method="sort", args=[["o_orderstatus", "o_orderkey"]], kwargs={"descending": [True, False]}), DataFrameMethod(method="head", args=[100])], "SELECT * FROM orders ORDER BY o_orderstatus DESC, o_orderkey LIMIT 100")
add("unique", "customer", [SelectColumns(columns=["c_nationkey", "c_mktsegment"]), DataFrameMethod(method="unique")], "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
add("top_k", "part", [DataFrameMethod(method="bottom_k", args=[7], kwargs={"by": ["p_size", "p_partkey"]})], "SELECT * FROM part ORDER BY p_size, p_partkey LIMIT 7")
add("drop_duplicates", "events", [SelectColumns(columns=["user_id", "event_type"]), SparkDropDuplicates()], "SELECT DISTINCT user_id, event_type FROM events")
add("dedup_subset", "events", [SelectColumns(columns=["event_id", "value", "user_id", "event_type"]), SparkDropDuplicates(columns=["user_id", "event_type"])], "SELECT user_id, event_type, max(event_id) AS event_id, max(value) AS value FROM events GROUP BY 1, 2")
add("repartition", "part", [Repartition(num_partitions=7, columns="p_brand"), CoalescePartitions(num_partitions=2), Repartition(rows_per_partition=500), LogDataSkew(), Persist(), Cache()], "SELECT * FROM part")
add("cpu_info", "region", [CpuInfo(n_partitions=4)], "SELECT * FROM region")
add("sample", "part", [DataFrameMethod(method="sample", kwargs={"n": 50, "seed": 3}), AddLiterals(data=[{"alias": "one", "value": 1, "cast": "int64"}]), GroupBy(groupby_columns="one", aggregations={"agg": "len", "col": "p_partkey", "alias": "n"})], "SELECT CAST(1 AS BIGINT) AS one, CAST(50 AS BIGINT) AS n")


@query("SELECT e.event_id, o.event_id AS event_id_right FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) = 1) o ON e.user_id = o.user_id AND e.ts >= o.ts")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view of each purchase's user before it."""
    events = read_table(spark, sf_dir, "events", ["event_id", "user_id", "ts", "event_type"])
    views = events.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.min("event_id").alias("event_id"))
    step = DataFrameMethod(method="join_asof", args=[views], kwargs={"on": "ts", "by": "user_id"})
    return step.transform(events.filter("event_type = 'purchase'")).select("event_id", "event_id_right")


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def cast_schema_compare_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The utilities: schemas, comparison, hashes and deduplication agree with each other."""
    df = read_table(spark, sf_dir, "customer")
    compare_dfs(df, cast_to_schema(df.select(*[F.col(c).cast("string").alias(c) for c in reversed(df.columns)]), df.schema))
    hashed = drop_duplicates_no_randomness(hash_dataframe(df, "xxhash64", "h"), "h")
    return hashed.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


# pipelines
def _halves(df: DataFrame) -> dict[str, DataFrame]:
    return {"low": df.filter("c_acctbal < 0"), "high": df.filter("NOT coalesce(c_acctbal < 0, false)")}


_CUST = [SelectColumns(columns=["c_custkey", "c_acctbal"])]
add(
    "split_union",
    "customer",
    {"low": [AddLiterals(data=[{"alias": "side", "value": "low"}])], "high": [AddLiterals(data=[{"alias": "side", "value": "high"}])]},
    "SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'low' ELSE 'high' END AS side FROM customer",
    split_function=_halves,
    split_apply_after_splitting=_CUST,
)
add(
    "split_no_merge",
    "customer",
    {"low": [{"store": "low"}], "high": [MathOperator(strategy={"new_column_name": "c_acctbal", "strategy": [{"column": "c_acctbal"}, {"constant": 2}], "operations": ["mul"]})]},
    "SELECT c_custkey, c_acctbal * 2 AS c_acctbal FROM customer WHERE c_acctbal >= 0",
    split_function=_halves,
    split_apply_before_appending=_CUST,
    splits_no_merge="low",
    splits_skip_if_empty=["high"],
)
add(
    "split_cast_back",
    "customer",
    {"low": [Cast(cast={"c_acctbal": "string"})], "high": []},
    "SELECT * FROM customer",
    split_function=_halves,
    cast_subsets_to_input_schema=True,
    coalesce_output_to_original=True,
)
add(
    "branch_append",
    "nation",
    [Filter(input_col="n_regionkey", operator="eq", value=1), AddLiterals(data=[{"alias": "n_name", "value": "again"}])],
    "SELECT * FROM nation UNION ALL SELECT n_nationkey, 'again', n_regionkey FROM nation WHERE n_regionkey = 1",
    branch={"end": "append"},
)
add(
    "branch_join",
    "orders",
    [GroupBy(groupby_columns="o_custkey", aggregations=[{"agg": "count", "col": "o_orderkey", "alias": "orders"}])],
    "SELECT o_orderkey, o_custkey, orders FROM orders JOIN (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) USING (o_custkey)",
    branch={"end": "join", "how": "inner", "on": "o_custkey"},
    otherwise=[SelectColumns(columns=["o_orderkey", "o_custkey"])],
)


def _dead_end(spark: SparkSession, sf_dir: str, store: Storage) -> list:
    side = TransformerPipeline([Filter(input_col="r_regionkey", operator="gt", value=2), {"store": "side"}], branch={"end": "dead-end"}, store=store)
    return [side, {"store": "main"}, {"from_store": "side"}, {"clear_except": ["main"]}]


add("branch_dead_end", "region", _dead_end, "SELECT * FROM region WHERE r_regionkey > 2")
add(
    "apply_to_rows",
    "orders",
    [SelectColumns(columns=["o_orderkey", "o_totalprice"]), MathOperator(strategy={"new_column_name": "o_totalprice", "strategy": [{"column": "o_totalprice"}, {"constant": 2}], "operations": ["div"]})],
    "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice / 2 ELSE 0.0 END AS o_totalprice FROM orders",
    apply_to_rows={"input_col": "o_totalprice", "operator": "gt", "value": 100000},
    otherwise=[SelectColumns(columns=["o_orderkey"]), AddLiterals(data=[{"alias": "o_totalprice", "value": 0.0}])],
)
add(
    "apply_to_rows_nulls",
    "orders",
    lambda spark, sf_dir, store: [
        *_orders_and_lines(spark, sf_dir, store),
        TransformerPipeline([AddLiterals(data=[{"alias": "kind", "value": "much"}])], apply_to_rows={"input_col": "l_quantity", "operator": "ge", "value": 25}, allow_missing_columns=True),
    ],
    f"SELECT *, CASE WHEN l_quantity >= 25 THEN 'much' END AS kind FROM ({_LEFT_LINES})",
)
add("apply_to_rows_dead_end", "part", [AssertNotEmpty()], "SELECT * FROM part WHERE p_size >= 10", apply_to_rows={"input_col": "p_size", "operator": "lt", "value": 10, "dead-end": True})
add(
    "nested_interleaved",
    "nation",
    [TransformerPipeline([Filter(input_col="n_regionkey", operator="ne", value=0), RenameColumns(mapping={"n_name": "name"})], name="inner"), lambda df: df.withColumn("twice", F.col("n_nationkey") * 2), ["to_native", None]],
    "SELECT n_nationkey, n_name AS name, n_regionkey, n_nationkey * 2 AS twice FROM nation WHERE n_regionkey <> 0",
    interleaved=[AssertNotEmpty()],
    append_interleaved=True,
)


@query("SELECT *, 1::BIGINT AS a_1, 2::BIGINT AS a_2, 1::BIGINT AS b_1, 2::BIGINT AS b_2, 'low' AS kind FROM region WHERE r_regionkey < 3")
def config_loop_lazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration with a loop, a lazy parameter and a named function."""
    store = Storage()
    config = {
        "name": "from configuration",
        "pipeline": [
            {"loop": {"mode": "product", "values": {"c": ["a", "b"], "n": [1, 2]}, "transformer": "AddLiterals", "params": {"data": [{"alias": "<<c>>_<<n>>", "value": "<<n>>", "cast": "int64"}]}}},
            {"function": "remember", "kwargs": {"limit": 3}},
            {"transformer": "Filter", "lazy": True, "params": {"input_col": "r_regionkey", "operator": "lt", "value": "__ns__limit"}},
            {"transformer": "DropNulls", "skip": True},
            {"pipeline": [{"transformer": "AddLiterals", "params": {"data": [{"alias": "kind", "value": "low"}]}}], "name": "inner"},
        ],
    }

    def remember(df: DataFrame, limit: int) -> DataFrame:
        store.set("limit", limit)
        return df

    return load_pipeline(config, extra_functions=remember, store=store).run(read_table(spark, sf_dir, "region"), verbose=False)


# whole queries
@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
    round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def q1_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by flag and status."""
    math = lambda name, *parts: {"new_column_name": name, "strategy": list(parts[::2]), "operations": list(parts[1::2])}
    minus, plus = {"constant": -1}, {"constant": 1}
    aggs = [("sum", "l_quantity", "sum_qty"), ("sum", "l_extendedprice", "sum_base"), ("sum", "disc", "sum_disc"), ("sum", "charge", "sum_charge"), ("mean", "l_quantity", "avg_qty"), ("mean", "l_discount", "avg_disc"), ("len", "l_tax", "n")]
    steps = [
        lambda df: df.filter("l_shipdate <= timestamp_ntz '1998-09-02'"),
        MathOperator(
            strategy=[
                math("disc", {"column": "l_discount"}, "mul", minus, "add", plus, "mul", {"column": "l_extendedprice"}),
                math("up", {"column": "l_tax"}, "add", plus),
            ]
        ),
        MathOperator(strategy=math("charge", {"column": "disc"}, "mul", {"column": "up"})),
        GroupBy(groupby_columns=["l_returnflag", "l_linestatus"], aggregations=[{"agg": a, "col": c, "alias": n} for a, c, n in aggs]),
        WithColumns(startswith="sum_", method="round", args=[2]),
        WithColumns(startswith="avg_", method="round", args=[4]),
    ]
    return TransformerPipeline(steps, name="q1").run(read_table(spark, sf_dir, "lineitem"), verbose=False)


@query(
    """SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2"""
)
def q3_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue of the orders of one segment."""
    store = Storage()
    store.set("orders", read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]))
    store.set("lines", read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_extendedprice", "l_discount"]))
    steps = [
        Filter(input_col="c_mktsegment", operator="eq", value="BUILDING"),
        SelectColumns(columns=["c_custkey"]),
        Join(store_key="orders", how="inner", left_on="c_custkey", right_on="o_custkey", store=store),
        Join(store_key="lines", how="inner", left_on="o_orderkey", right_on="l_orderkey", store=store),
        RenameColumns(mapping={"o_orderkey": "l_orderkey"}),
        MathOperator(strategy={"new_column_name": "revenue", "strategy": [{"column": "l_discount"}, {"constant": -1}, {"constant": 1}, {"column": "l_extendedprice"}], "operations": ["mul", "add", "mul"]}),
        GroupBy(groupby_columns=["l_orderkey", "o_orderdate"], aggregations=[{"agg": "sum", "col": "revenue", "alias": "revenue"}]),
        WithColumns(columns="revenue", method="round", args=[4]),
    ]
    return TransformerPipeline(steps, store=store).run(read_table(spark, sf_dir, "customer"), verbose=False)


@query(
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1"""
)
def q5_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation of one region, where customer and supplier share the nation. Small tables first, so that lines are joined with few rows."""
    store = Storage()
    for name, columns in {"customer": ["c_custkey", "c_nationkey"], "orders": ["o_orderkey", "o_custkey"], "supplier": ["s_suppkey", "s_nationkey"], "nation": None, "region": None}.items():
        store.set(name, read_table(spark, sf_dir, name, columns))
    nations = TransformerPipeline([{"from_store": "region"}, Filter(input_col="r_name", operator="eq", value="ASIA"), Join(store_key="nation", how="inner", left_on="r_regionkey", right_on="n_regionkey", store=store), SelectColumns(columns=["n_nationkey", "n_name"]), {"store": "asia"}], store=store)
    steps = [
        SelectColumns(columns=["l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"]),
        Join(store_key="supplier", how="inner", left_on="l_suppkey", right_on="s_suppkey", store=store),
        Join(store_key="asia", how="inner", left_on="s_nationkey", right_on="n_nationkey", store=store),
        Join(store_key="orders", how="inner", left_on="l_orderkey", right_on="o_orderkey", store=store),
        Join(store_key="customer", how="inner", left_on=["o_custkey", "s_nationkey"], right_on=["c_custkey", "c_nationkey"], store=store),
        MathOperator(strategy={"new_column_name": "revenue", "strategy": [{"column": "l_discount"}, {"constant": -1}, {"constant": 1}, {"column": "l_extendedprice"}], "operations": ["mul", "add", "mul"]}),
        GroupBy(groupby_columns="n_name", aggregations=[{"agg": "sum", "col": "revenue", "alias": "revenue"}]),
        WithColumns(columns="revenue", method="round", args=[4]),
    ]
    lines = read_table(spark, sf_dir, "lineitem")
    nations.run(lines, verbose=False)
    return TransformerPipeline(steps, store=store).run(lines, verbose=False)


def _methods(name: str, table: str, sql: str, *steps: tuple, windows: str = "") -> None:
    """A query of column methods, each (column, method, alias, arguments, keywords) after the others; columns with a name of one letter and a digit are only on the way."""
    made = [WithColumns(columns=c, method=m, alias=a, args=list(args), kwargs=kwargs or None) for c, m, a, args, kwargs in steps]
    out = [a for _, _, a, _, _ in steps if not a[-1].isdigit()]
    key = {"customer": "c_custkey", "orders": "o_orderkey", "events": "event_id", "embeddings": "vec_id"}[table]
    add(f"methods_{name}", table, [*made, SelectColumns(columns=[key, *out])], f"SELECT {key}, {sql} FROM {table} {windows}")


def _m(c: str, method: str, alias: str, *args: Any, **kwargs: Any) -> tuple:
    return c, method, alias, args, kwargs


_methods(
    "math",
    "customer",
    "floor(c_acctbal)::BIGINT AS low, ceil(c_acctbal)::BIGINT AS high, round(sqrt(abs(c_acctbal)), 6) AS root, sign(c_acctbal)::DOUBLE AS side, pow(c_acctbal, 2) AS squared,"
    " CASE WHEN c_acctbal < 0 THEN 0.0 WHEN c_acctbal > 5000 THEN 5000.0 ELSE c_acctbal END AS clipped, isfinite(c_acctbal) AS finite, round(sin(c_acctbal), 6) AS s, round(cos(c_acctbal), 6) AS c,"
    " CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS code",
    _m("c_acctbal", "floor", "low"),
    _m("c_acctbal", "ceil", "high"),
    _m("c_acctbal", "abs", "a1"),
    _m("a1", "sqrt", "a2"),
    _m("a2", "round", "root", 6),
    _m("c_acctbal", "sign", "side"),
    _m("c_acctbal", "pow", "squared", 2),
    _m("c_acctbal", "clip", "clipped", 0.0, 5000.0),
    _m("c_acctbal", "is_finite", "finite"),
    _m("c_acctbal", "sin", "s1"),
    _m("s1", "round", "s", 6),
    _m("c_acctbal", "cos", "c1"),
    _m("c1", "round", "c", 6),
    _m("c_mktsegment", "replace_strict", "code", {"BUILDING": 1, "MACHINERY": 2}, default=0),
)
_methods(
    "text",
    "customer",
    "upper(c_name) AS up, regexp_replace(c_name, '([a-z])([a-z])', '\\2\\1') AS swapped, starts_with(c_name, 'Cust') AS begins, ends_with(c_name, '7') AS ends, length(c_name)::INTEGER AS chars, strlen(c_name)::INTEGER AS bytes,"
    " ltrim(c_name, 'Cu') AS cut, rtrim(c_name, '0123456789') AS word, upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) AS title, split_part(c_name, '#', 1) AS first_part, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded",
    _m("c_name", "str.to_uppercase", "up"),
    _m("c_name", "str.replace", "swapped", "([a-z])([a-z])", "$2$1"),
    _m("c_name", "str.starts_with", "begins", "Cust"),
    _m("c_name", "str.ends_with", "ends", "7"),
    _m("c_name", "str.len_chars", "chars"),
    _m("c_name", "str.len_bytes", "bytes"),
    _m("c_name", "str.strip_chars_start", "cut", "Cu"),
    _m("c_name", "str.strip_chars_end", "word", "0123456789"),
    _m("c_mktsegment", "str.to_titlecase", "title"),
    _m("c_name", "str.split", "p1", "#"),
    _m("p1", "list.get", "first_part", 0),
    _m("c_nationkey", "cast", "n1", "string"),
    _m("n1", "str.zfill", "padded", 4),
)
_methods(
    "dates",
    "orders",
    "CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month_start, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS week_start, CAST(make_date(year(o_orderdate) - year(o_orderdate) % 2, 1, 1) AS TIMESTAMP) AS two_years,"
    " strftime(o_orderdate, '%d.%m.%Y') AS german, CAST(o_orderdate AS DATE) AS back, CAST(o_orderdate AS TIMESTAMP) AS back_time, CAST(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 MONTH - INTERVAL 0 DAY AS TIMESTAMP) AS later,"
    " CAST(quarter(o_orderdate) AS INTEGER) AS q, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(week(o_orderdate) AS INTEGER) AS w, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS ms",
    _m("o_orderdate", "dt.truncate", "month_start", "1mo"),
    _m("o_orderdate", "dt.truncate", "week_start", "1w"),
    _m("o_orderdate", "dt.truncate", "two_years", "2y"),
    _m("o_orderdate", "dt.to_string", "german", "%d.%m.%Y"),
    _m("german", "str.to_date", "back", "%d.%m.%Y"),
    _m("german", "str.to_datetime", "back_time", "%d.%m.%Y"),
    _m("o_orderdate", "dt.offset_by", "later", "1mo"),
    _m("o_orderdate", "dt.quarter", "q"),
    _m("o_orderdate", "dt.month", "m"),
    _m("o_orderdate", "dt.day", "d"),
    _m("o_orderdate", "dt.week", "w"),
    _m("o_orderdate", "dt.timestamp", "ms", "ms"),
)
_ROWS = {"order_by": "event_id", "partition_by": "user_id"}
_methods(
    "windows",
    "events",
    "CASE WHEN count(value) OVER w >= 3 THEN round(avg(value) OVER w, 7) END AS mean, CASE WHEN count(value) OVER w >= 1 THEN CAST(sum(event_id) OVER w AS BIGINT) END AS total,"
    " rank() OVER k + (count(*) OVER (PARTITION BY user_id, event_type) - 1) / 2 AS place, CAST(rank() OVER k + count(*) OVER (PARTITION BY user_id, event_type) - 1 AS BIGINT) AS last_place,"
    " event_id - lag(event_id) OVER o AS gap, max(value) OVER c AS highest, min(value) OVER c AS lowest, count(*) OVER (PARTITION BY event_type) = 1 AS only,"
    " CASE WHEN count(value) OVER w >= 3 THEN max(value) OVER w END AS top",
    _m("value", "rolling_mean", "m1", 3, **_ROWS),
    _m("m1", "round", "mean", 7),
    _m("event_id", "rolling_sum", "total", 3, min_samples=1, **_ROWS),
    _m("event_type", "rank", "place", partition_by="user_id"),
    _m("event_type", "rank", "last_place", "max", partition_by="user_id"),
    _m("event_id", "diff", "gap", **_ROWS),
    _m("value", "cum_max", "highest", **_ROWS),
    _m("value", "cum_min", "lowest", **_ROWS),
    _m("event_type", "is_unique", "only"),
    _m("value", "rolling_max", "top", 3, **_ROWS),
    windows="WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), c AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
    " o AS (PARTITION BY user_id ORDER BY event_id), k AS (PARTITION BY user_id ORDER BY event_type)",
)
_methods(
    "lists",
    "embeddings",
    "CAST(len(embedding) AS INTEGER) AS n, list_max(embedding) AS most, list_min(embedding) AS least, embedding[2] AS second, list_sort(embedding, 'DESC')[1] AS top",
    _m("embedding", "list.len", "n"),
    _m("embedding", "list.max", "most"),
    _m("embedding", "list.min", "least"),
    _m("embedding", "list.get", "second", 1),
    _m("embedding", "list.unique", "u1"),
    _m("u1", "list.len", "u2"),
    _m("embedding", "list.sort", "s1", descending=True),
    _m("s1", "list.get", "top", 0),
)
add(
    "window_statistics",
    "events",
    [
        AggregateOverWindow(**_WIN, rows_between=[-3, 0], aggregations=[{"agg": a, "col": "value", "alias": a} for a in ("avg", "mean", "stddev", "variance", "collect_list")]),
        AggregateOverWindow(partition_cols="user_id", aggregations=[{"agg": "collect_set", "col": "event_type", "alias": "kinds"}]),
        SparkSqlFunction(column="kinds", function="array_sort", args=["kinds"]),
        SparkSqlFunction(column="kinds", function="array_join", args=["kinds"], kwargs={"delimiter": ","}),
        SparkSqlFunction(column="n", function="size", args=["collect_list"]),
        WithColumns(columns=["avg", "mean", "stddev", "variance"], method="round", args=[7]),
        SelectColumns(columns=["event_id", "avg", "mean", "stddev", "variance", "n", "kinds"]),
    ],
    "SELECT event_id, round(avg(value) OVER w, 7) AS avg, round(avg(value) OVER w, 7) AS mean, round(stddev_samp(value) OVER w, 7) AS stddev, round(var_samp(value) OVER w, 7) AS variance, CAST(count(value) OVER w AS INTEGER) AS n, kinds FROM events"
    " JOIN (SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS kinds FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IS NOT NULL) GROUP BY 1) USING (user_id)"
    " WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)",
)
for _agg, _sql in (("min", "min(l_quantity)"), ("mean", "avg(l_quantity)"), ("median", "median(l_quantity)")):
    add(
        f"pivot_{_agg}",
        "lineitem",
        [SelectColumns(columns=["l_returnflag", "l_linestatus", "l_quantity"]), Pivot(pivot_col="l_linestatus", id_cols="l_returnflag", aggregate_function=_agg, values_cols="l_quantity"), WithColumns(columns=["F", "O"], method="round", args=[6])],
        "SELECT l_returnflag, " + ", ".join(f"round({_sql} FILTER (l_linestatus = '{x}'), 6) AS {x}" for x in "FO") + " FROM lineitem GROUP BY 1",
    )
for _agg in ("first", "last"):  # one row a cell, so that the order does not matter
    add(f"pivot_{_agg}", "nation", [Pivot(pivot_col="n_regionkey", id_cols="n_nationkey", aggregate_function=_agg, values_cols="n_name")], "SELECT n_nationkey, " + ", ".join(f"any_value(n_name) FILTER (n_regionkey = {r}) AS \"{r}\"" for r in range(5)) + " FROM nation GROUP BY 1")
add("frame_tail", "orders", [SelectColumns(columns=["o_orderkey", "o_totalprice"]), DataFrameMethod(method="tail", args=[7], kwargs={"by": "o_orderkey"})], "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 7")
add("frame_rename", "region", [DataFrameMethod(method="rename", args=[{"r_name": "name"}]), SelectColumns(columns=["r_regionkey", "name"])], "SELECT r_regionkey, r_name AS name FROM region")
add("frame_explode", "embeddings", [SelectColumns(columns=["vec_id", "embedding"]), DataFrameMethod(method="explode", args=["embedding"])], "SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
add("frame_null_count", "orders", [SelectColumns(columns=["o_orderkey", "o_custkey"]), DataFrameMethod(method="null_count")], "SELECT count_if(o_orderkey IS NULL) AS o_orderkey, count_if(o_custkey IS NULL) AS o_custkey FROM orders")
add("frame_filter", "orders", [SelectColumns(columns=["o_orderkey", "o_custkey"]), DataFrameMethod(method="filter", args=["o_orderkey > 100", "o_custkey < 50"])], "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 AND o_custkey < 50")


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    for name in ("md5", "sha1", "sha2"):
        df = hash_dataframe(df, name, f"h_{name}") if name == "md5" else df.withColumn(f"h_{name}", hash_dataframe(df.select("n_nationkey", "n_name"), name, return_func=True))
    return df


QUERIES["hash_values"] = _hashes
SQL["hash_values"] = "SELECT n_nationkey, n_name, md5(n_name || '-' || n_nationkey) AS h_md5, sha1(n_name || '-' || n_nationkey) AS h_sha1, sha256(n_name || '-' || n_nationkey) AS h_sha2 FROM nation"


def _from_storage(spark: SparkSession, sf_dir: str, store: Storage) -> list:
    store.set("nations", read_table(spark, sf_dir, "nation"))
    side = TransformerPipeline([Filter(input_col="n_regionkey", operator="eq", value=1), SelectColumns(columns=["n_nationkey", "n_regionkey"])], branch={"storage": "nations", "end": "join", "how": "inner", "left_on": "r_regionkey", "right_on": "n_regionkey"}, store=store)
    return [SelectColumns(columns=["r_regionkey", "r_name"]), side, {"store": "joined"}, {"clear": ["nations"]}, SelectColumns(columns=["r_regionkey", "r_name", "n_nationkey"])]


add("branch_from_storage", "region", _from_storage, "SELECT r_regionkey, r_name, n_nationkey FROM region JOIN nation ON r_regionkey = n_regionkey WHERE n_regionkey = 1")


# orders of all rows, without a partition
_KEY = {"order_by": "o_orderkey"}
_ORDER_FRAMES = (
    " WINDOW o AS (ORDER BY o_orderkey), five AS (ORDER BY o_orderkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), upto AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
    " since AS (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), c AS (ORDER BY o_custkey), d AS (ORDER BY o_orderdate)"
)
_methods(
    "ordered",
    "orders",
    "CAST(sum(o_custkey) OVER upto AS BIGINT) AS running, max(o_totalprice) OVER upto AS highest, count(*) OVER upto AS seen, lag(o_custkey) OVER o AS before, lead(o_custkey, 2) OVER o AS later, o_custkey - lag(o_custkey, 3) OVER o AS gap,"
    " CASE WHEN count(*) OVER five = 5 THEN max(o_totalprice) OVER five END AS top, CASE WHEN count(*) OVER five = 5 THEN round(avg(o_totalprice) OVER five, 6) END AS mean",
    _m("o_custkey", "cum_sum", "running", **_KEY),
    _m("o_totalprice", "cum_max", "highest", **_KEY),
    _m("o_orderkey", "cum_count", "seen", **_KEY),
    _m("o_custkey", "shift", "before", **_KEY),
    _m("o_custkey", "shift", "later", -2, **_KEY),
    _m("o_custkey", "diff", "gap", 3, **_KEY),
    _m("o_totalprice", "rolling_max", "top", 5, **_KEY),
    _m("o_totalprice", "rolling_mean", "m1", 5, **_KEY),
    _m("m1", "round", "mean", 6),
    windows=_ORDER_FRAMES,
)
_methods(
    "ranks",
    "orders",
    "rank() OVER c + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2 AS middle, rank() OVER d AS low, rank() OVER d + count(*) OVER (PARTITION BY o_orderdate) - 1 AS high, dense_rank() OVER c AS dense, row_number() OVER o AS number,"
    " row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS new_one, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS last_one, count(*) OVER (PARTITION BY o_orderdate) > 1 AS again",
    _m("o_custkey", "rank", "middle"),
    _m("o_orderdate", "rank", "low", "min"),
    _m("o_orderdate", "rank", "high", "max"),
    _m("o_custkey", "rank", "dense", "dense"),
    _m("o_orderkey", "rank", "number", "ordinal"),
    _m("o_custkey", "is_first_distinct", "new_one", **_KEY),
    _m("o_custkey", "is_last_distinct", "last_one", **_KEY),
    _m("o_orderdate", "is_duplicated", "again"),
    windows=_ORDER_FRAMES,
)
add(
    "fill_missing",
    "orders",
    _then(
        WithColumns(columns="l_quantity", method="fill_null", args=[0.0], alias="nought"),
        WithColumns(columns="l_returnflag", method="fill_null", kwargs={"strategy": "forward", "order_by": ["o_orderkey", "l_quantity", "l_discount", "l_returnflag"]}, alias="carried"),
        WithColumns(columns="l_returnflag", method="fill_null", kwargs={"strategy": "backward", "order_by": ["o_orderkey", "l_quantity", "l_discount", "l_returnflag"]}, alias="ahead"),
        _NAN_STEP,
        WithColumns(columns="q", method="fill_nan", args=[-1.0]),
        SelectColumns(columns=["o_orderkey", "l_quantity", "l_discount", "l_returnflag", "nought", "carried", "ahead", "q"]),
    ),
    "SELECT o_orderkey, l_quantity, l_discount, l_returnflag, coalesce(l_quantity, 0.0) AS nought, last_value(l_returnflag IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried,"
    " first_value(l_returnflag IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead, CASE WHEN l_quantity > 40 THEN -1.0 ELSE l_quantity END AS q"
    f" FROM ({_LEFT_LINES}) WINDOW w AS (ORDER BY o_orderkey, l_quantity NULLS FIRST, l_discount NULLS FIRST, l_returnflag NULLS FIRST)",
)
add(
    "window_all_rows",
    "orders",
    [
        AggregateOverWindow(order_cols="o_orderkey", rows_between=[-3, 2], aggregations=[{"agg": "sum", "col": "o_custkey", "alias": "s"}, {"agg": "min", "col": "o_totalprice", "alias": "m"}, {"agg": "countDistinct", "col": "o_orderpriority", "alias": "kinds"}]),
        AggregateOverWindow(order_cols="o_orderkey", rows_between=["start", -2], aggregations=[{"agg": "count", "col": "o_custkey", "alias": "n"}, {"agg": "avg", "col": "o_custkey", "alias": "mean"}, {"agg": "last", "col": "o_custkey", "alias": "z"}]),
        AggregateOverWindow(order_cols="o_orderkey", rows_between=[0, "end"], aggregations=[{"agg": "stddev", "col": "o_totalprice", "alias": "spread"}, {"agg": "first", "col": "o_custkey", "alias": "a"}]),
        WithColumns(columns="mean", method="round", args=[6]),
        WithColumns(columns="spread", method="round", args=[3]),
        SelectColumns(columns=["o_orderkey", "s", "m", "kinds", "n", "mean", "z", "spread", "a"]),
    ],
    "SELECT o_orderkey, CAST(sum(o_custkey) OVER w AS BIGINT) AS s, min(o_totalprice) OVER w AS m, count(DISTINCT o_orderpriority) OVER w AS kinds, count(*) OVER p AS n, round(avg(o_custkey) OVER p, 6) AS mean, lag(o_custkey, 2) OVER o AS z,"
    " round(stddev_samp(o_totalprice) OVER f, 3) AS spread, o_custkey AS a FROM orders WINDOW o AS (ORDER BY o_orderkey), w AS (ORDER BY o_orderkey ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING),"
    " p AS (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING), f AS (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
)
add(
    "window_all_peers",
    "orders",
    [
        AggregateOverWindow(order_cols="o_orderdate", aggregations=[{"agg": "sum", "col": "o_custkey", "alias": "s"}, {"agg": "count", "col": "o_orderkey", "alias": "n"}, {"agg": "countDistinct", "col": "o_custkey", "alias": "customers"}]),
        AggregateOverWindow(order_cols="o_orderdate", range_between=[0, "end"], aggregations={"agg": "max", "col": "o_totalprice", "alias": "m"}),
        LagOverWindow(lag_col="o_custkey", lag=1, output_col="next", order_cols="o_orderkey", ascending=False),
        SelectColumns(columns=["o_orderkey", "s", "n", "customers", "m", "next"]),
    ],
    "SELECT o_orderkey, CAST(sum(o_custkey) OVER w AS BIGINT) AS s, count(*) OVER w AS n, count(DISTINCT o_custkey) OVER w AS customers, max(o_totalprice) OVER f AS m, lead(o_custkey) OVER (ORDER BY o_orderkey) AS next FROM orders"
    " WINDOW w AS (ORDER BY o_orderdate), f AS (ORDER BY o_orderdate RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
)
add(
    "window_distinct_frames",
    "events",
    [
        AggregateOverWindow(**_WIN, rows_between=[-4, 1], aggregations={"agg": "countDistinct", "col": "event_type", "alias": "near"}),
        AggregateOverWindow(**_WIN, rows_between=["start", 0], aggregations={"agg": "countDistinct", "col": "event_type", "alias": "so_far"}),
        AggregateOverWindow(**_WIN, rows_between=[2, "end"], aggregations={"agg": "countDistinct", "col": "event_type", "alias": "later"}),
        SelectColumns(columns=["event_id", "near", "so_far", "later"]),
    ],
    "SELECT event_id, count(DISTINCT event_type) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 FOLLOWING) AS near, count(DISTINCT event_type) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far,"
    " count(DISTINCT event_type) OVER (w ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
add("frame_row_index", "customer", [SelectColumns(columns=["c_custkey", "c_acctbal"]), DataFrameMethod(method="with_row_index", args=["n"], kwargs={"order_by": ["c_acctbal", "c_custkey"]})], "SELECT row_number() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS n, c_custkey, c_acctbal FROM customer")
add("frame_unique_none", "part", [SelectColumns(columns=["p_partkey", "p_size", "p_brand"]), DataFrameMethod(method="unique", args=[["p_size", "p_brand"]], kwargs={"keep": "none"})], "SELECT p_partkey, p_size, p_brand FROM part QUALIFY count(*) OVER (PARTITION BY p_size, p_brand) = 1")


def _purchases_and_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All purchases, and the first view of each time."""
    events = read_table(spark, sf_dir, "events", ["event_id", "ts", "event_type"])
    views = events.filter("event_type = 'view'").groupBy("ts").agg(F.min("event_id").alias("event_id"))
    return events.filter("event_type = 'purchase'"), views


_P, _V = "(SELECT * FROM events WHERE event_type = 'purchase')", "(SELECT ts, min(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1)"


@query(f"SELECT e.event_id, o.event_id AS event_id_right FROM {_P} e ASOF LEFT JOIN {_V} o ON e.ts >= o.ts")
def join_asof_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view, by anyone, before each purchase: no key at all."""
    purchases, views = _purchases_and_views(spark, sf_dir)
    return DataFrameMethod(method="join_asof", args=[views], kwargs={"on": "ts"}).transform(purchases).select("event_id", "event_id_right")


@query(
    f"""SELECT e.event_id, CASE WHEN a.ts IS NULL OR b.ts - e.ts < e.ts - a.ts THEN coalesce(b.event_id, a.event_id) ELSE a.event_id END AS event_id_right
    FROM {_P} e ASOF LEFT JOIN {_V} a ON e.ts >= a.ts ASOF LEFT JOIN {_V} b ON e.ts <= b.ts"""
)
def join_asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view nearest to each purchase."""
    purchases, views = _purchases_and_views(spark, sf_dir)
    return DataFrameMethod(method="join_asof", args=[views], kwargs={"on": "ts", "strategy": "nearest"}).transform(purchases).select("event_id", "event_id_right")


@query(f"SELECT e.event_id, CASE WHEN o.ts <= e.ts + INTERVAL 20 MINUTE THEN o.event_id END AS event_id_right FROM {_P} e ASOF LEFT JOIN {_V} o ON e.ts <= o.ts")
def join_asof_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next view within twenty minutes of each purchase."""
    purchases, views = _purchases_and_views(spark, sf_dir)
    return DataFrameMethod(method="join_asof", args=[views], kwargs={"on": "ts", "strategy": "forward", "tolerance": "20m"}).transform(purchases).select("event_id", "event_id_right")


add(
    "groupby_quantile",
    "lineitem",
    [
        GroupBy(
            groupby_columns="l_returnflag",
            aggregations=[
                {"agg": "quantile", "col": "l_extendedprice", "q": 0.9, "alias": "high"},
                {"agg": "quantile", "col": "l_quantity", "q": 0.25, "interpolation": "lower", "alias": "low"},
                {"agg": "median", "col": "l_extendedprice", "alias": "mid"},
                {"agg": "mode", "col": "l_quantity", "alias": "often"},
                {"agg": "max", "col": "l_tax", "alias": "tax"},
            ],
        ),
        WithColumns(columns=["high", "mid"], method="round", args=[6]),
    ],
    "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 6) AS high, CAST(list_sort(list(l_quantity))[CAST(floor((count(*) - 1) * 0.25) AS BIGINT) + 1] AS DOUBLE) AS low, round(median(l_extendedprice), 6) AS mid, any_value(often) AS often, max(l_tax) AS tax"
    " FROM lineitem JOIN (SELECT l_returnflag, arg_min(l_quantity, (-n, l_quantity)) AS often FROM (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1) USING (l_returnflag) GROUP BY 1",
)
add(
    "sample_rows",
    "part",
    [SelectColumns(columns=["p_brand", "p_size"]), DataFrameMethod(method="sample", kwargs={"n": 300, "seed": 11})],
    "SELECT p_brand, p_size FROM (SELECT *, md5(strlen(p_brand) || ':' || p_brand || strlen(CAST(p_size AS VARCHAR)) || ':' || p_size) AS d, row_number() OVER (PARTITION BY p_brand, p_size) - 1 AS copy FROM part)"
    " ORDER BY md5('11:' || copy || ':' || d) LIMIT 300",
)
add(
    "dedup_keep_rows",
    "events",
    [SelectColumns(columns=["value", "event_id", "user_id", "event_type"]), SparkDropDuplicates(columns=["user_id", "event_type"], keep_rows=True)],
    "SELECT value, event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC NULLS LAST, event_id DESC) = 1",
)
add(
    "pivot_wide",
    "orders",
    [
        SelectColumns(columns=["o_orderpriority", "o_orderstatus", "o_orderdate", "o_totalprice"]),
        Cast(cast={"o_orderdate": "date"}),
        Pivot(pivot_col="o_orderdate", id_cols=["o_orderpriority", "o_orderstatus"], aggregate_function="max", values_cols="o_totalprice"),
        Unpivot(id_cols=["o_orderpriority", "o_orderstatus"], melt_regex="^[0-9]", variable_col="day", value_col="v"),
        DropNulls(),
    ],
    "SELECT o_orderpriority, o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, max(o_totalprice) AS v FROM orders GROUP BY ALL",
)


# runs: storage for debugging, resuming, steps in between, hooks, own transformers, workers
def _lit(name: str, value: Any) -> AddLiterals:
    return AddLiterals(data=[{"alias": name, "value": value, "cast": "int64"}])


_WEST = Filter(input_col="n_regionkey", operator="lt", value=2)
add("store_debug_on", "nation", [{"storage_debug_mode": True}, _WEST, {"store_debug": "kept"}, _lit("later", 1), {"from_store": "kept"}], "SELECT * FROM nation WHERE n_regionkey < 2")
add("store_debug_off", "nation", [{"store": "kept"}, {"storage_debug_mode": False}, _WEST, {"store_debug": "kept"}, {"from_store": "kept"}], "SELECT * FROM nation")
add(
    "apply_to_rows_compared",
    "orders",
    [SelectColumns(columns=["o_orderkey", "o_custkey"]), _lit("less", 1)],
    "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey < o_orderkey THEN 1::BIGINT END AS less FROM orders",
    apply_to_rows={"input_col": "o_custkey", "operator": "lt", "comparison_column": "o_orderkey"},
    otherwise=[SelectColumns(columns=["o_orderkey", "o_custkey"])],
    allow_missing_columns=True,
    repartition_output_to_original=True,
)


@query("SELECT *, 2::BIGINT AS b, 3::BIGINT AS c FROM supplier")
def resume_from_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that begins at its second step."""
    p = TransformerPipeline([_lit("a", 1), _lit("b", 2), _lit("c", 3)])
    second = [i for i in p.get_node_ids() if i.startswith("AddLiterals")][1]
    return p.run(read_table(spark, sf_dir, "supplier"), resume_from=second, verbose=False)


@query("SELECT *, 1::BIGINT AS a, 2::BIGINT AS b, 3 AS steps FROM supplier")
def after_each_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function that runs after every step counts them."""
    count = lambda df: df.withColumn("steps", (F.col("steps") if "steps" in df.columns else F.lit(0)) + 1)
    return TransformerPipeline([_lit("a", 1), _lit("b", 2), lambda df: df]).run(read_table(spark, sf_dir, "supplier"), after_each_step=count, verbose=False)


@query("SELECT *, 1::BIGINT AS a, 'AddLiterals function fork AddLiterals' AS seen FROM supplier")
def hooks_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hooks hear of every step, of those within a fork that is one scan too."""
    seen: list[str] = []

    class Names(NoOpHooks):
        def on_node_start(self, node: Any, context: dict) -> None:
            seen.append(getattr(node, "kind", "other").split(":")[0 if not hasattr(node, "transformer") else 1])

    inner = TransformerPipeline([_lit("a", 1)], apply_to_rows={"input_col": "s_suppkey", "operator": "gt", "value": 0})
    out = TransformerPipeline([_lit("a", 1), lambda df: df, inner]).run(read_table(spark, sf_dir, "supplier"), hooks=Names())
    return out.withColumn("seen", F.lit(" ".join(seen)))


@query("SELECT *, s_acctbal * 2 AS twice FROM supplier")
def duck_typed_transformer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any object with a method ``transform`` is a step."""

    class Twice:
        def transform(self, df: DataFrame, factor: int = 2) -> DataFrame:
            return df.withColumn("twice", F.col("s_acctbal") * factor)

    return TransformerPipeline([Twice()]).run(read_table(spark, sf_dir, "supplier"), verbose=False)


@query("SELECT n_nationkey, true AS here, false AS nowhere, true AS small, false AS not_small FROM nation")
def workers_and_broadcasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What workers can import, and which plans broadcast."""
    df = read_table(spark, sf_dir, "nation", ["n_nationkey"])
    out = df.withColumn("here", udf_ensure_package_in_spark_workers("pyspark")("n_nationkey")).withColumn("nowhere", udf_ensure_package_in_spark_workers("no_such_package")("n_nationkey"))
    return out.withColumn("small", F.lit(is_broadcast(df.join(F.broadcast(df.withColumnRenamed("n_nationkey", "k")), F.col("n_nationkey") == F.col("k"))))).withColumn("not_small", F.lit(is_broadcast(df)))


_methods("math_more", "customer", "CASE WHEN c_custkey > 0 THEN round(ln(c_custkey), 6) END AS natural, CASE WHEN c_custkey > 0 THEN round(log2(c_custkey), 6) END AS binary, round(tan(c_nationkey), 6) AS slope, CASE WHEN c_custkey > 0 THEN round(exp(ln(c_custkey)), 6) END AS again", _m("c_custkey", "log", "g1"), _m("g1", "round", "natural", 6), _m("c_custkey", "log", "b1", 2), _m("b1", "round", "binary", 6), _m("c_nationkey", "tan", "t1"), _m("t1", "round", "slope", 6), _m("g1", "exp", "e1"), _m("e1", "round", "again", 6))
add(
    "methods_spans",
    "orders",
    [
        SelectColumns(columns=["o_orderkey", "o_orderdate"]),
        lambda df: df.withColumn("span", F.col("o_orderdate").cast("timestamp") - F.lit("1992-01-01 06:30:00").cast("timestamp")),
        WithColumns(columns="span", method="dt.total_days", alias="days"),
        WithColumns(columns="span", method="dt.total_hours", alias="hours"),
        WithColumns(columns="span", method="dt.total_minutes", alias="minutes"),
        WithColumns(columns="span", method="dt.total_seconds", alias="seconds"),
        SelectColumns(columns=["o_orderkey", "days", "hours", "minutes", "seconds"]),
    ],
    "SELECT o_orderkey, s // 86400 AS days, s // 3600 AS hours, s // 60 AS minutes, s AS seconds FROM (SELECT o_orderkey, CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) - epoch(TIMESTAMP '1992-01-01 06:30:00') AS BIGINT) AS s FROM orders)",
)
add("frame_gather_every", "orders", [SelectColumns(columns=["o_orderkey", "o_custkey"]), DataFrameMethod(method="gather_every", args=[7, 3], kwargs={"order_by": "o_orderkey"})], "SELECT o_orderkey, o_custkey FROM orders QUALIFY (row_number() OVER (ORDER BY o_orderkey) - 4) % 7 = 0 AND row_number() OVER (ORDER BY o_orderkey) > 3")
add("frame_unpivot", "customer", [SelectColumns(columns=["c_custkey", "c_name", "c_mktsegment"]), DataFrameMethod(method="unpivot", kwargs={"index": "c_custkey"})], "SELECT c_custkey, 'c_name' AS variable, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer")

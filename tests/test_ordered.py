"""Windows over the order of all rows, against Spark's own over one task, and their plans."""

import math
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import distinct, ordered
from weftline.functions.methods import frame_method
from weftline.functions.ordered import By, Frame
from weftline.operators import AggregateOverWindow, DataFrameMethod, GroupBy, LagOverWindow, WithColumns


@pytest.fixture(scope="module")
def few(spark):
    """500 rows: a unique order, one with ties and nulls, values with nulls, NaN and a hot value."""
    rng = random.Random(5)
    rows = []
    for i in range(500):
        t = None if rng.random() < 0.05 else rng.choice([7] * 5 + list(range(40)))
        v = None if rng.random() < 0.1 else rng.choice([1, 1, 1, *range(30)])
        x = None if v is None else float("nan") if rng.random() < 0.02 else v / 3
        rows.append((i, t, v, x, f"s{v}"))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "i bigint, t int, v bigint, x double, s string").repartition(7).cache()


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def same(got, want, key="i"):
    got, want = (sorted(df.collect(), key=lambda r: str(r[key])) for df in (got, want))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g.asDict().keys() == w.asDict().keys()
        assert all(close(g[c], w[c]) for c in w.asDict()), (g, w)


def check_plan(df, rows):
    """No window over all rows: what is brought together in one task has a row for each chunk at most."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    for block in re.findall(r"Exchange SinglePartition[^\n]*\n[^\n]*", plan):
        assert "Aggregate" in block or "weftline__c" in block, block
    assert "hashpartitioning(weftline__chunk" in plan


BOUNDS = [("start", 3), ("start", -2), (2, "end"), (-3, "end"), (-4, -2), (1, 5), ("start", "end"), (-60, 60)]
AGGS = ["sum", "avg", "min", "max", "count", "first", "last", "stddev", "variance"]


@pytest.mark.parametrize("bounds", BOUNDS)
def test_frames_of_rows(few, bounds):
    aggs = [{"agg": a, "col": "v", "alias": a} for a in AGGS] + [{"agg": "countDistinct", "col": "s", "alias": "n"}, {"agg": "max", "col": "x", "alias": "x"}]
    w = Window.orderBy("i").rowsBetween(*[{"start": Window.unboundedPreceding, "end": Window.unboundedFollowing}.get(b, b) for b in bounds])
    want = few.select("i", "t", "v", "s", *[getattr(F, a)("v").over(w).alias(a) for a in AGGS], F.size(F.collect_set("s").over(w)).cast("bigint").alias("n"), F.max("x").over(w).alias("x"))
    same(AggregateOverWindow(order_cols="i", rows_between=list(bounds), aggregations=aggs).transform(few), want)


@pytest.mark.parametrize(("ascending", "given"), [(True, None), (False, ["start", 0]), (True, [0, "end"]), (False, [0, "end"]), (True, ["start", "end"])])
def test_frames_of_peers(few, ascending, given):
    aggs = [{"agg": a, "col": "v", "alias": a} for a in ("sum", "avg", "min", "max", "count")] + [{"agg": "countDistinct", "col": "s", "alias": "n"}]
    w = Window.orderBy(F.col("t").asc() if ascending else F.col("t").desc(), F.col("v").asc() if ascending else F.col("v").desc())
    if given:
        w = w.rangeBetween(*[{"start": Window.unboundedPreceding, "end": Window.unboundedFollowing}.get(b, b) for b in given])
    want = few.select("*", *[getattr(F, a)("v").over(w).alias(a) for a in ("sum", "avg", "min", "max", "count")], F.size(F.collect_set("s").over(w)).cast("bigint").alias("n"))
    same(AggregateOverWindow(order_cols=["t", "v"], ascending=ascending, range_between=given, aggregations=aggs).transform(few), want)


BY_VALUE = [(-3, 2), ("start", 2), ("start", -1), (-2, "end"), (1, 4), (-5, -2), ("start", 0), (0, "end")]


@pytest.mark.parametrize(("partition", "ascending", "bounds"), [*[("k", i % 2 == 0, b) for i, b in enumerate(BY_VALUE)], ("k", False, (-3, 2)), ("k", False, (1, 4)), (None, True, (-3, 2)), (None, False, (-2, "end"))])
def test_distinct_counts_of_frames_by_value(few, partition, ascending, bounds):
    df = few.withColumn("k", F.col("i") % 3)
    w = Window.partitionBy(*([partition] if partition else [])).orderBy(F.col("t").asc() if ascending else F.col("t").desc())
    w = w.rangeBetween(*[{"start": Window.unboundedPreceding, "end": Window.unboundedFollowing}.get(b, b) for b in bounds])
    want = df.select("*", F.size(F.collect_set("s").over(w)).cast("bigint").alias("n"))
    step = AggregateOverWindow(partition_cols=partition, order_cols="t", ascending=ascending, range_between=list(bounds), aggregations={"agg": "countDistinct", "col": "s", "alias": "n"})
    out = step.transform(df)
    assert "collect_set" not in out._jdf.queryExecution().toString()
    same(out, want)


@pytest.mark.parametrize("bounds", [None, (-2, 1), ("start", 0), ("start", "end"), (0, "end"), (-9, -3)])
def test_distinct_counts_in_partitions(few, bounds):
    df = few.withColumn("k", F.when(F.col("i") % 4 > 0, F.col("i") % 4))
    w = Window.partitionBy("k")
    if bounds:
        w = w.orderBy("i").rowsBetween(*[{"start": Window.unboundedPreceding, "end": Window.unboundedFollowing}.get(b, b) for b in bounds])
    want = df.select("i", "t", "x", "s", "k", F.size(F.collect_set("v").over(w)).cast("bigint").alias("v"))
    options = {"order_cols": "i", "rows_between": list(bounds)} if bounds else {}
    same(AggregateOverWindow(partition_cols="k", **options, aggregations={"agg": "countDistinct", "col": "v", "alias": "v"}).transform(df), want)


METHODS = [
    ("shift", [], lambda w: F.lag("v").over(w)),
    ("shift", [-3], lambda w: F.lead("v", 3).over(w)),
    ("diff", [2], lambda w: F.col("v") - F.lag("v", 2).over(w)),
    ("cum_sum", [], lambda w: F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))),
    ("cum_min", [], lambda w: F.min("v").over(w.rowsBetween(Window.unboundedPreceding, 0))),
    ("cum_max", [], lambda w: F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0))),
    ("cum_count", [], lambda w: F.count("v").over(w.rowsBetween(Window.unboundedPreceding, 0))),
    ("rolling_mean", [4], lambda w: F.when(F.count("v").over(w.rowsBetween(-3, 0)) == 4, F.avg("v").over(w.rowsBetween(-3, 0)))),
    ("rolling_max", [90, 1], lambda w: F.max("v").over(w.rowsBetween(-89, 0))),
]


@pytest.mark.parametrize(("method", "args", "want", "descending"), [(*m, i % 3 == 0) for i, m in enumerate(METHODS)])
def test_methods(few, method, args, want, descending):
    w = Window.orderBy(F.col("i").desc() if descending else F.col("i"))
    got = WithColumns(columns="v", method=method, args=args, kwargs={"order_by": "i", "descending": descending}).transform(few)
    assert got.columns == few.columns
    same(got, few.withColumn("v", want(w)))


@pytest.mark.parametrize("strategy", ["forward", "backward"])
def test_fill_null(few, strategy):
    w = Window.orderBy("i").rowsBetween(*((Window.unboundedPreceding, 0) if strategy == "forward" else (0, Window.unboundedFollowing)))
    want = few.withColumn("y", (F.last if strategy == "forward" else F.first)("v", True).over(w))
    same(WithColumns(columns="v", method="fill_null", kwargs={"strategy": strategy, "order_by": "i"}, alias="y").transform(few), want)


@pytest.mark.parametrize(("method", "descending"), [("average", False), ("average", True), ("min", True), ("max", False), ("dense", True)])
def test_ranks(few, method, descending):
    known = few.filter("t IS NOT NULL")
    w = Window.orderBy(F.col("t").desc() if descending else F.col("t"))
    ties = F.count(F.lit(1)).over(Window.partitionBy("t"))
    want = {"average": F.rank().over(w) + (ties - 1) / 2, "min": F.rank().over(w), "max": F.rank().over(w) + ties - 1, "dense": F.dense_rank().over(w)}[method]
    want = known.select("*", want.alias("r")).unionByName(few.filter("t IS NULL").withColumn("r", F.lit(None).cast("int")))
    same(WithColumns(columns="t", method="rank", args=[method], kwargs={"descending": descending}, alias="r").transform(few), want)


def test_ordinal_rank_numbers_known_rows(few):
    got = WithColumns(columns="t", method="rank", args=["ordinal"], alias="r").transform(few).collect()
    assert sorted(r.r for r in got if r.t is not None) == list(range(1, 1 + sum(r.t is not None for r in got)))
    assert [r.t for r in sorted((r for r in got if r.r), key=lambda r: r.r)] == sorted(r.t for r in got if r.t is not None)
    assert all((r.r is None) == (r.t is None) for r in got)


def test_lag_index_and_occurrences(few):
    w = Window.orderBy("i")
    same(LagOverWindow(lag_col="s", lag=-2, output_col="n", order_cols="i", ascending=False).transform(few), few.withColumn("n", F.lag("s", 2).over(w)))
    same(DataFrameMethod(method="with_row_index", args=["n"], kwargs={"order_by": "i"}).transform(few).select("i", "n"), few.select("i", F.col("i").alias("n")))
    for method, order in (("is_first_distinct", F.col("i")), ("is_last_distinct", F.col("i").desc())):
        want = few.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy(order)) == 1)
        same(WithColumns(columns="v", method=method, kwargs={"order_by": "i"}, alias="n").transform(few), want)


def test_counts_of_alike_values(few):
    n = F.count(F.lit(1)).over(Window.partitionBy("v"))
    same(WithColumns(columns="v", method="is_unique", alias="n").transform(few), few.withColumn("n", n == 1))
    same(WithColumns(columns="v", method="is_duplicated", kwargs={"partition_by": "t"}, alias="n").transform(few), few.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("v", "t")) > 1))
    same(frame_method("unique")(few, ["t", "v"], keep="none"), few.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("t", "v"))).filter("n = 1").drop("n"))


def test_several_orders_and_replaced_columns(few):
    got = WithColumns(columns=["v", "t"], method="shift", kwargs={"order_by": "i"}).transform(few)
    w = Window.orderBy("i")
    same(got, few.withColumns({"v": F.lag("v").over(w), "t": F.lag("t").over(w)}))


def test_aggregates_of_all_rows_need_no_order(few):
    aggs = [{"agg": a, "col": "v", "alias": a} for a in ("sum", "avg", "max", "stddev", "count", "countDistinct", "collect_set")]
    out = AggregateOverWindow(aggregations=aggs).transform(few)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    want = few.agg(*[getattr(F, a)("v").alias(a) for a in ("sum", "avg", "max", "stddev", "count")], F.count_distinct("v").alias("countDistinct")).first()
    got = out.collect()
    assert len(got) == 500 and all(close(r[a], want[a]) for r in got for a in want.asDict()) and len(got[0].collect_set) == want["countDistinct"]
    rows = AggregateOverWindow(aggregations={"agg": "sum", "col": "i", "alias": "s"}, order_cols="t", range_between=["start", "end"]).transform(few).collect()
    assert {r.s for r in rows} == {sum(range(500))}


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_frames(spark, n):
    df = spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("v"))
    w = Window.orderBy("i")
    aggs = [{"agg": a, "col": "v", "alias": a} for a in (*AGGS, "countDistinct")]
    for bounds in (["start", 0], [-1, 1], [0, "end"], ["start", "end"]):
        out = AggregateOverWindow(order_cols="i", rows_between=bounds, aggregations=aggs).transform(df)
        assert out.count() == n
    same(WithColumns(columns="v", method="cum_sum", kwargs={"order_by": "i"}).transform(df), df.withColumn("v", F.sum("v").over(w)))


def test_hot_ties_spread_and_no_task_holds_all_rows(spark):
    """Half the rows have one order value; chunks are of one size all the same."""
    df = spark.range(100_000, numPartitions=6).select(F.col("id").alias("i"), F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 97).cast("int").alias("t"))
    rows, total = ordered.number(df, [F.col("t")])
    assert total == 100_000 and rows.agg(F.count_distinct(ordered.ROW), F.min(ordered.ROW), F.max(ordered.ROW)).first()[:] == (100_000, 0, 99_999)
    frame = Frame(df, [By(F.col("t"))])
    frame.add("n", frame.aggregate("sum", F.lit(1), None, 0))
    out = frame.result()
    check_plan(out, 100_000)
    sizes = [r["count"] for r in frame.rows.groupBy(F.expr(f"{ordered.ROW} div {-(-100_000 // 12)}")).count().collect()]
    assert max(sizes) <= 1.01 * min(s for s in sizes if s > 8000)
    assert sorted(r.n for r in out.select("n").collect()) == list(range(1, 100_001))
    for step in (
        WithColumns(columns="t", method="cum_sum", kwargs={"order_by": "i"}),
        WithColumns(columns="t", method="rank", args=["dense"]),
        LagOverWindow(lag_col="t", lag=1, output_col="b", order_cols="i"),
        AggregateOverWindow(order_cols="t", aggregations={"agg": "sum", "col": "i", "alias": "s"}),
    ):
        check_plan(step.transform(df), 100_000)


TO_END = {
    "fill_null": lambda df: WithColumns(columns="v", method="fill_null", kwargs={"strategy": "backward", "order_by": "i"}),
    "rows": lambda df: AggregateOverWindow(order_cols="i", rows_between=[0, "end"], aggregations=[{"agg": a, "col": "v", "alias": a} for a in AGGS]),
    "rows_behind": lambda df: AggregateOverWindow(order_cols="i", rows_between=[2, "end"], aggregations={"agg": "sum", "col": "v", "alias": "s"}),
    "peers": lambda df: AggregateOverWindow(order_cols="v", aggregations={"agg": "sum", "col": "i", "alias": "s"}),
    "peers_to_end": lambda df: AggregateOverWindow(order_cols="v", range_between=[0, "end"], aggregations={"agg": "max", "col": "i", "alias": "m"}),
    "rank": lambda df: WithColumns(columns="v", method="rank", alias="r"),
    "asof_forward": lambda df: DataFrameMethod(method="join_asof", args=[df.select("i", F.col("v").alias("w"))], kwargs={"on": "i", "strategy": "forward", "tolerance": 3}),
    "asof_nearest": lambda df: DataFrameMethod(method="join_asof", args=[df.select("i", F.col("v").alias("w"))], kwargs={"on": "i", "strategy": "nearest"}),
}


@pytest.mark.parametrize("step", TO_END)
def test_no_frame_is_made_anew_for_each_row(spark, step):
    """Spark aggregates a frame that runs to the end from each row on, in the square of the rows; from the start it adds row by row."""
    df = spark.range(20_000, numPartitions=4).select(F.col("id").alias("i"), F.when(F.col("id") % 5 > 0, F.col("id") % 97).alias("v"))
    out = TO_END[step](df).transform(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    assert out.count() == 20_000


#: Frames whose distinct values were counted with three passes of their own.
COUNTED = {
    "peers": ("t", True, {}),
    "peers_descending": ("t", False, {}),
    "peers_to_end": ("t", True, {"range_between": [0, "end"]}),
    "from_start": ("i", True, {"rows_between": ["start", -2]}),
    "to_end": ("i", True, {"rows_between": [1, "end"]}),
}


@pytest.mark.parametrize("case", COUNTED)
def test_distinct_counts_share_the_pass_of_other_aggregates(few, monkeypatch, case):
    """A pass sorts all rows."""
    order, up, frame = COUNTED[case]
    passes, number = [], ordered.number
    for module in (ordered, distinct):
        monkeypatch.setattr(module, "number", lambda *args: passes.append(args) or number(*args))
    aggs = [{"agg": "sum", "col": "i", "alias": "a"}] + [{"agg": "countDistinct", "col": c, "alias": f"n_{c}"} for c in ("v", "s", "x")]
    got = AggregateOverWindow(order_cols=order, ascending=up, aggregations=aggs, **frame).transform(few)
    assert len(passes) == 1
    w = Window.orderBy(F.col(order) if up else F.col(order).desc())
    bounds = [{"start": Window.unboundedPreceding, "end": Window.unboundedFollowing}.get(b, b) for b in next(iter(frame.values()), ())]
    w = w.rowsBetween(*bounds) if "rows_between" in frame else w.rangeBetween(*bounds) if frame else w
    same(got, few.withColumns({"a": F.sum("i").over(w), **{f"n_{c}": F.size(F.collect_set(F.nanvl("x", F.lit(-1.0)) if c == "x" else c).over(w)) for c in ("v", "s", "x")}}))


def test_distinct_values_of_narrow_frames_share_the_pass_of_other_aggregates(few, monkeypatch):
    """Wide frames, and values that may be equal and not the same, are counted by passes of their own."""
    passes, number = [], ordered.number
    for module in (ordered, distinct):
        monkeypatch.setattr(module, "number", lambda *args: passes.append(args) or number(*args))
    for bounds, c, n in (((-3, 2), "s", 1), ((1, 4), "v", 1), ((-40, 40), "v", 4), ((-3, 2), "x", 4)):
        passes.clear()
        got = AggregateOverWindow(order_cols="i", rows_between=bounds, aggregations=[{"agg": "sum", "col": "i", "alias": "a"}, {"agg": "countDistinct", "col": c, "alias": "n"}]).transform(few)
        assert len(passes) == n
        w = Window.orderBy("i").rowsBetween(*bounds)
        same(got, few.withColumns({"a": F.sum("i").over(w), "n": F.size(F.collect_set(F.nanvl("x", F.lit(-1.0)) if c == "x" else c).over(w))}))


# as-of joins


def asof(left, right, strategy, tolerance=None):
    """By brute force: rows (id, k, t) with the id of the other side's nearest row."""
    out = []
    for i, k, t in left:
        best = None
        for j, k2, u in right:
            if None in (k, t, u) or k2 != k:
                continue
            if strategy == "backward" and u > t or strategy == "forward" and u < t:
                continue
            if tolerance is not None and abs(u - t) > tolerance:
                continue
            if best is None or (abs(u - t), u > t) < best[:2]:
                best = (abs(u - t), u > t, j)
        out.append((i, best[2] if best else None))
    return sorted(out)


@pytest.mark.parametrize("tolerance", [None, 2])
@pytest.mark.parametrize("strategy", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("by", [True, False])
def test_join_asof(spark, strategy, by, tolerance):
    rng = random.Random(3)
    key = lambda: None if rng.random() < 0.05 else rng.choice("aaaaaab")
    left = [(i, key() if by else "a", None if rng.random() < 0.05 else rng.randrange(300)) for i in range(400)]
    right = [(i, key() if by else "a", None if i == 3 else 3 * i) for i in range(100)]
    l, r = (spark.createDataFrame(x, f"{n} int, k string, t int").repartition(5) for x, n in ((left, "i"), (right, "j")))
    if not by:
        r = r.drop("k")
    got = DataFrameMethod(method="join_asof", args=[r], kwargs={"on": "t", "by": "k" if by else None, "strategy": strategy, "tolerance": tolerance}).transform(l)
    assert got.columns == ["i", "k", "t", "j"]
    assert sorted((x.i, x.j) for x in got.collect()) == asof(left, right, strategy, tolerance)


def test_join_asof_of_times(spark):
    at = lambda rows, n: spark.createDataFrame(rows, f"{n} int, s string").select(n, F.to_timestamp("s").alias("t"))
    left, right = at([(1, "2024-01-01 10:00:00"), (2, "2024-01-01 12:00:00")], "i"), at([(7, "2024-01-01 09:50:00"), (8, "2024-01-01 10:05:00"), (9, "2024-01-01 14:00:00")], "j")
    run = lambda **k: {r.i: r.j for r in frame_method("join_asof")(left, right, on="t", **k).collect()}
    assert run() == {1: 7, 2: 8} and run(strategy="nearest") == {1: 8, 2: 8} and run(strategy="forward") == {1: 8, 2: 9}
    assert run(tolerance="15m") == {1: 7, 2: None} and run(strategy="forward", tolerance="2h") == {1: 8, 2: 9} and run(strategy="forward", tolerance="1h59m") == {1: 8, 2: None}
    with pytest.raises(ValueError, match="strategy"):
        run(strategy="sideways")


def test_join_asof_spreads_one_hot_key(spark):
    df = spark.range(60_000, numPartitions=5).select(F.col("id").alias("i"), F.lit("hot").alias("k"), (F.col("id") * 7 % 60_000).alias("t"))
    other = spark.range(6_000).select(F.col("id").alias("j"), F.lit("hot").alias("k"), (F.col("id") * 10).alias("t"))
    out = frame_method("join_asof")(df, other, on="t", by="k")
    check_plan(out, 66_000)
    assert out.filter("j = t div 10").count() == 60_000


# quantiles


def quantile(values, q):
    values = sorted(values)
    at = (len(values) - 1) * q
    low, part = math.floor(at), at - math.floor(at)
    return None if not values else values[low] if not part else (1 - part) * values[low] + part * values[low + 1]


def test_quantiles_of_groups(few):
    rows = few.collect()
    step = GroupBy(
        groupby_columns="t",
        aggregations=[
            {"agg": "median", "col": "v", "alias": "mid"},
            {"agg": "quantile", "col": "v", "q": 0.9, "alias": "high"},
            {"agg": "quantile", "col": "v", "q": 0.25, "interpolation": "lower", "alias": "low"},
            {"agg": "sum", "col": "v", "alias": "total"},
            {"agg": "median", "col": "i", "alias": "i"},
        ],
    )
    got = {r.t: r for r in step.transform(few).collect()}
    assert set(got) == {r.t for r in rows}
    for t, r in got.items():
        values = [x.v for x in rows if x.t == t and x.v is not None]
        assert r.mid == quantile(values, 0.5) and close(r.high, quantile(values, 0.9)) and r.i == quantile([x.i for x in rows if x.t == t], 0.5)
        assert r.total == (sum(values) if values else None)
        assert r.low == (sorted(values)[math.floor((len(values) - 1) * 0.25)] if values else None)


def test_quantiles_only_and_of_nothing(spark, few):
    null = spark.createDataFrame([("a", None), ("b", 2), ("b", None), ("b", 5)], "k string, v int")
    got = {r.k: r.v for r in GroupBy(groupby_columns="k", aggregations={"median": "v"}).transform(null).collect()}
    assert got == {"a": None, "b": 3.5}
    assert GroupBy(groupby_columns="k", aggregations={"median": "v"}).transform(null.limit(0)).collect() == []
    want = {r.t: r.m for r in few.groupBy("t").agg(F.median("x").alias("m")).collect()}
    assert all(close(r.x, want[r.t]) for r in GroupBy(groupby_columns="t", aggregations={"median": "x"}).transform(few).collect())
    for how, value in {"higher": 5.0, "lower": 2.0, "midpoint": 3.5, "nearest": 5.0}.items():
        a = {"agg": "quantile", "col": "v", "q": 0.6, "interpolation": how, "alias": "m"}
        assert {r.k: r.m for r in GroupBy(groupby_columns="k", aggregations=a).transform(null).collect()}["b"] == value


def test_quantiles_are_checked(few):
    for bad in ({"q": 1.5}, {"q": 0.5, "interpolation": "cubic"}):
        with pytest.raises(ValueError):
            GroupBy(groupby_columns="t", aggregations={"agg": "quantile", "col": "v", **bad})
    with pytest.raises(KeyError):
        GroupBy(groupby_columns="t", aggregations={"agg": "sum", "col": "v", "q": 0.5})
    with pytest.raises(TypeError):
        GroupBy(groupby_columns="t", aggregations={"agg": "quantile", "col": "s", "alias": "q"}).transform(few)


def test_no_task_holds_a_group(spark):
    df = spark.range(200_000, numPartitions=8).select(F.lit("one").alias("k"), (F.col("id") * 7919 % 200_003).alias("v"))
    out = GroupBy(groupby_columns="k", aggregations={"median": "v"}).transform(df)
    plan = out._jdf.queryExecution().toString()
    assert "median" not in plan.lower() and "percentile" not in plan.lower()
    assert out.first().v == df.select(F.median("v")).first()[0]


def test_more_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 7.0), ("b", None)], "k string, v double")
    got = GroupBy(groupby_columns="k", aggregations=[{"agg": a, "col": "v", "alias": a} for a in ("mode", "skew", "kurtosis", "product")]).transform(df).orderBy("k").collect()
    assert (got[0].mode, got[0].product) == (2.0, 28.0) and got[0].skew == pytest.approx(1.0466217) and got[0].kurtosis == pytest.approx(-0.7355372) and got[1].mode is None


def test_whole_partitions_are_counted_by_a_group(few):
    got = {r.t: r.n for r in distinct.over_partition(few, ["t"], {"n": F.col("s")}).collect()}
    assert got == {r.t: r.n for r in few.groupBy("t").agg(F.count_distinct("s").alias("n")).collect()}

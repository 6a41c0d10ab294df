import logging

import pytest
from pyspark.sql import functions as F

from weftline import LoggingHooks, NoOpHooks, PipelineConfig, Storage, TransformerPipeline, load_pipeline, storage
from weftline.operators import AddLiterals, AssertNotEmpty, Cast, DropColumns, Filter, LazyWrapper, Repartition, SelectColumns
from weftline.plans import expand_loops


class Broken:
    """Fails."""

    def transform(self, df):
        raise ValueError("broken")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def lit(alias, value):
    return AddLiterals(data=[{"alias": alias, "value": value}])


@pytest.fixture
def store():
    return Storage()


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, None if i in (3, 7) else i * 10, "ab"[i % 2]) for i in range(10)], "idx bigint, v bigint, s string")


def test_steps(df, store):
    def plus(d, n, by=1):
        return d.withColumn("p", F.col("idx") + n * by)

    p = TransformerPipeline(
        [SelectColumns(columns=["idx", "v"]), None, [[(plus, [2], {"by": 3}, "adds")], {"store": "x"}], (Filter(input_col="p", operator="gt", value=10), "large"), "to_native", "from_native", DropColumns(columns="v")],
        store=store,
    )
    assert rows(p.run(df, verbose=False)) == [(i, i + 6) for i in range(5, 10)]
    assert store.get("x").columns == ["idx", "v", "p"]
    assert rows(TransformerPipeline(AssertNotEmpty()).run(df, verbose=False)) == rows(df)
    assert rows(TransformerPipeline([]).run(df, verbose=False)) == rows(df)
    for word in ("collect", "to_lazy"):
        with pytest.raises(TypeError):
            TransformerPipeline([word]).run(df, verbose=False)
    for bad in ([5], ["nonsense"], [(len, 1)], [SelectColumns]):
        with pytest.raises((TypeError, ValueError)):
            TransformerPipeline(bad)


def test_storage_steps(df, store):
    for k in "abc":
        store.set(k, k)
    TransformerPipeline([{"clear": "a"}, {"store_debug": "d1"}, {"storage_debug_mode": True}, {"store_debug": "d2"}, {"clear": []}], store=store).run(df, verbose=False)
    assert store.list_keys() == ["b", "c", "d2"]
    TransformerPipeline([{"clear_except": ["b"]}], store=store).run(df, verbose=False)
    assert store.list_keys() == ["b"] and store.count_objects() == 1
    store.disallow_overwriting()
    with pytest.raises(KeyError):
        store.set("b", 1)
    TransformerPipeline(["clear"], store=store).run(df, verbose=False)
    assert not store.isin("b")
    with pytest.raises(AssertionError):
        store.set([], 1)
    with pytest.raises(TypeError):
        store.allow_debug(1)


def halves(d):
    return {"low": d.filter("idx < 5"), "hi": d.filter("idx >= 5")}


def test_split(df, store):
    p = TransformerPipeline({"low": [lit("t", "l")], "hi": [lit("t", "h")]}, split_function=halves, split_apply_before_appending=[SelectColumns(columns=["idx", "t"])])
    assert rows(p.run(df, verbose=False)) == [(i, "l" if i < 5 else "h") for i in range(10)]
    p = TransformerPipeline({"low": [{"store": "low"}], "hi": []}, split_function=halves, splits_no_merge="low", store=store)
    assert p.run(df, verbose=False).count() == 5 and store.get("low").count() == 5
    p = TransformerPipeline({"low": [lit("t", 1)], "hi": None}, split_function=halves, allow_missing_columns=True, split_order=["low", "hi"])
    assert p.run(df, verbose=False).columns == ["idx", "v", "s", "t"]
    p = TransformerPipeline({"low": [Cast(cast={"v": "str"})], "hi": [DropColumns(columns=[])]}, split_function=halves, cast_subsets_to_input_schema=True)
    assert p.run(df, verbose=False).schema == df.schema
    p = TransformerPipeline({"low": [Broken()], "hi": []}, split_function=lambda d: {"low": d.limit(0), "hi": d}, splits_skip_if_empty=["low"])
    assert p.run(df, verbose=False).count() == 10
    both = TransformerPipeline({"low": [], "hi": []}, split_function=halves, splits_no_merge=["low", "hi"])
    assert both.run(df, verbose=False).count() == 10
    with pytest.raises(KeyError):
        TransformerPipeline({"low": [], "mid": []}, split_function=halves).run(df, verbose=False)
    with pytest.raises(KeyError):
        TransformerPipeline({"low": [], "hi": []}, split_function=halves, splits_no_merge="mid")
    with pytest.raises(ValueError):
        TransformerPipeline({"low": [lit("t", 1)], "hi": []}, split_function=halves).run(df, verbose=False)
    with pytest.raises(TypeError):
        TransformerPipeline({"low": [], "hi": []}, split_function=5)
    with pytest.raises(ValueError):
        TransformerPipeline({"low": [], "hi": []})


def test_branch(df, store):
    p = TransformerPipeline([Filter(input_col="idx", operator="lt", value=2), lit("s", "new")], branch={"end": "append"}, otherwise=lit("s", "old"))
    got = [tuple(r) for r in p.run(df, verbose=False).collect()]
    assert sorted(g[2] for g in got) == ["new"] * 2 + ["old"] * 10
    store.set("other", df.limit(0))
    p = TransformerPipeline([], branch={"end": "append", "storage": "other"}, store=store)
    assert p.run(df, verbose=False).count() == 10
    p = TransformerPipeline([SelectColumns(columns="idx"), lit("n", 1)], branch={"end": "join", "how": "left", "on": "idx"})
    assert p.run(df, verbose=False).columns == ["idx", "v", "s", "n"]
    p = TransformerPipeline([lit("n", 1), {"store": "side"}], branch={"end": "dead-end"}, store=store)
    assert p.run(df, verbose=False).columns == df.columns and "n" in store.get("side").columns
    skipped = TransformerPipeline([Broken()], branch={"end": "append", "skip": True}, otherwise=lit("s", "z"))
    assert {r.s for r in skipped.run(df, verbose=False).collect()} == {"z"}
    narrow = TransformerPipeline([Repartition(num_partitions=10)], branch={"end": "append"}, coalesce_output_to_original=True)
    assert narrow.run(df.repartition(2), verbose=False).rdd.getNumPartitions() == 2
    for error, kw in [
        (ValueError, {"branch": {"end": "nowhere"}}),
        (KeyError, {"branch": {"end": "join"}}),
        (KeyError, {"branch": {"end": "append", "how": "left"}}),
        (KeyError, {"branch": {"end": "append", "what": 1}}),
        (ValueError, {"branch": {"end": "append"}, "apply_to_rows": {"input_col": "a", "operator": "is_null"}}),
        (ValueError, {"otherwise": []}),
        (ValueError, {"branch": {"end": "dead-end"}, "otherwise": []}),
        (ValueError, {"branch": {"end": "append", "storage": "x"}, "otherwise": []}),
        (ValueError, {"branch": {"end": "append", "skip": True, "perform": True}}),
        (ValueError, {"allow_missing_columns": True, "cast_subsets_to_input_schema": True}),
    ]:
        with pytest.raises(error):
            TransformerPipeline([], **kw)


def test_apply_to_rows(df):
    rule = {"input_col": "v", "operator": "gt", "value": 50}
    p = TransformerPipeline(lit("s", "big"), apply_to_rows=rule, otherwise=lit("s", "rest"))
    assert {(r.idx, r.s) for r in p.run(df, verbose=False).collect()} == {(i, "big" if i in (6, 8, 9) else "rest") for i in range(10)}
    p = TransformerPipeline(Broken(), apply_to_rows={**rule, "value": 10**6, "skip_if_empty": True})
    assert rows(p.run(df, verbose=False)) == rows(df)
    p = TransformerPipeline([], apply_to_rows={**rule, "dead-end": True})
    assert p.run(df, verbose=False).count() == 7
    p = TransformerPipeline(lit("n", 1), apply_to_rows={"input_col": "idx", "operator": "eq", "comparison_column": "v"}, allow_missing_columns=True)
    assert p.run(df, verbose=False).filter("n = 1").count() == 1
    p = TransformerPipeline(Cast(cast={"v": "str"}), apply_to_rows=rule, cast_subsets_to_input_schema=True)
    assert p.run(df, verbose=False).schema == df.schema
    for error, bad in [(ValueError, {**rule, "comparison_column": "s"}), (ValueError, {"input_col": "v", "operator": "eq", "comparison_column": "v"}), (KeyError, {"operator": "eq"}), (KeyError, {**rule, "end": 1})]:
        with pytest.raises(error):
            TransformerPipeline([], apply_to_rows=bad)


def test_interleaved_and_after_each_step(df):
    seen = []

    def note(d):
        seen.append(d.columns)
        return d

    TransformerPipeline([lit("a", 1), {"store": "zz"}, lit("b", 1)], interleaved=[note], prepend_interleaved=True, append_interleaved=True).run(df, verbose=False)
    assert [len(x) for x in seen] == [3, 4, 5]
    seen.clear()
    inner = TransformerPipeline(lit("s", "x"), apply_to_rows={"input_col": "v", "operator": "is_null"})
    TransformerPipeline([lit("a", 1), inner]).run(df, after_each_step=note, verbose=False)
    assert len(seen) == 3
    storage.clear("zz")


def test_failures(df, store):
    with pytest.raises(ValueError, match="FAIL_DF_transformer:Broken"):
        TransformerPipeline([Broken()], store=store).run(df, verbose=False)
    assert rows(store.get("FAIL_DF_transformer:Broken")) == rows(df)
    with pytest.raises(Exception):
        TransformerPipeline({"low": [], "hi": []}, split_function=lambda d: d.filter("zz > 1"), store=store).run(df, verbose=False)
    assert rows(store.get("FAIL_DF_fork:split")) == rows(df)
    with pytest.raises(ValueError):
        TransformerPipeline({"low": [DropColumns(columns="v")], "hi": [DropColumns(columns="s")]}, split_function=halves, store=store).run(df, verbose=False)
    assert store.get("FAIL_DF_low-df-before-appending:append").columns == ["idx", "s"]
    assert store.get("FAIL_DF_hi-df-before-appending:append").columns == ["idx", "v"]


def test_resume_and_ids(df):
    inner = TransformerPipeline([lit("b", 1), lit("c", 1)], name="inner")
    fork = TransformerPipeline([lit("s", "x"), lit("s", "y")], apply_to_rows={"input_col": "v", "operator": "is_null"})
    p = TransformerPipeline([Broken(), lit("a", 1), inner, fork], name="outer")
    ids = p.get_node_ids()
    assert len(ids) == len(set(ids)) and ids == TransformerPipeline([Broken(), lit("a", 1), inner, fork], name="outer").get_node_ids()
    at = lambda n: [i for i in ids if i.startswith("AddLiterals")][n]
    assert p.run(df, resume_from=at(0), verbose=False).columns[3:] == ["a", "b", "c"]
    assert p.run(df, resume_from=at(2), verbose=False).columns[3:] == ["c"]
    skipped = []

    class Hooks(NoOpHooks):
        def on_skip(self, node, reason, context):
            skipped.append(node.id)

    out = p.run(df, resume_from=at(4), hooks=Hooks())
    assert out.columns == df.columns and out.filter("s = 'y'").count() == 2 and out.count() == 10 and len(skipped) == 5
    assert p.find_node(at(4)) is not None and p.find_node("no") is None
    with pytest.raises(ValueError):
        p.run(df, resume_from="no")


def test_rendering():
    def pick(d):
        return {}

    split = TransformerPipeline({"low": [AssertNotEmpty()], "hi": []}, split_function=pick, name="split")
    rowwise = TransformerPipeline(lit("t", "x" * 200), apply_to_rows={"input_col": "idx", "operator": "gt", "value": 1}, otherwise=[lit("t", 1)])
    join = TransformerPipeline([], branch={"end": "join", "on": "idx", "how": "left"})
    dead = TransformerPipeline([], branch={"end": "dead-end", "storage": "k"})
    lazy = LazyWrapper(Filter, input_col="a", operator="eq", value=(storage, "key"))
    p = TransformerPipeline([split, rowwise, join, dead, (lazy), (pick, [1], {"z": 2}, "picks"), {"clear": None}, {"from_store": "q"}, (AssertNotEmpty(), "rows")], name="all")
    text = p.to_string(show_params=True)
    for part in (
        "*** all *** (", "------ SPLIT ------ (function: pick)", "**SPLIT <<< hi >>> (0 transformations):", "**SPLIT <<< low >>> (1 transformation):", "------ APPLY TO ROWS (idx gt 1) ------",
        ">> Otherwise (1 transformation):", "<<< Append DFs >>>", "<<< Join DFs >>>", "<<< Dead End (no merge) >>>", "------ BRANCH (from storage: k) ------", "(Lazy) Filter", 'ns.get("key")',
        "ARGS=[1]", "Description: picks", "     Description: rows", "   --> Clear all storage", '   --> Load df from key "q"', " ... ",
    ):
        assert part in text, part
    assert "PARAMS" not in p.to_string() and "@" in p.to_string(add_ids=True)
    source = p.to_dot(show_params=True, add_description=True)
    assert source.startswith("digraph") and "diamond" in source and source.count("->") > 10


def test_config_and_hooks(df, caplog):
    with pytest.raises(KeyError):
        PipelineConfig["nothing"]
    PipelineConfig.verbose = False
    assert PipelineConfig["verbose"] is False
    PipelineConfig.reset()
    with caplog.at_level(logging.INFO, "weftline.pipeline"):
        TransformerPipeline([lit("a", 1)], name="named").run(df, show_params=True)
    assert "PARAMS" in caplog.text and "named" in caplog.text
    caplog.clear()
    TransformerPipeline([lit("a", 1)]).run(df, hooks=LoggingHooks(), verbose=False)


def test_loops():
    config = {
        "name": "<<kept>>",
        "pipeline": [
            {"loop": {"values": {"a": [1, 2], "b": ["x", "y"]}, "transformer": "T", "params": {"k<<b>>": "<<a>>", "t": "v<<a>>", "n": "<<zz>>"}}},
            {"loop": {"mode": "product", "values": {"p": [1, 2], "q": [3, 4]}, "transformer": "U", "params": {"v": ["<<p>>", "<<q>>"]}}},
            {"skip": True, "loop": {"values": {"a": [1]}, "transformer": "X"}},
            {"loop": {"values": {"o": ["out"], "i": ["outer"]}, "pipeline": [{"loop": {"values": {"i": ["inner"]}, "transformer": "<<i>>", "params": {"o": "<<o>>"}}}, {"perform": False, "loop": {"values": {"a": [1]}, "transformer": "X"}}]}},
        ],
    }
    got = expand_loops(config)
    assert got["name"] == "<<kept>>"
    assert got["pipeline"][0] == {"transformer": "T", "params": {"kx": 1, "t": "v1", "n": "<<zz>>"}}
    assert [s["params"]["v"] for s in got["pipeline"][2:6]] == [[1, 3], [1, 4], [2, 3], [2, 4]]
    assert got["pipeline"][6] == {"pipeline": [{"transformer": "inner", "params": {"o": "out"}}]} and len(got["pipeline"]) == 7
    for error, loop in [
        (KeyError, {}), (TypeError, {"values": [1]}), (TypeError, {"values": {"a": 1}}), (ValueError, {"values": {}}), (ValueError, {"values": {"a": []}}),
        (ValueError, {"values": {"a": [1]}, "mode": "odd"}), (TypeError, {"values": {"a": [1]}, "mode": 1}), (ValueError, {"values": {"a": [1], "b": [1, 2]}}),
    ]:
        with pytest.raises(error):
            expand_loops({"pipeline": [{"loop": loop}]})


def test_loader(df, store):
    class Mine:
        """A user's transformer."""

        def __init__(self, *, to):
            self.to = to

        def transform(self, d):
            return d.withColumn("mine", F.lit(self.to))

    def half(d):
        return {"low": d.filter("idx < 5"), "hi": d.filter("idx >= 5")}

    def twice(d, n=2):
        return d.withColumn("idx", F.col("idx") * n)

    config = {
        "name": "main",
        "pipeline": [
            {"function": "twice", "kwargs": {"n": 3}, "description": "times three"},
            {"function": "twice", "skip": True},
            {
                "pipeline": {"low": {"transformer": "Mine", "params": {"to": "low"}}, "hi": [{"transformer": "Mine", "lazy": True, "params": {"to": "__ns__word"}}]},
                "split_function": "half",
                "split_order": ["low", "hi"],
                "interleaved": [{"transformer": "AssertNotEmpty"}],
                "split_apply_before_appending": [{"function": "twice", "args": [1]}],
            },
            {"store": "result"},
            {"pipeline": [{"transformer": "Nothing"}], "skip": True},
            {"pipeline": [{"transformer": "AddLiterals", "params": {"data": [{"alias": "mine", "value": "null"}]}}], "apply_to_rows": {"input_col": "v", "operator": "is_null"}, "otherwise": [{"function": "twice", "kwargs": {"n": 1}}]},
            "to_native",
        ],
    }
    store.set("word", "high")
    p = load_pipeline(config, extra_functions=[half, twice], extra_transformers={"Mine": Mine}, store=store)
    got = {r.idx: r.mine for r in p.run(df, verbose=False).collect()}
    assert got == {i * 3: "null" if i in (3, 7) else ("low" if i * 3 < 5 else "high") for i in range(10)}
    assert store.get("result").count() == 10
    assert load_pipeline([{"transformer": "Persist"}]).name is None
    for error, bad in [
        (NameError, [{"transformer": "Nothing"}]), (NameError, [{"function": "nothing"}]), (TypeError, 5), (AssertionError, {"name": "x"}), (AssertionError, {"pipeline": [], "what": 1}),
        (TypeError, [{"what": 1}]), (AssertionError, {"pipeline": [], "split_function": "half"}), (AssertionError, {"pipeline": {"loop": [], "hi": []}, "split_function": "half"}),
        (TypeError, [{"function": "half", "args": 5}]), (ValueError, [{"transformer": "AssertCount", "params": {}}]),
    ]:
        with pytest.raises(error):
            load_pipeline(bad, extra_functions=half, evaluate_loops=False)


def test_nested_pipelines_are_transformers(df):
    inner = TransformerPipeline([lit("a", 1), lit("b", 2)], name="in")
    assert TransformerPipeline([inner, inner]).run(df, verbose=False).columns[3:] == ["a", "b"]
    assert inner.transform(df).columns[3:] == ["a", "b"]

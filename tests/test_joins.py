import pytest

from weftline.functions.frames import is_broadcast
from weftline.operators import Join, join_dataframes
from weftline.sources import Storage


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 0)], "id int, v string, x int")
    right = spark.createDataFrame([(2, "B", 1.0), (3, "C", 2.0), (None, "N", 3.0)], "id int, v string, y double")
    return left, right


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    ("how", "columns", "want"),
    [
        ("inner", ["id", "v", "x", "v_right", "y"], [(2, "b", 20, "B", 1.0)]),
        ("left", ["id", "v", "x", "v_right", "y"], [(1, "a", 10, None, None), (2, "b", 20, "B", 1.0), (None, "n", 0, None, None)]),
        ("right", ["id", "v", "y", "v_right", "x"], [(2, "B", 1.0, "b", 20), (3, "C", 2.0, None, None), (None, "N", 3.0, None, None)]),
        ("semi", ["id", "v", "x"], [(2, "b", 20)]),
        ("anti", ["id", "v", "x"], [(1, "a", 10), (None, "n", 0)]),
        ("rightsemi", ["id", "v", "y"], [(2, "B", 1.0)]),
        ("right_anti", ["id", "v", "y"], [(3, "C", 2.0), (None, "N", 3.0)]),
        ("full", ["id", "v", "x", "v_right", "y"], [(1, "a", 10, None, None), (2, "b", 20, "B", 1.0), (3, None, None, "C", 2.0), (None, "n", 0, None, None), (None, None, None, "N", 3.0)]),
    ],
)
def test_on(sides, how, columns, want):
    out = join_dataframes(*sides, how=how, on="id")
    assert out.columns == columns and rows(out) == sorted(want, key=str)


def test_other_names(sides, spark):
    left, right = sides
    right = right.withColumnRenamed("id", "key")
    assert join_dataframes(left, right, how="left", left_on="id", right_on="key").columns == ["id", "v", "x", "v_right", "y"]
    assert join_dataframes(left, right, how="right", left_on="id", right_on="key").columns == ["key", "v", "y", "v_right", "x"]
    assert join_dataframes(left, right, how="full", left_on="id", right_on="key", suffix="_2").columns == ["id", "v", "x", "key", "v_2", "y"]
    assert join_dataframes(left, sides[1], how="full", on="id", coalesce_keys=False).columns == ["id", "v", "x", "id_right", "v_right", "y"]
    cross = join_dataframes(left, right, how="cross")
    assert cross.columns == ["id", "v", "x", "key", "v_right", "y"] and cross.count() == 9


def test_self_join(sides):
    left, _ = sides
    counts = left.groupBy("v").count()
    assert join_dataframes(left, counts, how="left", on="v").columns == ["id", "v", "x", "count"]
    assert join_dataframes(left, left, how="inner", on="id").columns == ["id", "v", "x", "v_right", "x_right"]
    assert join_dataframes(left, left, how="semi", on="id").count() == 2


def test_transformer_and_hint(sides):
    store = Storage()
    store.set("r", sides[1])
    assert is_broadcast(Join(store_key="r", how="left", on="id", broadcast=True, store=store).transform(sides[0]))


@pytest.mark.parametrize("bad", [{"how": "outer", "on": "id"}, {"how": "inner"}, {"how": "cross", "on": "id"}, {"how": "left", "on": "id", "left_on": "id"}, {"how": "left", "left_on": "id"}, {"how": "left", "left_on": ["a"], "right_on": ["b", "c"]}])
def test_rules(bad):
    with pytest.raises(ValueError):
        Join(store_key="r", **bad)

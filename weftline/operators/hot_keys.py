"""Joins in which a few keys have most rows.

Spark splits a large partition of one side where the kind of join allows it, but not where both sides are large at a key, and not in full
joins. Here a frequency sketch of each side, merged over tasks, gives the keys that may be too many for a task; they are then
counted exactly. A key that both sides have needs no rows of nulls, whatever the kind of join, so that its rows are dealt over a
grid: each row of one side to one line of it, and to all columns. Rows of keys that only one side has, or of null keys, are not joined at all.
All other keys are joined as usual.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of these types are compared alike by Spark and on the driver.
KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType, T.DateType, T.DecimalType)
#: Keys that a sketch tells, and those that it tracks for that.
MOST_HOT, TRACKED = 1000, 10_000
KINDS = ("inner", "left", "full")

BOTH, ONE = "both", "one"


def can_spread(first: DataFrame, second: DataFrame, mine: list[str], other: list[str], kind: str) -> bool:
    types = [(first.schema[a].dataType, second.schema[b].dataType) for a, b in zip(mine, other, strict=True)]
    return kind in KINDS and all(a == b and isinstance(a, KEY_TYPES) for a, b in types) and not (first.isStreaming or second.isStreaming)


def _frequent(df: DataFrame, keys: list[str], tasks: int) -> tuple[int, list[int]]:
    """The number of rows, and the hashes of keys that may have more rows than there are for a task."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    top = F.call_function("approx_top_k", F.xxhash64(*keys), F.lit(min(tasks, MOST_HOT)), F.lit(TRACKED))
    r = df.filter(known).select(*keys).agg(F.count(F.lit(1)).alias("n"), top.alias("top")).first()
    return r["n"], [x["item"] for x in r["top"] or [] if x["count"] * tasks > r["n"]]


def hot_keys(first: DataFrame, second: DataFrame, mine: list[str], other: list[str]) -> tuple[dict[tuple, tuple[int, int]], tuple[int, int], int]:
    """(rows of each hot key on both sides, rows of both sides, tasks). A key is hot if it has more rows of a side than there are for a task."""
    tasks = int(first.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (n, a), (m, b) = _frequent(first, mine, tasks), _frequent(second, other, tasks)
    hashes = sorted({*a, *b})
    if not hashes:
        return {}, (n, m), tasks
    counted: list[dict[tuple, int]] = []
    for df, keys in ((first, mine), (second, other)):
        rows = df.filter(F.xxhash64(*keys).isin(hashes)).groupBy(*keys).agg(F.count(F.lit(1)).alias("weftline__n")).collect()  # two thousand keys at most
        counted.append({tuple(r[k] for k in keys): r["weftline__n"] for r in rows})
    found = {k: (counted[0].get(k, 0), counted[1].get(k, 0)) for k in {*counted[0], *counted[1]}}
    return {k: v for k, v in found.items() if v[0] * tasks > n or v[1] * tasks > m}, (n, m), tasks


def _marked(df: DataFrame, keys: list[str], hot: list[tuple]) -> DataFrame:
    """``df`` with what is known of each row's key: null for keys as any other, ``one`` for those of one side and null ones, ``both`` with the grid's lines and columns."""
    schema = T.StructType([*[T.StructField(f"weftline__h{i}", df.schema[k].dataType) for i, k in enumerate(keys)], *T.StructType.fromDDL("weftline__kind string, weftline__lines int, weftline__columns int").fields])
    table = df.sparkSession.createDataFrame(hot, schema)
    out = df.join(F.broadcast(table), reduce(lambda a, b: a & b, [F.col(k) == F.col(f"weftline__h{i}") for i, k in enumerate(keys)]), "left")
    null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    return out.withColumn("weftline__kind", F.when(null, ONE).otherwise(F.col("weftline__kind"))).drop(*[f"weftline__h{i}" for i in range(len(keys))])


def _part(df: DataFrame, kind: Column) -> DataFrame:
    return df.filter(kind).drop("weftline__kind", "weftline__lines", "weftline__columns")


def _dealt(df: DataFrame, own: str, copied: str, names: tuple[str, str]) -> DataFrame:
    """Rows of keys of both sides, each in one place along ``own`` and in all along ``copied``."""
    place = F.pmod(F.monotonically_increasing_id(), F.col(own)).cast("int").alias(names[0])
    every = F.explode(F.sequence(F.lit(0), F.col(copied) - 1)).alias(names[1])
    dealt = df.filter(F.col("weftline__kind") == BOTH).withColumn(names[0], place)
    return dealt.select(*[F.col(f"`{c}`") for c in dealt.columns if not c.startswith(("weftline__kind", "weftline__lines", "weftline__columns"))], every)


def spread_join(first: DataFrame, second: DataFrame, mine: list[str], other: list[str], kind: str) -> DataFrame:
    """As ``first.join(second, ..., kind)`` by equal keys, inner, left or full; all columns of both sides have names of their own."""
    equal = lambda a, b: reduce(lambda x, y: x & y, [a[p] == b[q] for p, q in zip(mine, other, strict=True)])
    hot, (n, m), tasks = hot_keys(first, second, mine, other)
    if not hot:
        return first.join(second, equal(first, second), kind)
    lines = lambda count, total: max(1, min(tasks, -(-count * tasks // max(total, 1))))
    table: list[tuple[Any, ...]] = [(*k, BOTH if a and b else ONE, lines(a, n), lines(b, m)) for k, (a, b) in hot.items()]
    left, right = _marked(first, mine, table), _marked(second, other, table)
    columns = [*first.columns, *second.columns]
    rest = F.col("weftline__kind").isNull()
    usual_left, usual_right = _part(left, rest), _part(right, rest)
    parts = [usual_left.join(usual_right, equal(usual_left, usual_right), kind)]
    a, b = _dealt(left, "weftline__lines", "weftline__columns", ("weftline__la", "weftline__lb")), _dealt(right, "weftline__columns", "weftline__lines", ("weftline__rb", "weftline__ra"))
    grid = a.join(b, equal(a, b) & (F.col("weftline__la") == F.col("weftline__ra")) & (F.col("weftline__lb") == F.col("weftline__rb")), "inner")
    parts.append(grid.select(*[F.col(f"`{c}`") for c in columns]))
    alone = F.col("weftline__kind") == ONE
    if kind in ("left", "full"):
        parts.append(_part(left, alone).select(*[F.col(f"`{c}`") for c in first.columns], *[F.lit(None).cast(f.dataType).alias(f.name) for f in second.schema.fields]))
    if kind == "full":
        parts.append(_part(right, alone).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in first.schema.fields], *[F.col(f"`{c}`") for c in second.columns]))
    return reduce(DataFrame.union, parts)

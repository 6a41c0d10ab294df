"""Distinct counts over windows, without a set of values for each row.

The value of a row counts in the frames that hold the row but not the row before it with the same value. These frames belong to a
stretch of rows: from where the row comes in, or the earlier one has gone out, to where it goes out itself. So each row adds one at the first
of them and takes one away behind the last, and a running sum of these changes is the number of distinct values.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.ordered import ROW, By, Frame, Near, number
from weftline.functions.selectors import col

#: Places before, at and behind the rows of one position.
BEFORE, AT, BEHIND = 0, 1, 2


def over_partition(df: DataFrame, keys: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """``df`` with, for each alias, the number of distinct values of a column in the row's partition, nulls not counted: a grouped count, joined back."""
    if not keys:
        return df.withColumns({a: df.agg(F.count_distinct(c)).scalar() for a, c in columns.items()})
    other = [f"weftline__k{i}" for i in range(len(keys))]
    counts = df.groupBy(*[col(k).alias(o) for k, o in zip(keys, other, strict=True)]).agg(*[F.count_distinct(c).alias(f"weftline__n{i}") for i, c in enumerate(columns.values())])
    alike = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, other, strict=True)])
    joined = df.join(counts, alike, "left")
    return joined.select(*[col(c) for c in df.columns if c not in columns], *[F.col(f"weftline__n{i}").alias(a) for i, a in enumerate(columns)])


def over_frame(df: DataFrame, keys: Sequence[str], order: Sequence[By], alias: str, c: Column, lo: Any, hi: Any, by_value: bool) -> DataFrame:
    """``df`` with the number of distinct values of ``c``, nulls not counted, over a frame of each row as column ``alias``.

    The frame goes from ``lo`` to ``hi``, None for no bound: so many rows from the row, or with ``by_value`` so much of the one order
    column from its value, where (None, 0) is also allowed for several order columns of any kind. A frame by value without a lower
    bound and with 0 above has the peers of the row too. Without ``keys``, no task holds all rows.
    """
    if lo is None and hi is None:
        return over_partition(df, keys, {alias: c})
    if by_value and hi is None and lo == 0:
        return over_frame(df, keys, [o.reversed() for o in order], alias, c, None, 0, True)
    plain = by_value and lo is None and hi == 0  # places are compared in the order itself, and not moved
    fields = [f"p{i}" for i in range(len(order) if plain else 1)]
    own = [F.col(f"weftline__k{i}") for i in range(len(keys))]
    row = F.struct(*[col(x) for x in df.columns if x != alias]).alias("weftline__row_")
    base = df.select(row, c.alias("weftline__v"), *[col(k).alias(f"weftline__k{i}") for i, k in enumerate(keys)], *[o.c.alias(f"weftline__o{i}") for i, o in enumerate(order)])
    directed = [o.directed(F.col(f"weftline__o{i}")) for i, o in enumerate(order)]
    if keys:
        base = base.withColumn(ROW, F.row_number().over(Window.partitionBy(*own).orderBy(*directed)))
    else:
        base, _ = number(base, directed)
    if not by_value:
        position = {"p0": F.col(ROW).cast("bigint")}
    elif plain:
        position = {f: F.col(f"weftline__o{i}") for i, f in enumerate(fields)}
    else:
        position = {"p0": -F.col("weftline__o0") if order[0].descending else F.col("weftline__o0")}
    base = base.withColumn("weftline__pos", F.struct(*[p.alias(f) for f, p in position.items()]))
    pos = F.col("weftline__pos")
    base = _last_seen(base, own, pos)
    before = F.col("weftline__before")
    if by_value and lo is not None and hi is not None:  # rows without an order value are peers of each other alone
        before = F.when(before["p0"].isNull() == pos["p0"].isNull(), before)
    at = lambda p, by, phase: F.struct(*[(p[f] - F.lit(by) if by else p[f]).alias(f) for f in fields], F.lit(phase).alias("phase"))
    if lo is None:  # a row once in is never out again: the first of equal values counts
        up, down, counts = at(pos, hi, BEFORE), None, F.col("weftline__v").isNotNull() & F.col("weftline__before").isNull()
    else:
        gone = F.when(before.isNotNull(), at(before, lo, BEHIND))
        up = gone if hi is None else F.greatest(at(pos, hi, BEFORE), gone)
        down, counts = at(pos, lo, BEHIND), F.col("weftline__v").isNotNull()
    nothing = F.lit(None).cast(base.schema["weftline__row_"].dataType)
    event = lambda place, change, held: F.struct(place.alias("place"), F.lit(change).cast("bigint").alias("change"), held.alias("held"))
    changes = [event(p, n, nothing) for p, n in ((up, 1), (down, -1)) if p is not None]
    events = F.filter(F.array(event(at(pos, 0, AT), 0, F.col("weftline__row_")), *changes), lambda e: (e["change"] == 0) | counts)
    spread = base.select(*own, F.explode(events).alias("e")).select(*own, "e.place", "e.change", "e.held")
    place = F.col("place")
    ways = [By(place.isNotNull())]  # a place before all has none
    for i, f in enumerate(fields):
        ways.append(By(place[f], order[i].descending, order[i].nulls_last) if plain else By(place[f], nulls_last=by_value and order[0].last))
    ways.append(By(place["phase"]))
    if keys:
        summed = spread.withColumn("total", F.sum("change").over(Window.partitionBy(*own).orderBy(*[o.directed() for o in ways])))
    else:
        frame = Frame(spread, ways)
        frame.add("total", frame.aggregate("sum", F.col("change"), None, 0), peers=True)
        summed = frame.result()
    return summed.filter(F.col("held").isNotNull()).select(*[F.col("held")[x].alias(x) for x in df.columns if x != alias], F.col("total").alias(alias))


def _last_seen(base: DataFrame, keys: list[Column], pos: Column) -> DataFrame:
    """The position of the row before with the same value in the partition, as column weftline__before."""
    v, row = F.col("weftline__v"), F.col(ROW)
    if keys:
        return base.withColumn("weftline__before", F.lag(pos).over(Window.partitionBy(*keys, v).orderBy(row)))
    frame = Frame(base.withColumnRenamed(ROW, "weftline__n"), [By(v), By(F.col("weftline__n"))])
    near = frame.want(Near(lambda w: F.lag(F.struct(v.alias("v"), pos.alias("pos"))).over(w), 1, 0))
    frame.add("weftline__near", near)
    out = frame.result().withColumnRenamed("weftline__n", ROW)
    return out.withColumn("weftline__before", F.when(F.col("weftline__near")["v"].eqNullSafe(v), F.col("weftline__near")["pos"])).drop("weftline__near")

"""Aggregates and lags over windows.

With partition columns these are Spark's windows, one partition in one task. Without them the order is of all rows: frames of rows, and
frames by value from the start or to the end, are spread over tasks (see weftline.functions.ordered). What is left to a window over all rows,
with a warning, are frames so much of a value wide, and lists and sets of all rows up to each, which grow with the square of the rows.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import distinct
from weftline.functions.ordered import By, Deferred, Frame, Near, with_deferred
from weftline.functions.selectors import as_list, col
from weftline.operators.base import Transformer, projection

log = logging.getLogger("weftline.window")

Names = str | Iterable[str] | None

WINDOW_AGGREGATES = {
    "avg": F.avg, "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "first": F.first, "last": F.last, "count": F.count,
    "stddev": F.stddev, "variance": F.variance, "collect_list": F.collect_list, "collect_set": F.collect_set,
}
COUNT_DISTINCT = "countDistinct"
#: Aggregates that hold all values of a frame.
COLLECTIONS = ("collect_list", "collect_set")
#: Frames of fewer rows, of values of these types, are held to count distinct ones; other values may be equal and not the same, as 0.0 and -0.0.
NARROW, HELD = 64, (T.StringType(), T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.DateType(), T.TimestampType(), T.BooleanType())


def _bounds(pair: Any, name: str) -> tuple[int, int]:
    if not isinstance(pair, (list, tuple)) or len(pair) != 2 or None in pair:
        raise ValueError(f"'{name}' is a pair of bounds, each an integer, or 'start' on the left, 'end' on the right")
    ends = {("start", 0): Window.unboundedPreceding, ("end", 1): Window.unboundedFollowing}
    out = []
    for i, b in enumerate(pair):
        if isinstance(b, str):
            if (b, i) not in ends:
                raise ValueError(f"'{name}': '{b}' is no bound there")
            b = ends[b, i]
        out.append(int(b))
    return out[0], out[1]


class _Window(Transformer):
    """Partition, order and frame. NULLs come first where ascending, last where not."""

    def _prepare(self, partition_cols: Names, order_cols: Names, ascending: bool | list[bool], rows_between: Any = None, range_between: Any = None) -> None:
        self._partition, self._order = as_list(partition_cols), as_list(order_cols)
        up = [ascending] * len(self._order) if isinstance(ascending, bool) else list(ascending)
        if len(up) == 1:
            up = up * len(self._order)
        if self._order and len(up) != len(self._order):
            raise ValueError("'ascending' is one value or one for each order column")
        if rows_between is not None and range_between is not None:
            raise AssertionError("give at most one of 'rows_between' and 'range_between'")
        if range_between is not None and not self._order:
            raise ValueError("'range_between' needs 'order_cols'")
        self._up = up
        self._rows = _bounds(rows_between, "rows_between") if rows_between is not None else None
        self._range = _bounds(range_between, "range_between") if range_between is not None else None

    def _by(self) -> list[By]:
        return [By(col(c), not u) for c, u in zip(self._order, self._up, strict=True)] if self._order else []

    def _frame(self) -> tuple[int | None, int | None]:
        """The bounds, None where there is none; an order without a frame ends with the peers of the row, no order has all rows."""
        given = self._rows or self._range or ((Window.unboundedPreceding, 0) if self._order else (Window.unboundedPreceding, Window.unboundedFollowing))
        return None if given[0] == Window.unboundedPreceding else given[0], None if given[1] == Window.unboundedFollowing else given[1]

    def _by_value(self) -> bool | None:
        """Whether the frame is one of values; None where it is so much of a value wide."""
        if self._rows or self._frame() == (None, None):
            return False
        return True if self._frame() in ((None, 0), (0, None)) else None

    def _window(self) -> Any:
        w = Window.partitionBy(*map(col, self._partition))
        if self._order:
            w = w.orderBy(*[col(c).asc() if u else col(c).desc() for c, u in zip(self._order, self._up, strict=True)])
        if self._rows:
            w = w.rowsBetween(*self._rows)
        if self._range:
            w = w.rangeBetween(*self._range)
        return w


class AggregateOverWindow(_Window):
    """Aggregates over one window, all in one projection; an alias that is a column already replaces it, at the end."""

    def __init__(
        self,
        *,
        aggregations: dict[str, str] | list[dict[str, str]],
        partition_cols: Names = None,
        order_cols: Names = None,
        ascending: bool | list[bool] = True,
        rows_between: Any = None,
        range_between: Any = None,
    ):
        self._aggregations = [aggregations] if isinstance(aggregations, dict) else list(aggregations)
        for a in self._aggregations:
            if set(a) != {"agg", "col", "alias"}:
                raise KeyError(f"a window aggregation has exactly 'agg', 'col' and 'alias': {a}")
            if a["agg"] not in WINDOW_AGGREGATES and a["agg"] != COUNT_DISTINCT:
                raise ValueError(f"unknown aggregate '{a['agg']}'; known are {sorted([*WINDOW_AGGREGATES, COUNT_DISTINCT])}")
        self._prepare(partition_cols, order_cols, ascending, rows_between, range_between)
        if clash := {a["alias"] for a in self._aggregations} & {*self._partition, *self._order}:
            raise AssertionError(f"aliases {sorted(clash)} are partition or order columns")

    def _transform(self, df: DataFrame) -> DataFrame:
        names = [a["alias"] for a in self._aggregations]
        if set(names) & set(df.columns):
            log.warning("columns replaced by aggregates: %s", sorted(set(names) & set(df.columns)))
        # aggregates read the frame's own columns, so that replaced ones go at the end
        made = {f"weftline__a{i}": a for i, a in enumerate(self._aggregations)}
        counts = {n: col(a["col"]) for n, a in made.items() if a["agg"] == COUNT_DISTINCT}
        shared = {n: c for n, c in counts.items() if self._counts_in_frame(df, c)}
        out = self._spread(df, {n: a for n, a in made.items() if n not in counts}, shared)
        out = self._count_distinct(out, {n: c for n, c in counts.items() if n not in shared})
        return out.select(*[col(c) for c in df.columns if c not in names], *[F.col(n).alias(a["alias"]) for n, a in made.items()])

    def _counts_in_frame(self, df: DataFrame, c: Column) -> bool:
        """Whether distinct values are counted in one pass with the other aggregates of all rows."""
        (lo, hi), by_value = self._frame(), self._by_value()
        if self._partition or by_value is None or lo is None and hi is None:
            return False
        return lo is None or hi is None or 0 <= hi - lo < NARROW and df.select(c).schema[0].dataType in HELD

    def _spread(self, df: DataFrame, made: dict[str, dict[str, str]], counts: dict[str, Column]) -> DataFrame:
        by_value = self._by_value()
        whole = self._frame() == (None, None)
        if made and whole and not self._partition and not (self._order and any(a["agg"] in ("first", "last") for a in made.values())):
            return df.withColumns({n: df.agg(WINDOW_AGGREGATES[a["agg"]](col(a["col"]))).scalar() for n, a in made.items()})  # aggregates of the frame
        one_task = not self._partition and (by_value is None or (any(a["agg"] in COLLECTIONS for a in made.values()) and None in self._frame()))
        if made and (self._partition or one_task):
            if one_task:
                log.warning("a window over all rows in one task: %s", sorted({a["agg"] for a in made.values()}))
            w = self._window()
            df, made = df.withColumns({n: WINDOW_AGGREGATES[a["agg"]](col(a["col"])).over(w) for n, a in made.items()}), {}
        if not made and not counts:
            return df
        lo, hi = self._frame()
        to_end = by_value and lo == 0 and hi is None  # as from the start in the reversed order
        order = [o.reversed() for o in self._by()] if to_end else self._by()
        frame = Frame(df, order)
        for n, a in made.items():
            agg = {"mean": "avg"}.get(a["agg"], a["agg"])
            if to_end:
                agg = {"first": "last", "last": "first"}.get(agg, agg)
            frame.add(n, frame.aggregate(agg, col(a["col"]), *((None, 0) if to_end else (lo, hi))), peers=bool(by_value) and not whole)
        for n, c in counts.items():
            frame.add(n, frame.distinct(c, *((None, 0) if to_end else (lo, hi))), peers=bool(by_value))
        return frame.result()

    def _count_distinct(self, df: DataFrame, made: dict[str, Column]) -> DataFrame:
        lo, hi = self._frame()
        if (lo, hi) == (None, None):
            return distinct.over_partition(df, self._partition, made) if made else df
        for n, c in made.items():
            df = distinct.over_frame(df, self._partition, self._by(), n, c, lo, hi, self._by_value() is not False)
        return df


class LagOverWindow(_Window):
    """The value ``lag`` rows before, or after where negative. A lag has no frame, so that giving one is an error."""

    def __init__(
        self,
        *,
        lag_col: str,
        lag: int,
        output_col: str,
        partition_cols: Names = None,
        order_cols: Names = None,
        ascending: bool | list[bool] = True,
        rows_between: Any = None,
        range_between: Any = None,
    ):
        if rows_between is not None or range_between is not None:
            raise ValueError("a lag takes no frame")
        if not as_list(order_cols):
            raise ValueError("a lag needs 'order_cols'")
        self._prepare(partition_cols, order_cols, ascending)
        self._lag_col, self._lag, self._output = lag_col, int(lag), output_col

    def _transform(self, df: DataFrame) -> DataFrame:
        n, value = self._lag, col(self._lag_col)
        if self._partition:
            return projection(df, {self._output: F.lag(value, n).over(self._window())})
        return with_deferred(df, {self._output: Deferred(tuple(self._by()), lambda frame: frame.want(Near(lambda w: F.lag(value, n).over(w), max(0, n), max(0, -n))))})

"""Pivot, unpivot and explode."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.selection import Quantile, can_select, with_quantiles
from weftline.functions.selectors import any_selector, as_list, col, quoted, select_columns
from weftline.operators.base import Transformer

Names = str | Iterable[str] | None

#: Output columns beyond which, and for medians, a pivot aggregates cells first and then lays them out.
WIDE = 200

PIVOT_AGGREGATES = {"min": F.min, "max": F.max, "first": F.first, "last": F.last, "sum": F.sum, "mean": F.avg, "median": F.median, "len": None}


def _laying_out(n: int, n_values: int, fill: Any) -> Callable:
    """Rows with a list of (place, values) last, to rows with a column for each place of each value: one plan node, however many columns."""
    rows_at_once = max(1, 2_000_000 // (n * n_values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(start, rows_at_once)
                lists = part.column(part.num_columns - 1)
                cells = lists.flatten()
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                place = cells.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                order = np.argsort(place, kind="stable")
                cuts = np.searchsorted(place[order], np.arange(n + 1))
                made = []
                for v in range(n_values):
                    child = cells.field(1 + v)
                    for k in range(n):
                        own = order[cuts[k] : cuts[k + 1]]
                        at = np.full(part.num_rows, -1)
                        at[row[own]] = own
                        taken = child.take(pa.array(at, mask=at < 0))
                        made.append(taken if fill is None else taken.fill_null(fill))
                columns = [*part.columns[:-1], *made]
                yield pa.RecordBatch.from_arrays(columns, [f"c{i}" for i in range(len(columns))])

    return run


class Pivot(Transformer):
    """A column for each value of ``pivot_col``, aggregated by the id columns.

    With one value column an output is named by the pivot value, else by value column, separator and pivot value. Values are
    found by one job and sorted, NULL first as "null", unless ``pivot_values`` gives them. Few columns are one aggregation with conditions, so that Spark combines
    rows before the shuffle. More than WIDE are aggregated by id and pivot value, whatever their number, and then laid out by position, in Arrow batches. Medians are selected exactly without a task that
    holds a cell's values, as GroupBy does. ``first`` and ``last`` depend on how rows lie.
    """

    def __init__(
        self,
        *,
        pivot_col: str,
        id_cols: Names = None,
        id_regex: str | None = None,
        id_glob: str | None = None,
        id_startswith: Names = None,
        id_endswith: Names = None,
        aggregate_function: str = "first",
        values_cols: Names = None,
        values_regex: str | None = None,
        values_glob: str | None = None,
        values_startswith: Names = None,
        values_endswith: Names = None,
        separator: str = "_",
        pivot_values: list | None = None,
        max_values: int = 10_000,
    ):
        if aggregate_function not in PIVOT_AGGREGATES:
            raise ValueError(f"unknown aggregate '{aggregate_function}'; known are {sorted(PIVOT_AGGREGATES)}")
        self._ids = {"columns": id_cols, "regex": id_regex, "glob": id_glob, "startswith": id_startswith, "endswith": id_endswith}
        if not any_selector(**self._ids):
            raise AssertionError("select id columns")
        self._values = {"columns": values_cols, "regex": values_regex, "glob": values_glob, "startswith": values_startswith, "endswith": values_endswith}
        self._pivot, self._aggregate, self._separator, self._known, self._most = pivot_col, aggregate_function, separator, pivot_values, max_values

    def _found(self, df: DataFrame) -> list:
        """The pivot values, sorted; ValueError where there are too many to be columns."""
        key = col(self._pivot)
        found = [r[0] for r in df.select(key).distinct().limit(self._most + 1).collect()]
        if len(found) > self._most:
            raise ValueError(f"'{self._pivot}' has more than {self._most} values; give 'pivot_values' or raise 'max_values'")
        return [None] * (None in found) + sorted(v for v in found if v is not None)

    def _name(self, value: str, pivot: Any, n: int) -> str:
        text = "null" if pivot is None else str(pivot)
        return text if n == 1 else f"{value}{self._separator}{text}"

    def _selected(self, df: DataFrame, values: list[str]) -> bool:
        return self._aggregate == "median" and not df.isStreaming and all(can_select(df.schema[v].dataType) for v in values)

    def _laid_out(self, df: DataFrame, ids: list[str], values: list[str], found: list) -> DataFrame:
        """A row for each id and pivot value, with the value's position, first; then a row for each id. Values that are not given have no position."""
        place, n = F.col("weftline__place"), len(found)
        if self._known is None:
            schema = T.StructType([T.StructField("weftline__value", df.schema[self._pivot].dataType), T.StructField("weftline__place", T.IntegerType())])
            places = df.sparkSession.createDataFrame([(p, k) for k, p in enumerate(found)], schema)
        else:  # their type may be another one, which the comparison settles
            places = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, found))).alias("weftline__place", "weftline__value"))
        at = df.join(F.broadcast(places), col(self._pivot).eqNullSafe(F.col("weftline__value")), "left")
        cells, names = [*map(col, ids), place], [f"weftline__v{i}" for i in range(len(values))]
        if self._selected(df, values):
            made = at.select(*cells).distinct()
            made = with_quantiles(made, at, [*ids, "weftline__place"], [Quantile(a, v) for a, v in zip(names, values, strict=True)])
        else:
            aggregate = PIVOT_AGGREGATES[self._aggregate] or (lambda _: F.count(F.lit(1)))
            made = at.groupBy(*cells).agg(*[aggregate(col(v)).alias(a) for a, v in zip(names, values, strict=True)])
        row = F.collect_list(F.when(place.isNotNull(), F.struct(place.alias("place"), *names)))
        lists = made.groupBy(*map(col, ids)).agg(row.alias("weftline__row"))
        fields = [T.StructField(self._name(v, p, len(values)), made.schema[a].dataType) for v, a in zip(values, names, strict=True) for p in found]
        fill = 0 if self._aggregate == "len" else None
        return lists.mapInArrow(_laying_out(n, len(values), fill), T.StructType([*[df.schema[c] for c in ids], *fields]))

    def _transform(self, df: DataFrame) -> DataFrame:
        ids = select_columns(df.columns, **self._ids)
        values = select_columns(df.columns, **self._values) if any_selector(**self._values) else [c for c in df.columns if c not in ids and c != self._pivot]
        key = col(self._pivot)
        found = self._known if self._known is not None else self._found(df)
        if values and found and (len(values) * len(found) > WIDE or self._selected(df, values)):
            return self._laid_out(df, ids, values, found)
        aggs = []
        for v in values:
            for p in found:
                cond = key.isNull() if p is None else key == F.lit(p)
                name = self._name(v, p, len(values))
                if self._aggregate == "len":
                    agg = F.count(F.when(cond, F.lit(1)))
                elif self._aggregate in ("first", "last"):
                    # rows of other pivot values are NULL here; the struct tells them from NULL values
                    agg = PIVOT_AGGREGATES[self._aggregate](F.when(cond, F.struct(col(v).alias("v"))), ignorenulls=True)["v"]
                else:
                    agg = PIVOT_AGGREGATES[self._aggregate](F.when(cond, col(v)))
                aggs.append(agg.alias(name))
        grouped = df.groupBy(*map(col, ids))
        return grouped.agg(*aggs) if aggs else df.select(*map(col, ids)).distinct()


class Unpivot(Transformer):
    """Columns to rows of name and value; columns that are neither ids nor melted go, NULL values stay. Values of several types become texts."""

    def __init__(
        self, *, id_cols: Names = None, id_regex: str | None = None, melt_cols: Names = None, melt_regex: str | None = None, variable_col: str = "variable", value_col: str = "value"
    ):
        if melt_cols is None and melt_regex is None:
            raise AssertionError("select columns to melt")
        self._ids, self._melt = {"columns": id_cols, "regex": id_regex}, {"columns": melt_cols, "regex": melt_regex}
        self._variable, self._value = variable_col, value_col

    def _transform(self, df: DataFrame) -> DataFrame:
        ids, melted = select_columns(df.columns, **self._ids), select_columns(df.columns, **self._melt)
        if not melted:
            none = F.lit(None).cast("string")
            return df.select(*map(col, ids), none.alias(self._variable), none.alias(self._value)).limit(0)
        kinds = {df.schema[c].dataType.simpleString() for c in melted}
        if len(kinds) > 1:
            df = df.select(*map(col, [c for c in ids if c not in melted]), *[col(c).cast("string").alias(c) for c in melted])
        return df.unpivot([quoted(c) for c in ids], [quoted(c) for c in melted], self._variable, self._value)


class SparkExplode(Transformer):
    """A row for each element of an array or entry of a map; with ``outer``, NULL and empty ones keep a row of NULL."""

    def __init__(self, *, input_col: str, output_cols: str | list[str] | None = None, outer: bool = True, drop_after: bool = False):
        names = as_list(output_cols)
        if isinstance(output_cols, (list, tuple)) and (len(names) != 2 or not all(isinstance(n, str) for n in names)):
            raise AssertionError("a list of output columns has two names, for key and value")
        self._input, self._names, self._outer, self._drop = input_col, names, outer, drop_after

    def _transform(self, df: DataFrame) -> DataFrame:
        kind = df.schema[self._input].dataType
        made: Any = (F.explode_outer if self._outer else F.explode)(col(self._input))
        if isinstance(kind, T.MapType):
            if len(self._names) != 2:
                raise AssertionError("a map needs two output columns")
            names = self._names
        elif isinstance(kind, T.ArrayType):
            if len(self._names) > 1:
                raise AssertionError("an array needs one output column")
            names = self._names or [self._input]
        else:
            raise AssertionError(f"'{self._input}' is neither an array nor a map")
        gone = {*names} | ({self._input} if self._drop else set())
        if isinstance(kind, T.ArrayType) and not self._drop and names == [self._input]:
            return df.select(*[made.alias(c) if c == self._input else col(c) for c in df.columns])
        return df.select(*[col(c) for c in df.columns if c not in gone], made.alias(*names))

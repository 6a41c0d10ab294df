"""Forks whose sides work row by row, as one projection over one scan.

A union of two filtered sides reads the table twice, as Spark does not see that both are parts of one. Where the steps of all sides
only project and filter, each row's side is computed beside the others, from inputs that are null where the row is not on that side, so that nothing
is computed, or fails, on rows the side does not have. Where a step does more, the fork stays a union.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.ordered import Counted, Deferred
from weftline.functions.selectors import col, quoted
from weftline.operators import (
    AddLiterals,
    AssertContainsColumns,
    Cast,
    ColumnsToMap,
    DropColumns,
    DropNulls,
    Filter,
    HorizontalFunction,
    MapToColumns,
    MathOperator,
    RenameColumns,
    SelectColumns,
    When,
    WithColumns,
)
from weftline.plans.nodes import Node, SequenceNode, TransformerNode

#: Operators that only project and filter.
ROW_WISE = (
    AddLiterals, AssertContainsColumns, Cast, ColumnsToMap, DropColumns, DropNulls, Filter, HorizontalFunction, MapToColumns, MathOperator, RenameColumns, SelectColumns, When, WithColumns,
)

_IN, _WAS, _PLACE = "weftline__in", "weftline__was", "weftline__side"


class NotRowWise(Exception):
    """A step asked for more than projections and filters."""


class Rows:
    """The rows of one side, as a frame of which only projections and filters can be taken.

    ``frame`` has all rows, with hidden columns behind: whether a row is still on this side, and what other sides have made. ``path`` are the
    methods called so far, so that they can be called again on another one.
    """

    def __init__(self, frame: DataFrame, columns: list[str], path: tuple = (), hidden: tuple = (_IN,)):
        self.frame, self.columns, self.path, self._hidden = frame, columns, path, hidden

    def _then(self, method: str, args: tuple, frame: DataFrame) -> Rows:
        return Rows(frame, [c for c in frame.columns if c not in self._hidden], (*self.path, (method, args)), self._hidden)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([self.frame.schema[c] for c in self.columns])

    @property
    def dtypes(self) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self.schema.fields]

    @property
    def isStreaming(self) -> bool:
        return self.frame.isStreaming

    @property
    def sparkSession(self) -> SparkSession:
        return self.frame.sparkSession

    def select(self, *columns: Any) -> Rows:
        given = list(columns[0]) if len(columns) == 1 and isinstance(columns[0], (list, tuple)) else list(columns)
        chosen = [x for c in given for x in ([col(v) for v in self.columns] if isinstance(c, str) and c == "*" else [col(c) if isinstance(c, str) else c])]
        return self._then("select", columns, self.frame.select(*chosen, *self._hidden))

    def withColumns(self, changed: dict[str, Column]) -> Rows:
        if any(isinstance(c, (Deferred, Counted)) for c in changed.values()):
            raise NotRowWise("a column that needs an order of rows")
        return self._then("withColumns", (changed,), self.frame.withColumns(changed))

    def withColumn(self, name: str, c: Column) -> Rows:
        return self.withColumns({name: c})

    def withColumnRenamed(self, old: str, new: str) -> Rows:
        return self._then("withColumnRenamed", (old, new), self.frame.withColumnRenamed(old, new))

    def drop(self, *names: str) -> Rows:
        return self.select(*[c for c in self.columns if c not in names])

    def filter(self, condition: Column | str) -> Rows:
        c = F.expr(condition) if isinstance(condition, str) else condition
        return self._then("filter", (condition,), self.frame.withColumn(_IN, F.col(_IN) & F.coalesce(c, F.lit(False))))

    where = filter

    def __getitem__(self, name: str) -> Column:
        if not isinstance(name, str) or name not in self.columns:
            raise NotRowWise(str(name))
        return col(name)

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_") or name not in self.__dict__.get("columns", ()):
            raise NotRowWise(name)
        return col(name)


def row_wise(nodes: list[Node] | None) -> bool:
    """Whether all steps can only project and filter, as far as can be told without running them."""
    if nodes is None:
        return True
    return all(row_wise(n.steps) if isinstance(n, SequenceNode) else isinstance(n, TransformerNode) and type(n.transformer) in ROW_WISE for n in nodes)


def _run(nodes: list[Node] | None, rows: Rows) -> Rows:
    for n in nodes or []:
        rows = _run(n.steps, rows) if isinstance(n, SequenceNode) else n.transformer.transform(rows)
        if not isinstance(rows, Rows):
            raise NotRowWise(n.id)
    return rows


def _only_projects(base: DataFrame, out: DataFrame) -> bool:
    """Whether the plan of ``out`` is that of ``base`` with projections on top; generators, windows and aggregates are not."""
    plans = [[line for line in df._jdf.queryExecution().analyzed().toString().split("\n") if line.strip()] for df in (base, out)]
    added = plans[1][: len(plans[1]) - len(plans[0])]
    return all(line.lstrip(" :+-").startswith("Project") for line in added)


class Side:
    """A side of a fork: which rows it has, what they go through before its nodes, and its nodes. A filter that a path begins with is its condition."""

    def __init__(self, name: str, nodes: list[Node] | None, condition: Column | None = None, path: tuple = ()):
        if condition is None and path and path[0][0] == "filter":
            (given,), path = path[0][1], path[1:]
            condition = F.expr(given) if isinstance(given, str) else given
        self.name, self.nodes, self.condition, self.path = name, nodes, condition, path


def split_paths(df: DataFrame, split_function: Any) -> dict[str, tuple] | None:
    """What a split function does for each side, found by calling it once on a frame that notes what is done; None where it does more than project and filter."""
    frame = df.withColumn(_IN, F.lit(True))
    try:
        got = split_function(Rows(frame, df.columns))
    except Exception:  # whatever a function does with what is not a frame; it is called again with the frame itself
        return None
    if not isinstance(got, dict) or not all(isinstance(r, Rows) for r in got.values()):
        return None
    return {name: rows.path for name, rows in got.items()}


def one_scan(df: DataFrame, sides: list[Side], exclusive: bool, allow_missing: bool = False) -> DataFrame | None:
    """The union of all sides, by name, over one scan of ``df``; None where a side does more than project and filter, or sides differ in columns or types.

    ``exclusive``: each row is on one side at most, which needs no copies of it.
    """
    flags, originals = [f"{_IN}{k}" for k in range(len(sides))], [f"{_WAS}{i}" for i in range(len(df.columns))]
    conditions = [s.condition for s in sides]
    if not exclusive and all(c is not None for c in conditions):  # rows of no side need not be read
        df = df.filter(reduce(lambda a, b: a | b, conditions))
    flagged = df.withColumns({f: F.lit(True) if c is None else F.coalesce(c, F.lit(False)) for c, f in zip(conditions, flags, strict=True)})
    # expressions as texts: they are many, and a text is one call to Spark
    base = flagged.selectExpr(*[f"{quoted(c)} AS {o}" for c, o in zip(df.columns, originals, strict=True)], *flags)
    made: list[tuple[str, T.StructType]] = []
    start, names = base, [*originals, *flags]
    try:
        for k, side in enumerate(sides):
            kept = (*names, *[place for place, _ in made])
            own = [f"CASE WHEN {flags[k]} THEN {o} END AS {quoted(c)}" for c, o in zip(df.columns, originals, strict=True)]
            rows = Rows(base.selectExpr(*own, f"{flags[k]} AS {_IN}", *kept), df.columns, hidden=(_IN, *kept))
            for method, args in side.path:
                rows = getattr(rows, method)(*args)
            rows = _run(side.nodes, rows)
            if len(set(rows.columns)) != len(rows.columns) or not rows.columns:
                return None
            made.append((f"{_PLACE}{k}", rows.schema))
            base = rows.frame.selectExpr(*kept, f"CASE WHEN {_IN} THEN struct({', '.join(map(quoted, rows.columns))}) END AS {_PLACE}{k}")
        if not _only_projects(start, base):
            return None
    except Exception:  # the fork is run as a union, which fails with the frames of the step that fails
        return None
    kinds: dict[str, T.DataType] = {}
    for _, schema in made:
        for f in schema.fields:
            if kinds.setdefault(f.name, f.dataType) != f.dataType:
                return None
    if not allow_missing and any(set(schema.names) != set(kinds) for _, schema in made):
        return None
    places = []
    for name, schema in made:
        fields = [f"{name}.{quoted(c)} AS {quoted(c)}" if c in schema.names else f"CAST(NULL AS {kind.simpleString()}) AS {quoted(c)}" for c, kind in kinds.items()]
        places.append(f"CASE WHEN {name} IS NOT NULL THEN struct({', '.join(fields)}) END")
    if exclusive:
        out = base.selectExpr(f"coalesce({', '.join(places)}) AS {_PLACE}").filter(f"{_PLACE} IS NOT NULL")
    else:
        out = base.selectExpr(f"explode(filter(array({', '.join(places)}), x -> x IS NOT NULL)) AS {_PLACE}")
    return out.selectExpr(*[f"{_PLACE}.{quoted(c)} AS {quoted(c)}" for c in kinds])

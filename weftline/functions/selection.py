"""Exact quantiles of groups of any size.

All values are sorted by group and value over all tasks and numbered, so that the value of a rank in a group is a row number: that of the
group's first row plus the rank. The groups' first rows and sizes are grouped aggregates, and the few rows wanted are joined
by number. No task holds a group, and one large group is spread like any rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.ordered import ROW, By, number
from weftline.functions.selectors import col

#: How a quantile between two values is found.
INTERPOLATIONS = ("linear", "lower", "higher", "nearest", "midpoint")


@dataclass(frozen=True)
class Quantile:
    """The value of rank (n - 1) * q of a column's n values that are not null; medians are quantiles of 0.5."""

    alias: str
    column: str
    q: float = 0.5
    interpolation: str = "linear"

    def __post_init__(self) -> None:
        if not 0 <= self.q <= 1:
            raise ValueError(f"a quantile is from 0 to 1: {self.q}")
        if self.interpolation not in INTERPOLATIONS:
            raise ValueError(f"interpolation '{self.interpolation}'; known are {INTERPOLATIONS}")

    def value(self, low: Column, high: Column, n: Column) -> Column:
        """From the values of the ranks below and above."""
        part = (n - 1) * F.lit(self.q) - F.floor((n - 1) * F.lit(self.q))
        return {
            "linear": lambda: F.when(part == 0, low).otherwise((1 - part) * low + part * high),
            "midpoint": lambda: F.when(part == 0, low).otherwise((low + high) / 2),
            "lower": lambda: low,
            "higher": lambda: high,
            "nearest": lambda: F.when(part > 0.5, high).otherwise(low),
        }[self.interpolation]()


def can_select(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def _of_column(df: DataFrame, keys: Sequence[str], column: str, wanted: Sequence[Quantile]) -> DataFrame:
    """The groups that have values, as weftline__k0 and so on, with the quantiles of one column."""
    names = [f"weftline__k{i}" for i in range(len(keys))]
    values = df.filter(col(column).isNotNull()).select(*[col(k).alias(n) for k, n in zip(keys, names, strict=True)], col(column).alias("v"))
    rows, _ = number(values, [By(F.col(c)).directed() for c in (*names, "v")])
    groups = rows.groupBy(*names).agg(F.min(ROW).alias("first"), F.count(F.lit(1)).alias("n"))
    ranks = []
    for i, w in enumerate(wanted):
        at = (F.col("n") - 1) * F.lit(w.q)
        ranks += [F.struct(F.lit(i).alias("i"), F.lit(high).alias("high"), (F.col("first") + f(at)).cast("bigint").alias("row")) for high, f in ((False, F.floor), (True, F.ceil))]
    targets = groups.select(*[F.col(n).alias(n) for n in names], "n", F.explode(F.array(*ranks)).alias("t")).select(*names, "n", "t.i", "t.high", F.col("t.row").alias("weftline__at"))
    found = targets.join(rows.select(F.col(ROW).alias("weftline__at"), F.col("v").cast("double")), "weftline__at")
    pick = lambda i, high: F.max(F.when((F.col("i") == i) & (F.col("high") == high), F.col("v")))
    return found.groupBy(*names).agg(*[w.value(pick(i, False), pick(i, True), F.max("n")).alias(w.alias) for i, w in enumerate(wanted)])


def with_quantiles(grouped: DataFrame, df: DataFrame, keys: Sequence[str], wanted: Sequence[Quantile]) -> DataFrame:
    """``grouped``, a row for each group of ``df`` by ``keys``, with the quantiles wanted as columns behind."""
    out = grouped
    for column in dict.fromkeys(w.column for w in wanted):
        found = _of_column(df, keys, column, [w for w in wanted if w.column == column])
        alike = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"weftline__k{i}")) for i, k in enumerate(keys)])
        out = out.join(found, alike, "left").drop(*[f"weftline__k{i}" for i in range(len(keys))])
    return out

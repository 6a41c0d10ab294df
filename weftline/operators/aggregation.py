"""Grouped aggregates."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.selection import Quantile, can_select, with_quantiles
from weftline.functions.selectors import col
from weftline.operators.base import Transformer

Aggregation = dict[str, Any]

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum,
    "mean": F.avg,
    "avg": F.avg,
    "median": F.median,
    "min": F.min,
    "max": F.max,
    "std": F.stddev_samp,
    "stddev": F.stddev_samp,
    "var": F.var_samp,
    "variance": F.var_samp,
    "count": F.count,
    "first": F.first,
    "last": F.last,
    "len": lambda c: F.count(F.lit(1)),
    "n_unique": lambda c: F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("int")), F.lit(0)).cast("bigint"),
    "collect_list": F.collect_list,
    "collect_set": F.collect_set,
    "any": F.bool_or,
    "all": F.bool_and,
    "approx_n_unique": F.approx_count_distinct,
    "mode": lambda c: F.mode(c, True),
    "skew": F.skewness,
    "kurtosis": F.kurtosis,
    "product": F.product,
}
#: Aggregates by selection over sorted rows, of numbers; a quantile has 'q' and maybe 'interpolation'.
SELECTED = ("median", "quantile")


class GroupBy(Transformer):
    """Aggregates by the selected columns.

    ``aggregations`` is {agg: [columns]} or {agg: column}, where ``prefix`` and ``suffix`` name the outputs, or {agg, col, alias} or a
    list of these; without an alias an output has its column's name. ``first`` and ``last`` depend on how rows lie unless an ``order_by``
    column is given. NULL is a value of its own in ``n_unique``, and not in ``mode``, which is the smallest of the most frequent values. ``median`` and
    ``quantile`` ({agg: quantile, col, q, interpolation, alias}) are exact, and selected from rows that are sorted over all tasks, so that no task holds a group; a
    stream, or what is not a number, is left to Spark's median.
    """

    def __init__(
        self,
        *,
        aggregations: dict[str, Any] | list[Aggregation],
        groupby_columns: str | Iterable[str] | None = None,
        groupby_regex: str | None = None,
        groupby_glob: str | None = None,
        groupby_startswith: str | Iterable[str] | None = None,
        groupby_endswith: str | Iterable[str] | None = None,
        prefix: str = "",
        suffix: str = "",
    ):
        chosen = {"columns": groupby_columns, "regex": groupby_regex, "glob": groupby_glob, "startswith": groupby_startswith, "endswith": groupby_endswith}
        if sum(v is not None for v in chosen.values()) != 1:
            raise AssertionError("group by exactly one of groupby_columns, groupby_regex, groupby_glob, groupby_startswith, groupby_endswith")
        self._set_columns_selections(**chosen)
        self._aggregations = self._read(aggregations, prefix, suffix)

    @staticmethod
    def _read(given: dict[str, Any] | list[Aggregation], prefix: str, suffix: str) -> list[Aggregation]:
        if isinstance(given, dict) and len(given) == 1 and next(iter(given)) in {**AGGREGATES, "quantile": None}:
            name, columns = next(iter(given.items()))
            return [{"agg": name, "col": c, "alias": f"{prefix}{c}{suffix}"} for c in ([columns] if isinstance(columns, str) else columns)]
        if prefix or suffix:
            raise ValueError("'prefix' and 'suffix' go with one aggregate of several columns")
        out = [given] if isinstance(given, dict) else list(given)
        if not out:
            raise ValueError("no aggregation")
        for a in out:
            if missing := {"agg", "col"} - set(a):
                raise KeyError(f"an aggregation lacks {sorted(missing)}: {a}")
            if extra := set(a) - {"agg", "col", "alias", "order_by", *(("q", "interpolation") if a["agg"] == "quantile" else ())}:
                raise KeyError(f"unknown keys {sorted(extra)}: {a}")
            if a["agg"] not in AGGREGATES and a["agg"] != "quantile":
                raise ValueError(f"unknown aggregate '{a['agg']}'; known are {sorted([*AGGREGATES, 'quantile'])}")
            if a["agg"] == "quantile":
                _quantile(a)
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        def made(a: Aggregation) -> Column:
            c = col(a["col"])
            if a["agg"] in ("first", "last") and a.get("order_by"):
                by = F.min_by if a["agg"] == "first" else F.max_by
                return by(c, col(a["order_by"]))
            return AGGREGATES[a["agg"]](c)

        keys = self._get_selected_columns(df)
        selected = {f"weftline__s{i}": a for i, a in enumerate(self._aggregations) if _is_selected(df, a)}
        plain = {f"weftline__s{i}": a for i, a in enumerate(self._aggregations) if f"weftline__s{i}" not in selected}
        names = [a.get("alias") or a["col"] for a in self._aggregations]
        if not selected:
            return df.groupBy(*map(col, keys)).agg(*[made(a).alias(n) for a, n in zip(self._aggregations, names, strict=True)])
        grouped = df.groupBy(*map(col, keys)).agg(*[made(a).alias(n) for n, a in plain.items()]) if plain else df.select(*map(col, keys)).distinct()
        out = with_quantiles(grouped, df, keys, [_quantile(a, n) for n, a in selected.items()])
        return out.select(*map(col, keys), *[F.col(f"weftline__s{i}").alias(n) for i, n in enumerate(names)])


def _quantile(a: Aggregation, alias: str = "") -> Quantile:
    return Quantile(alias, a["col"], a.get("q", 0.5), a.get("interpolation", "linear"))


def _is_selected(df: DataFrame, a: Aggregation) -> bool:
    numeric = a["agg"] in SELECTED and can_select(df.schema[a["col"]].dataType)
    if a["agg"] == "quantile" and (df.isStreaming or not numeric):
        raise TypeError(f"a quantile is of numbers of a frame that is not a stream: {a['col']}")
    return numeric and not df.isStreaming

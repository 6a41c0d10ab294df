"""Operators that keep or drop rows; their predicates reach the scan."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.conditions import check_condition, condition, null_to_false
from weftline.functions.selectors import col
from weftline.operators.base import Transformer

NEGATIVE = {"ne", "is_not_in", "is_not_null", "is_not_nan"}


class Filter(Transformer):
    """Keeps the rows where a condition is true, or removes them; where it is NULL, ``keep`` drops and ``remove`` keeps."""

    def __init__(self, *, input_col: str, operator: str, value: Any = None, compare_col: str | None = None, perform: str = "keep"):
        if perform not in ("keep", "remove"):
            raise ValueError("'perform' is 'keep' or 'remove'")
        if perform == "remove" and operator in NEGATIVE:
            raise ValueError(f"to remove by '{operator}' negates twice; keep by its opposite")
        check_condition(operator, value, compare_col)
        self._condition, self._keep = (input_col, operator, value, compare_col), perform == "keep"

    def _transform(self, df: DataFrame) -> DataFrame:
        cond = condition(*self._condition)
        return df.filter(cond if self._keep else ~null_to_false(cond))


class DropNulls(Transformer):
    """Drops rows by missing values in the selected columns, all of them where nothing is selected.

    ``thresh`` is the number of values a row must have and overrides ``how``. NaN counts as missing, as in Spark; ``drop_na`` is
    accepted and changes nothing.
    """

    def __init__(
        self,
        *,
        how: str = "any",
        thresh: int | None = None,
        drop_na: bool = False,
        columns: str | Iterable[str] | None = None,
        regex: str | None = None,
        glob: str | None = None,
        startswith: str | Iterable[str] | None = None,
        endswith: str | Iterable[str] | None = None,
    ):
        if how not in ("any", "all"):
            raise ValueError("'how' is 'any' or 'all'")
        self._how, self._thresh = how, thresh
        self._set_columns_selections(columns=columns, regex=regex, glob=glob, startswith=startswith, endswith=endswith)

    def _transform(self, df: DataFrame) -> DataFrame:
        chosen = self._get_selected_columns(df)
        names = chosen if chosen else df.columns
        least = self._thresh if self._thresh is not None else (len(names) if self._how == "any" else 1)
        floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
        there = [col(c).isNotNull() & ~F.isnan(col(c)) if c in floats else col(c).isNotNull() for c in names]
        if least >= len(names):
            # a plain conjunction reaches the scan
            return df.filter(reduce(lambda a, b: a & b, there)) if least == len(names) else df.limit(0)
        return df.filter(reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(False)).cast("int") for t in there]) >= least)

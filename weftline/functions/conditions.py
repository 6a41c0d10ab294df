"""The sixteen predicates that filters, conditional columns and row-wise pipelines share."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.selectors import col

COMPARISONS = {"eq": "__eq__", "ne": "__ne__", "lt": "__lt__", "le": "__le__", "gt": "__gt__", "ge": "__ge__"}
UNARY = {"is_null", "is_not_null", "is_nan", "is_not_nan"}
TEXT = {"contains", "starts_with", "ends_with"}
SETS = {"is_in", "is_not_in"}
OPERATORS = frozenset(COMPARISONS) | UNARY | TEXT | SETS | {"is_between"}


def check_condition(operator: str, value: Any = None, compare_col: str | None = None) -> None:
    """Raises ValueError or TypeError unless the operator and its operand fit."""
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator '{operator}'; known are {sorted(OPERATORS)}")
    has_value, has_column = value is not None, compare_col is not None
    if operator in UNARY:
        if has_value or has_column:
            raise ValueError(f"'{operator}' takes neither a value nor a column")
        return
    if operator in SETS or operator == "is_between":
        if has_column:
            raise ValueError(f"'{operator}' takes no column")
        if not has_value:
            raise ValueError(f"'{operator}' needs a value")
        if operator == "is_between":
            if not isinstance(value, (list, tuple)) or len(value) != 2:
                raise ValueError("'is_between' needs a list or tuple of two bounds")
        elif isinstance(value, str) or not isinstance(value, Iterable):
            raise TypeError(f"'{operator}' needs an iterable that is not a string")
        elif any(x is None for x in value):
            raise ValueError(f"'{operator}' cannot hold None; use 'is_null'")
        return
    if has_value == has_column:
        raise ValueError(f"'{operator}' needs either a value or a column")
    if operator in TEXT and has_value and not isinstance(value, str):
        raise TypeError(f"'{operator}' needs a string")


def condition(input_col: str, operator: str, value: Any = None, compare_col: str | None = None) -> Column:
    """The predicate as a column of three values.

    NULL makes comparisons, text tests, ``is_in`` and ``is_between`` NULL; ``is_nan`` false; ``is_not_nan`` and ``is_not_in``
    true. ``contains`` reads a value as a regular expression.
    """
    check_condition(operator, value, compare_col)
    c = col(input_col)
    other = col(compare_col) if compare_col is not None else None
    if operator in COMPARISONS:
        return getattr(c, COMPARISONS[operator])(other if other is not None else F.lit(value))
    if operator == "is_null":
        return c.isNull()
    if operator == "is_not_null":
        return c.isNotNull()
    if operator == "is_nan":
        return F.coalesce(F.isnan(c), F.lit(False))
    if operator == "is_not_nan":
        return ~F.coalesce(F.isnan(c), F.lit(False))
    if operator == "contains":
        return F.regexp_like(c, other if other is not None else F.lit(value))
    if operator == "starts_with":
        return c.startswith(other if other is not None else value)
    if operator == "ends_with":
        return c.endswith(other if other is not None else value)
    if operator == "is_between":
        return c.between(F.lit(value[0]), F.lit(value[1]))
    inside = c.isin(list(value))
    return inside if operator == "is_in" else ~null_to_false(inside)


def null_to_false(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))

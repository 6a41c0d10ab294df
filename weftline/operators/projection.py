"""Operators that choose, rename, cast and compute columns. Each adds one projection to the plan."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.conditions import check_condition, condition
from weftline.functions.methods import HORIZONTAL, column_method
from weftline.functions.ordered import with_deferred
from weftline.functions.selectors import any_selector, as_list, col
from weftline.functions.types import cast, literal, resolve, resolve_all
from weftline.operators.base import Transformer, projection

Names = str | Iterable[str] | None


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


class SelectColumns(Transformer):
    """Keeps the selected columns, in the order of the selection."""

    def __init__(self, *, columns: Names = None, regex: str | None = None, glob: str | None = None, startswith: Names = None, endswith: Names = None):
        chosen = {"columns": columns, "regex": regex, "glob": glob, "startswith": startswith, "endswith": endswith}
        if not any_selector(**chosen):
            raise AssertionError("select by at least one of columns, regex, glob, startswith, endswith")
        self._set_columns_selections(**chosen)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.select(*map(col, self._get_selected_columns(df)))


class DropColumns(Transformer):
    """Drops the selected columns; names that are not there are ignored unless ``allow_excess_columns`` is off."""

    def __init__(
        self, *, columns: Names = None, regex: str | None = None, glob: str | None = None, startswith: Names = None, endswith: Names = None, allow_excess_columns: bool = True
    ):
        self._set_columns_selections(columns=columns, regex=regex, glob=glob, startswith=startswith, endswith=endswith, allow_excess_columns=allow_excess_columns)

    def _transform(self, df: DataFrame) -> DataFrame:
        gone = set(self._get_selected_columns(df))
        return df.select(*[col(c) for c in df.columns if c not in gone])


class RenameColumns(Transformer):
    """Renames by two lists, by a mapping, or by a regex replaced in every name. Names may be swapped."""

    def __init__(
        self,
        *,
        columns: Names = None,
        columns_renamed: Names = None,
        mapping: dict[str, str] | None = None,
        regex_pattern: str | None = None,
        regex_replacement: str | None = None,
        fail_on_missing_columns: bool = True,
    ):
        ways = [columns is not None or columns_renamed is not None, mapping is not None, regex_pattern is not None or regex_replacement is not None]
        if sum(ways) != 1:
            raise AssertionError("rename by exactly one of columns, mapping, regex_pattern")
        if ways[0]:
            old, new = as_list(columns), as_list(columns_renamed)
            if columns is None or columns_renamed is None:
                raise AssertionError("'columns' and 'columns_renamed' go together")
            if len(old) != len(new):
                raise ValueError(f"{len(old)} columns, but {len(new)} new names")
            mapping = dict(zip(old, new, strict=True))
        if ways[2] and (regex_pattern is None or regex_replacement is None):
            raise AssertionError("'regex_pattern' and 'regex_replacement' go together")
        self._mapping, self._pattern, self._replacement, self._strict = mapping, regex_pattern, regex_replacement, fail_on_missing_columns

    def _transform(self, df: DataFrame) -> DataFrame:
        if self._pattern is not None:
            names = {c: re.sub(self._pattern, self._replacement, c) for c in df.columns}
        else:
            missing = [c for c in self._mapping if c not in df.columns]
            if missing and self._strict:
                raise AssertionError(f"columns not in the dataframe: {missing}")
            names = self._mapping
        out = [names.get(c, c) for c in df.columns]
        if len(set(out)) != len(out):
            raise ValueError(f"several columns would have one name: {sorted({n for n in out if out.count(n) > 1})}")
        return df.select(*[col(c).alias(n) for c, n in zip(df.columns, out, strict=True)])


class Cast(Transformer):
    """Casts columns; those that the frame lacks are ignored.

    Portable names give 64-bit types ("int" is bigint). As soon as one of the types is Spark's own ("array<int>",
    "decimal(10,2)"), all of them are read as Spark's, and "int" is 32 bits. Texts that cannot be read become NULL.
    """

    def __init__(self, *, cast: dict[str, str]):
        if not isinstance(cast, dict) or not cast:
            raise TypeError("'cast' is a dictionary of types by column")
        self._types = resolve_all(cast)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[cast(col(c), self._types[c], _source(df, c)).alias(c) if c in self._types else col(c) for c in df.columns])


def _source(df: DataFrame, name: str) -> str | None:
    """The type a cast starts from: None where it holds texts within."""
    kind = _kind(df, name)
    return None if "string" in kind and kind != "string" else kind


class AddLiterals(Transformer):
    """Adds or replaces columns by constants: ``data`` is a list of {alias, value, cast}, value and cast left out for NULL."""

    def __init__(self, *, data: list[dict[str, Any]]):
        self._data = []
        for d in data:
            if "alias" not in d or set(d) - {"alias", "value", "cast"}:
                raise KeyError(f"a literal has 'alias' and maybe 'value' and 'cast': {d}")
            if not isinstance(d["alias"], str):
                raise TypeError(f"an alias is a string: {d['alias']!r}")
            kind = d.get("cast")
            self._data.append((d["alias"], d.get("value"), resolve(kind) if kind is not None else None))

    def _transform(self, df: DataFrame) -> DataFrame:
        return projection(df, {alias: literal(value, kind) for alias, value, kind in self._data})


class WithColumns(Transformer):
    """Applies one method of the column registry to every selected column, in place or under new names."""

    def __init__(
        self,
        *,
        method: str,
        columns: Names = None,
        regex: str | None = None,
        glob: str | None = None,
        startswith: Names = None,
        endswith: Names = None,
        args: list | None = None,
        kwargs: dict[str, Any] | None = None,
        alias: str | None = None,
        prefix: str | None = None,
        suffix: str | None = None,
    ):
        if alias is not None and (prefix is not None or suffix is not None):
            raise AssertionError("give either 'alias' or 'prefix' and 'suffix'")
        self._method = column_method(method)
        self._args, self._kwargs = list(args or []), dict(kwargs or {})
        self._alias, self._prefix, self._suffix = alias, prefix or "", suffix or ""
        self._set_columns_selections(columns=columns, regex=regex, glob=glob, startswith=startswith, endswith=endswith)

    def _transform(self, df: DataFrame) -> DataFrame:
        chosen = self._get_selected_columns(df)
        if self._alias is not None and len(chosen) > 1:
            raise ValueError(f"one alias for {len(chosen)} columns")
        return with_deferred(df, {self._alias or f"{self._prefix}{c}{self._suffix}": self._method(col(c), *self._args, **self._kwargs) for c in chosen})


class HorizontalFunction(Transformer):
    """One row-wise function over the selected columns; nothing selected, nothing done."""

    def __init__(
        self,
        *,
        output_col: str,
        function: str,
        columns: Names = None,
        regex: str | None = None,
        glob: str | None = None,
        startswith: Names = None,
        endswith: Names = None,
        args: list | None = None,
        kwargs: dict[str, Any] | None = None,
    ):
        if function not in HORIZONTAL:
            raise ValueError(f"unknown function '{function}'; known are {sorted(HORIZONTAL)}")
        self._output, self._function = output_col, HORIZONTAL[function]
        self._args, self._kwargs = list(args or []), dict(kwargs or {})
        self._set_columns_selections(columns=columns, regex=regex, glob=glob, startswith=startswith, endswith=endswith)

    def _transform(self, df: DataFrame) -> DataFrame:
        chosen = self._get_selected_columns(df)
        return projection(df, {self._output: self._function([col(c) for c in chosen], *self._args, **self._kwargs)}) if chosen else df


ARITHMETIC = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": F.try_divide,
    "pow": F.pow,
}


class MathOperator(Transformer):
    """New columns by arithmetic, strictly from left to right.

    Each strategy is {new_column_name, strategy: [{column | constant, cast}], operations: [add, sub, mul, div, pow], cast}.
    Strategies see the input columns only, not each other. Division by zero is NULL.
    """

    def __init__(self, *, strategy: dict[str, Any] | list[dict[str, Any]]):
        self._strategies = [strategy] if isinstance(strategy, dict) else list(strategy)
        for s in self._strategies:
            if missing := {"new_column_name", "strategy", "operations"} - set(s):
                raise KeyError(f"a strategy lacks {sorted(missing)}: {s}")
            if extra := set(s) - {"new_column_name", "strategy", "operations", "cast"}:
                raise KeyError(f"unknown keys {sorted(extra)}: {s}")
            operands, operations = s["strategy"], s["operations"]
            for o in operands:
                if ("column" in o) == ("constant" in o):
                    raise ValueError(f"an operand has either 'column' or 'constant': {o}")
                if "cast" in o:
                    resolve(o["cast"])
            if unknown := set(operations) - set(ARITHMETIC):
                raise ValueError(f"unknown operations {sorted(unknown)}; known are {sorted(ARITHMETIC)}")
            if len(operations) != len(operands) - 1:
                raise ValueError(f"{len(operands)} operands need {len(operands) - 1} operations, not {len(operations)}")
            if s.get("cast") is not None:
                resolve(s["cast"])

    def _transform(self, df: DataFrame) -> DataFrame:
        def operand(o: dict[str, Any]) -> Column:
            c = col(o["column"]) if "column" in o else F.lit(o["constant"])
            kind = _kind(df, o["column"]) if "column" in o else None
            return cast(c, resolve(o["cast"]), kind) if o.get("cast") is not None else c

        made = {}
        for s in self._strategies:
            first, *rest = map(operand, s["strategy"])
            for name, o in zip(s["operations"], rest, strict=True):
                first = ARITHMETIC[name](first, o)
            made[s["new_column_name"]] = first.cast(resolve(s["cast"])) if s.get("cast") is not None else first
        return projection(df, made)


class When(Transformer):
    """A column by the first condition that is true; NULL conditions are not. ``otherwise_constant`` or ``otherwise_col`` is required.

    Each condition is {input_col, operator, value | compare_col, output_constant | output_col}; output columns win over
    constants. ``comparison_column`` and ``output_column`` are other names of ``compare_col`` and ``output_col``.
    """

    def __init__(
        self, *, output_col: str, conditions: list[dict[str, Any]], otherwise_constant: Any = None, otherwise_col: str | None = None, cast_output: str | None = None
    ):
        if otherwise_constant is None and otherwise_col is None:
            raise ValueError("give 'otherwise_constant' or 'otherwise_col'")
        if not conditions:
            raise ValueError("give at least one condition")
        self._arms = []
        for c in conditions:
            other = c.get("compare_col", c.get("comparison_column"))
            out = c.get("output_col", c.get("output_column"))
            if out is None and "output_constant" not in c:
                raise KeyError(f"a condition has 'output_col' or 'output_constant': {c}")
            check_condition(c["operator"], c.get("value"), other)
            self._arms.append((c["input_col"], c["operator"], c.get("value"), other, out, c.get("output_constant")))
        self._output, self._constant, self._column = output_col, otherwise_constant, otherwise_col
        self._type = resolve(cast_output) if cast_output is not None else None

    def _transform(self, df: DataFrame) -> DataFrame:
        def result(name: str | None, constant: Any) -> Column:
            c = col(name) if name is not None else F.lit(constant)
            return cast(c, self._type, _kind(df, name) if name is not None else None) if self._type else c

        chain: Any = F
        for input_col, operator, value, other, name, constant in self._arms:
            chain = chain.when(condition(input_col, operator, value, other), result(name, constant))
        return projection(df, {self._output: chain.otherwise(result(self._column, self._constant))})


class ColumnsToMap(Transformer):
    """One map of the selected columns by name. Without ``cast_values``, values of several types become texts."""

    def __init__(
        self,
        *,
        output_column: str,
        columns: Names = None,
        regex: str | None = None,
        glob: str | None = None,
        startswith: Names = None,
        endswith: Names = None,
        cast_values: str | None = None,
        drop_input_columns: bool = False,
    ):
        self._output, self._cast, self._drop = output_column, cast_values, drop_input_columns
        self._set_columns_selections(columns=columns, regex=regex, glob=glob, startswith=startswith, endswith=endswith)

    def _transform(self, df: DataFrame) -> DataFrame:
        chosen = self._get_selected_columns(df)
        kinds = {_kind(df, c) for c in chosen}
        to = next(iter(resolve_all({"v": self._cast}).values())) if self._cast else ("string" if len(kinds) > 1 else None)
        value = lambda c: cast(col(c), to, _kind(df, c)) if to else col(c)
        made = F.create_map(*[x for c in chosen for x in (F.lit(c), value(c))])
        gone = set(chosen) if self._drop else set()
        return df.select(*[col(c) for c in df.columns if c not in gone and c != self._output], made.alias(self._output))


class MapToColumns(Transformer):
    """A column for each key asked of a map: a list of keys, of (key, alias) pairs, or a mapping. Missing keys are NULL."""

    def __init__(self, *, input_column: str, output_columns: list | dict):
        if not output_columns:
            raise AssertionError("'output_columns' is empty")
        if isinstance(output_columns, dict):
            pairs = list(output_columns.items())
        elif isinstance(output_columns, (list, tuple)):
            if all(isinstance(x, str) for x in output_columns):
                pairs = [(x, x) for x in output_columns]
            elif all(isinstance(x, (list, tuple)) and len(x) == 2 for x in output_columns):
                pairs = [tuple(x) for x in output_columns]
            else:
                raise TypeError("'output_columns' is a list of keys or of (key, alias) pairs, or a dictionary")
        else:
            raise TypeError("'output_columns' is a list or a dictionary")
        names = [a for _, a in pairs]
        if not all(isinstance(a, str) for a in names) or len(set(names)) != len(names):
            raise TypeError(f"aliases are different strings: {names}")
        self._input, self._pairs = input_column, pairs

    def _transform(self, df: DataFrame) -> DataFrame:
        if not isinstance(df.schema[self._input].dataType, T.MapType):
            raise TypeError(f"'{self._input}' is not a map")
        return projection(df, {a: col(self._input).getItem(k) for k, a in self._pairs})


class SparkColumnMethod(Transformer):
    """A method of Spark's Column."""

    def __init__(self, *, input_column: str, method: str, output_column: str | None = None, args: list | None = None, kwargs: dict[str, Any] | None = None):
        if method.startswith("_") or not callable(getattr(Column, method, None)):
            raise ValueError(f"Column has no method '{method}'")
        self._input, self._output, self._method = input_column, output_column or input_column, method
        self._args, self._kwargs = list(args or []), dict(kwargs or {})

    def _transform(self, df: DataFrame) -> DataFrame:
        return projection(df, {self._output: getattr(col(self._input), self._method)(*self._args, **self._kwargs)})


class SparkSqlFunction(Transformer):
    """A function of pyspark.sql.functions; its result goes to ``column``."""

    def __init__(self, *, column: str, function: str, args: list | None = None, kwargs: dict[str, Any] | None = None):
        if function.startswith("_") or not callable(getattr(F, function, None)):
            raise ValueError(f"pyspark.sql.functions has no '{function}'")
        self._column, self._function = column, function
        self._args, self._kwargs = list(args or []), dict(kwargs or {})

    def _transform(self, df: DataFrame) -> DataFrame:
        return projection(df, {self._column: getattr(F, self._function)(*self._args, **self._kwargs)})

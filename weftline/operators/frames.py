"""Operators on whole frames: methods, duplicates, caching and partitions."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame

from weftline.functions.frames import drop_duplicates_keeping_rows, drop_duplicates_no_randomness, get_default_spark_partitions
from weftline.functions.methods import frame_method
from weftline.functions.selectors import as_list, col
from weftline.operators.base import Transformer

Names = str | Iterable[str] | None


class DataFrameMethod(Transformer):
    """A method of the frame registry: sort, unique, head, sample and so on."""

    def __init__(self, *, method: str, args: list | None = None, kwargs: dict[str, Any] | None = None):
        self._method, self._args, self._kwargs = frame_method(method), list(args or []), dict(kwargs or {})

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._method(df, *self._args, **self._kwargs)


class SparkDropDuplicates(Transformer):
    """Distinct rows; by a part of the columns, one row per value of them, the same however the data lie.

    That row has the greatest value of each other column, so that it may be no row of the input; with ``keep_rows`` it is the greatest row as it stands.
    """

    def __init__(self, *, columns: Names = None, regex: str | None = None, glob: str | None = None, startswith: Names = None, endswith: Names = None, keep_rows: bool = False):
        self._keep_rows = keep_rows
        self._set_columns_selections(columns=columns, regex=regex, glob=glob, startswith=startswith, endswith=endswith)

    def _transform(self, df: DataFrame) -> DataFrame:
        subset = self._get_selected_columns(df)
        if not subset or set(subset) == set(df.columns):
            return df.dropDuplicates()
        return drop_duplicates_keeping_rows(df, subset) if self._keep_rows else drop_duplicates_no_randomness(df, subset)


class Persist(Transformer):
    """Caches the frame unless it is cached."""

    def __init__(self) -> None:
        pass

    def _transform(self, df: DataFrame) -> DataFrame:
        return df if df.is_cached else df.cache()


Cache = Persist


class _Partitions(Transformer):
    def _prepare(self, num_partitions: int | None, rows_per_partition: int | None) -> None:
        if num_partitions is not None and rows_per_partition is not None:
            raise AssertionError("give at most one of 'num_partitions' and 'rows_per_partition'")
        for n in (num_partitions, rows_per_partition):
            if n is not None and n < 1:
                raise ValueError("numbers are 1 or more")
        self._n, self._rows = num_partitions, rows_per_partition

    def _number(self, df: DataFrame) -> int:
        """The number given, that of the rows (which counts them), or Spark's."""
        if self._rows:
            return max(df.count() // self._rows, 1)
        return self._n or get_default_spark_partitions(df)


class Repartition(_Partitions):
    """Shuffles to a number of partitions, by columns where given."""

    def __init__(self, *, num_partitions: int | None = None, rows_per_partition: int | None = None, columns: Names = None):
        self._prepare(num_partitions, rows_per_partition)
        self._columns = as_list(columns)
        if len(set(self._columns)) != len(self._columns):
            raise AssertionError(f"repeated columns: {self._columns}")

    def _transform(self, df: DataFrame) -> DataFrame:
        if missing := [c for c in self._columns if c not in df.columns]:
            raise AssertionError(f"columns not in the dataframe: {missing}")
        return df.repartition(self._number(df), *map(col, self._columns))


class CoalescePartitions(_Partitions):
    """Merges partitions without a shuffle."""

    def __init__(self, *, num_partitions: int | None = None, rows_per_partition: int | None = None):
        self._prepare(num_partitions, rows_per_partition)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.coalesce(self._number(df))

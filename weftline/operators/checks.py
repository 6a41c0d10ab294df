"""Operators that check or describe a frame and pass it on."""

from __future__ import annotations

import logging
import platform
import socket
from collections.abc import Iterable

from pyspark.sql import DataFrame

from weftline.functions.frames import get_data_skew
from weftline.functions.selectors import as_list
from weftline.functions.workers import on_workers
from weftline.operators.base import Transformer

log = logging.getLogger("weftline.checks")


class AssertContainsColumns(Transformer):
    """AssertionError unless all columns are there."""

    def __init__(self, *, columns: str | Iterable[str]):
        self._columns = as_list(columns)

    def _transform(self, df: DataFrame) -> DataFrame:
        if missing := [c for c in self._columns if c not in df.columns]:
            raise AssertionError(f"columns not in the dataframe: {missing}; it has {df.columns}")
        return df


class AssertCount(Transformer):
    """AssertionError unless the number of rows is as said. Counts the rows."""

    def __init__(self, *, expected: int | None = None, min_count: int | None = None, max_count: int | None = None):
        if expected is not None and (min_count is not None or max_count is not None):
            raise ValueError("give either 'expected' or 'min_count' and 'max_count'")
        if expected is None and min_count is None and max_count is None:
            raise ValueError("give 'expected', 'min_count' or 'max_count'")
        if any(n is not None and n < 0 for n in (expected, min_count, max_count)):
            raise ValueError("numbers are 0 or more")
        if min_count is not None and max_count is not None and min_count > max_count:
            raise ValueError("'min_count' exceeds 'max_count'")
        self._expected, self._min, self._max = expected, min_count, max_count

    def _transform(self, df: DataFrame) -> DataFrame:
        n, wrong = df.count(), []
        if self._expected is not None and n != self._expected:
            wrong.append(f"{self._expected} rows expected")
        if self._min is not None and n < self._min:
            wrong.append(f"at least {self._min} rows expected")
        if self._max is not None and n > self._max:
            wrong.append(f"at most {self._max} rows expected")
        if wrong:
            raise AssertionError(f"{' and '.join(wrong)}, found {n}")
        return df


class AssertNotEmpty(Transformer):
    """AssertionError unless there is a row. Looks for one row."""

    def __init__(self, *, df_name: str = "DataFrame"):
        self._name = df_name

    def _transform(self, df: DataFrame) -> DataFrame:
        if df.isEmpty():
            raise AssertionError(f"{self._name} is empty")
        return df


class PrintSchema(Transformer):
    """Logs names and types."""

    def __init__(self) -> None:
        pass

    def _transform(self, df: DataFrame) -> DataFrame:
        for f in df.schema.fields:
            log.info("%s: %s", f.name, f.dataType.simpleString())
        return df


class LogDataSkew(Transformer):
    """Logs how rows are spread over partitions; with ``persist``, caches the frame first."""

    def __init__(self, *, persist: bool = False):
        self._persist = persist

    def _transform(self, df: DataFrame) -> DataFrame:
        if self._persist and not df.is_cached:
            df = df.persist()
        log.info("%s", get_data_skew(df))
        return df


class CpuInfo(Transformer):
    """Logs hosts and processors of the workers."""

    def __init__(self, *, n_partitions: int = 100):
        self._n = n_partitions

    def _transform(self, df: DataFrame) -> DataFrame:
        for line in sorted(on_workers(df.sparkSession, _processor, self._n)):
            log.info("%s", line)
        return df


def _processor() -> str:
    name = platform.processor() or platform.machine()
    try:
        with open("/proc/cpuinfo") as f:
            name = next((x.split(":", 1)[1].strip() for x in f if x.startswith("model name")), name)
    except OSError:
        pass
    return f"{socket.gethostname()}: {name}"

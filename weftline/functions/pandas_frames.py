"""Comparison of small pandas frames whose cells may be lists, dictionaries, sets or arrays: for tests and reports on the driver."""

from __future__ import annotations

import json
from typing import Any

import numpy as np
import pandas as pd


def _plain(value: Any) -> Any:
    """A value that JSON can hold, with sets and dictionaries in order."""
    if isinstance(value, dict):
        return {"dict": sorted([str(k), _plain(v)] for k, v in value.items())}
    if isinstance(value, (set, frozenset)):
        return {"set": sorted(json.dumps(_plain(v), sort_keys=True) for v in value)}
    if isinstance(value, np.ndarray):
        return [_plain(v) for v in value.tolist()]
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if value is None or (np.isscalar(value) and pd.isna(value)):
        return None
    return value.item() if isinstance(value, np.generic) else value if isinstance(value, (str, int, float, bool)) else str(value)


def hash_complex_type_pandas_dataframe(df: pd.DataFrame) -> pd.Series:
    """A hash of each row, of columns sorted by name; equal cells of any nesting hash alike."""
    flat = pd.DataFrame({c: df[c].map(lambda v: json.dumps(_plain(v), sort_keys=True)) for c in sorted(df.columns)}, index=df.index)
    return pd.util.hash_pandas_object(flat, index=False)


def return_different_rows_in_pandas_dataframes(df1: pd.DataFrame, df2: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The rows that each frame has more often than the other."""
    out = []
    one, two = hash_complex_type_pandas_dataframe(df1), hash_complex_type_pandas_dataframe(df2)
    for df, mine, other in ((df1, one, two), (df2, two, one)):
        left = other.value_counts().to_dict()
        nth = mine.groupby(mine).cumcount()
        out.append(df[[n >= left.get(h, 0) for h, n in zip(mine, nth, strict=True)]])
    return out[0], out[1]


def assert_pandas_df_equal(df1: pd.DataFrame, df2: pd.DataFrame, assert_not_deep: bool = False) -> None:
    """AssertionError unless columns, number of rows and rows, in any order, agree; with ``assert_not_deep`` values are not compared."""
    if sorted(df1.columns) != sorted(df2.columns):
        raise AssertionError(f"columns differ: {sorted(set(df1.columns) ^ set(df2.columns))}")
    if len(df1) != len(df2):
        raise AssertionError(f"rows differ in number: {len(df1)} and {len(df2)}")
    if assert_not_deep:
        return
    a, b = return_different_rows_in_pandas_dataframes(df1, df2)
    if len(a) or len(b):
        raise AssertionError(f"rows differ, such as {a.head(3).to_dict('records')} and {b.head(3).to_dict('records')}")

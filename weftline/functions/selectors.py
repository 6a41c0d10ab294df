"""Column selection by name, pattern, prefix or suffix."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from fnmatch import fnmatchcase

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """The name in backticks, so that dots and spaces in it are part of it."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def as_list(value: str | Iterable[str] | None) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def select_columns(
    frame_columns: Sequence[str],
    *,
    columns: str | Iterable[str] | None = None,
    regex: str | None = None,
    glob: str | None = None,
    startswith: str | Iterable[str] | None = None,
    endswith: str | Iterable[str] | None = None,
    allow_excess_columns: bool = False,
) -> list[str]:
    """The columns asked for: those named, in their order, then regex and glob matches in frame order, each once.

    A regex matches anywhere in a name. ``startswith`` and ``endswith`` exclude every other selector. Nothing asked for
    gives an empty list. Repeated or unknown names raise an AssertionError; unknown ones pass with ``allow_excess_columns``.
    """
    if startswith is not None or endswith is not None:
        others = [columns, regex, glob, endswith if startswith is not None else None]
        if any(x is not None for x in others):
            raise AssertionError("'startswith' and 'endswith' cannot be combined with another selector")
        parts = tuple(as_list(startswith if startswith is not None else endswith))
        test = str.startswith if startswith is not None else str.endswith
        return [c for c in frame_columns if test(c, parts)]
    named = as_list(columns)
    if len(set(named)) != len(named):
        raise AssertionError(f"repeated columns: {sorted({c for c in named if named.count(c) > 1})}")
    missing = [c for c in named if c not in frame_columns]
    if missing and not allow_excess_columns:
        raise AssertionError(f"columns not in the dataframe: {missing}; it has {list(frame_columns)}")
    found = list(named)
    if regex is not None:
        found += [c for c in frame_columns if re.search(regex, c)]
    if glob is not None:
        found += [c for c in frame_columns if fnmatchcase(c, glob)]
    return list(dict.fromkeys(found))


def any_selector(**selectors: object) -> bool:
    return any(v is not None for v in selectors.values())

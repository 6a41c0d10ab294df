"""Joins and unions."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.selectors import as_list, col, quoted
from weftline.operators.base import Transformer
from weftline.operators.hot_keys import can_spread, spread_join
from weftline.sources.storage import Storage, storage

log = logging.getLogger("weftline.joins")

#: Most bytes, as Spark expects them, that are broadcast when asked for; a size from UNKNOWN_BYTES on says that Spark cannot tell.
MAX_BROADCAST_BYTES, UNKNOWN_BYTES = 1 << 30, 1 << 60

#: Spellings of the joins that keep the right side.
RIGHT = {"right": "left", "right_semi": "semi", "rightsemi": "semi", "right_anti": "anti", "rightanti": "anti"}
SAME = {"inner": "inner", "left": "left", "full": "full", "semi": "semi", "anti": "anti", "cross": "cross", "left_semi": "semi", "left_anti": "anti", "leftsemi": "semi", "leftanti": "anti"}


def check_join(how: str, on: object = None, left_on: object = None, right_on: object = None) -> None:
    """Raises ValueError unless the kind of join and its keys fit."""
    if how not in SAME and how not in RIGHT:
        raise ValueError(f"unknown join '{how}'; known are {sorted([*SAME, *RIGHT])}")
    if how == "cross":
        if on or left_on or right_on:
            raise ValueError("a cross join has no keys")
        return
    if on and (left_on or right_on):
        raise ValueError("give either 'on' or 'left_on' and 'right_on'")
    if not on and not (left_on and right_on):
        raise ValueError("give 'on', or both 'left_on' and 'right_on'")
    if not on and len(as_list(left_on)) != len(as_list(right_on)):
        raise ValueError("'left_on' and 'right_on' differ in length")


def join_dataframes(
    left: DataFrame,
    right: DataFrame,
    *,
    how: str,
    on: str | Sequence[str] | None = None,
    left_on: str | Sequence[str] | None = None,
    right_on: str | Sequence[str] | None = None,
    suffix: str = "_right",
    broadcast: bool = False,
    coalesce_keys: bool = True,
    spread_hot_keys: bool = False,
) -> DataFrame:
    """An equi-join whose output has no ambiguous names.

    Columns of the second side that clash get ``suffix``. Keys given by ``on`` appear once; of ``left_on`` and ``right_on`` the second
    side's go, but in a full join both stay, as do those of ``on`` without ``coalesce_keys``. Right joins swap the sides and
    keep the right one's columns first. ``broadcast`` hints the right frame, or where a right join preserves it, the other: only the side that is not preserved
    can be broadcast; a full join takes no hint. A frame that Spark expects to be larger than MAX_BROADCAST_BYTES is not hinted, with a warning.
    ``spread_hot_keys`` looks for keys that have more rows than there are for a task, by a job over the keys, and deals their rows over tasks; for inner, left, right and
    full joins by whole numbers, texts, dates or booleans of one type on both sides.
    """
    check_join(how, on, left_on, right_on)
    lkeys, rkeys = (as_list(on), as_list(on)) if on else (as_list(left_on), as_list(right_on))
    if how in RIGHT:
        left, right, lkeys, rkeys, kind = right, left, rkeys, lkeys, RIGHT[how]
    else:
        kind = SAME[how]
    hint = broadcast and kind != "full" and _may_broadcast(right)
    if kind in ("semi", "anti"):
        keyed = right.select(*[col(k).alias(f"weftline__k{i}") for i, k in enumerate(rkeys)])
        cond = reduce(lambda a, b: a & b, [left[quoted(k)] == keyed[f"weftline__k{i}"] for i, k in enumerate(lkeys)])
        return left.join(F.broadcast(keyed) if hint else keyed, cond, f"left_{kind}")
    both_keys = kind == "full" and (not on or not coalesce_keys)
    names = {}
    for c in right.columns:
        if c in rkeys and kind != "cross" and not both_keys:
            continue
        new = c
        while new in left.columns or new in names.values():
            new += suffix or "_right"
        names[c] = new
    second = right.select(*[col(k).alias(f"weftline__k{i}") for i, k in enumerate(rkeys)], *[col(c).alias(n) for c, n in names.items()])
    second = F.broadcast(second) if hint else second
    if kind == "cross":
        return left.crossJoin(second)
    first = left.select(*[col(k).alias(f"weftline__j{i}") for i, k in enumerate(lkeys)], *map(col, left.columns))
    cond = reduce(lambda a, b: a & b, [F.col(f"weftline__j{i}") == F.col(f"weftline__k{i}") for i in range(len(lkeys))])
    mine, other = [f"weftline__j{i}" for i in range(len(lkeys))], [f"weftline__k{i}" for i in range(len(rkeys))]
    if spread_hot_keys and not hint and can_spread(first, second, mine, other, kind):
        joined = spread_join(first, second, mine, other, kind)
    else:
        joined = first.join(second, cond, kind)
    coalesced = {k: F.coalesce(col(k), F.col(f"weftline__k{i}")).alias(k) for i, k in enumerate(lkeys)} if kind == "full" and not both_keys else {}
    return joined.select(*[coalesced.get(c, col(c)) for c in left.columns], *[col(n) for n in names.values()])


def _may_broadcast(df: DataFrame) -> bool:
    """Whether the frame is not known to be larger than what a broadcast may be."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if MAX_BROADCAST_BYTES < size < UNKNOWN_BYTES:
        log.warning("not broadcast: a frame of about %d bytes", size)
        return False
    return True


class Join(Transformer):
    """Joins the frame with a stored one; see ``join_dataframes`` for the options."""

    def __init__(
        self,
        *,
        store_key: str,
        how: str,
        on: str | list[str] | None = None,
        left_on: str | list[str] | None = None,
        right_on: str | list[str] | None = None,
        suffix: str = "_right",
        broadcast: bool = False,
        coalesce_keys: bool = True,
        spread_hot_keys: bool = False,
        store: Storage = storage,
    ):
        check_join(how, on, left_on, right_on)
        self._key, self._store = store_key, store
        self._options = {"how": how, "on": on, "left_on": left_on, "right_on": right_on, "suffix": suffix, "broadcast": broadcast, "coalesce_keys": coalesce_keys, "spread_hot_keys": spread_hot_keys}

    def _transform(self, df: DataFrame) -> DataFrame:
        return join_dataframes(df, self._store.get(self._key), **self._options)


def append_dataframes(frames: list[DataFrame], allow_missing_cols: bool = False) -> DataFrame:
    """UNION ALL by name, in the order given. Columns must be the same sets, or missing ones are NULL."""
    if not allow_missing_cols:
        want = set(frames[0].columns)
        for i, f in enumerate(frames[1:], 1):
            if want != set(f.columns):
                raise ValueError(f"columns of frame {i} differ: missing {sorted(want - set(f.columns))}, in excess {sorted(set(f.columns) - want)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing_cols), frames)


class AppendDataFrame(Transformer):
    """Appends a stored frame. ``relax``, ``rechunk`` and ``ignore_index`` have no meaning here and are accepted."""

    def __init__(self, *, store_key: str, allow_missing_cols: bool = False, relax: bool = False, rechunk: bool = False, ignore_index: bool = False, store: Storage = storage):
        self._key, self._missing, self._store = store_key, allow_missing_cols, store

    def _transform(self, df: DataFrame) -> DataFrame:
        return append_dataframes([df, self._store.get(self._key)], self._missing)

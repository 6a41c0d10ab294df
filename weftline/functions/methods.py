"""Named column and frame methods that pipelines may call: a closed list, so that a typo fails when a pipeline is built."""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import dates, ordered
from weftline.functions.frames import sample_rows
from weftline.functions.ordered import By, Counted, Deferred, Frame, Near, Running
from weftline.functions.selectors import as_list, col
from weftline.functions.types import cast, resolve


def _clip(c: Column, lower_bound: Any = None, upper_bound: Any = None) -> Column:
    out = c
    if lower_bound is not None:
        out = F.when(out < lower_bound, F.lit(lower_bound)).otherwise(out)
    if upper_bound is not None:
        out = F.when(out > upper_bound, F.lit(upper_bound)).otherwise(out)
    return out


def _replace_strict(c: Column, old: Any, new: Any = None, default: Any = None) -> Column:
    pairs = list(old.items()) if isinstance(old, dict) else list(zip(old, new, strict=True))
    if not pairs:
        return F.lit(default)
    return reduce(lambda w, p: w.when(c == p[0], F.lit(p[1])), pairs[1:], F.when(c == pairs[0][0], F.lit(pairs[0][1]))).otherwise(F.lit(default))


def _slice(c: Column, offset: int, length: int | None = None) -> Column:
    """Characters from ``offset``, counted from the end where negative."""
    start = F.lit(offset + 1) if offset >= 0 else F.greatest(F.char_length(c) + F.lit(offset + 1), F.lit(1))
    return F.substr(c, start, F.lit(length)) if length is not None else F.substr(c, start)


def _head(c: Column, n: int = 5) -> Column:
    return F.left(c, F.lit(n)) if n >= 0 else F.left(c, F.greatest(F.char_length(c) + F.lit(n), F.lit(0)))


def _tail(c: Column, n: int = 5) -> Column:
    return F.right(c, F.lit(n)) if n >= 0 else F.right(c, F.greatest(F.char_length(c) + F.lit(n), F.lit(0)))


def _strip(side: str) -> Callable[..., Column]:
    def strip(c: Column, characters: str | None = None) -> Column:
        if characters is None:
            pattern = {"both": r"^\s+|\s+$", "start": r"^\s+", "end": r"\s+$"}[side]
            return F.regexp_replace(c, pattern, "")
        return {"both": F.btrim, "start": F.ltrim, "end": F.rtrim}[side](c, F.lit(characters))

    return strip


def _escape(text: str) -> str:
    return "".join(f"\\{x}" if x in r"\.^$*+?{}[]|()-" else x for x in text)


def _replace(every: bool) -> Callable[..., Column]:
    def replace(c: Column, pattern: str, value: str, literal: bool = False) -> Column:
        if every:
            return F.replace(c, F.lit(pattern), F.lit(value)) if literal else F.regexp_replace(c, pattern, value)
        # what stands before the first match is group 1, so that the pattern's own groups are one further
        own = _escape(pattern) if literal else re.sub(r"(?<!\\)((?:\\\\)*)\\([1-9]\d*)", lambda m: f"{m[1]}\\{int(m[2]) + 1}", pattern)
        if literal:
            with_ = value.replace("\\", "\\\\").replace("$", "\\$")
        else:
            with_ = re.sub(r"(?<!\\)\$(?:\{(\d+)\}|(\d+))", lambda m: f"${int(m[1] or m[2]) + 1}" if int(m[1] or m[2]) else "__ALL__", value)
            if "__ALL__" in with_:
                raise ValueError("'$0' is not supported: put the pattern in a group")
        return F.regexp_replace(c, f"(?s)^(.*?)(?:{own})", "$1" + with_)

    return replace


def _contains(c: Column, pattern: str, literal: bool = False) -> Column:
    return F.contains(c, F.lit(pattern)) if literal else F.regexp_like(c, F.lit(pattern))


def _zfill(c: Column, width: int) -> Column:
    """Zeros after a sign, up to ``width``; longer texts stay."""
    sign = F.when(F.left(c, F.lit(1)).isin("-", "+"), F.left(c, F.lit(1))).otherwise("")
    rest = F.substr(c, F.char_length(sign) + 1)
    pad = F.greatest(F.lit(width) - F.char_length(c), F.lit(0))
    return F.concat(sign, F.repeat(F.lit("0"), pad), rest)


def _over(function: Callable[..., Column], spread: Callable[..., Callable[[Frame], Column]]) -> Callable[..., Column | Deferred]:
    """A function that needs an order: it must be named by ``order_by``, with ``partition_by`` if wanted.

    With a partition it is ``function`` over Spark's window; without one ``spread`` makes it over the order of all rows, which no task holds.
    """

    def run(c: Column, *args: Any, order_by: Any = None, partition_by: Any = None, descending: bool = False, **kwargs: Any) -> Column | Deferred:
        if order_by is None:
            raise ValueError("rows have no order in Spark: give 'order_by'")
        order = tuple(By(col(x), descending) for x in as_list(order_by))
        if not as_list(partition_by):
            return Deferred(order, spread(c, *args, **kwargs))
        return function(c, Window.partitionBy(*[col(x) for x in as_list(partition_by)]).orderBy(*[o.directed() for o in order]), *args, **kwargs)

    return run


def _shift(c: Column, n: int = 1) -> Callable[[Frame], Column]:
    return lambda frame: frame.want(Near(lambda w: F.lag(c, n).over(w), max(0, n), max(0, -n)))


def _cumulative(name: str) -> Callable[..., Column | Deferred]:
    return _over(
        lambda c, w: getattr(F, name)(c).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        lambda c: lambda frame: frame.aggregate(name, c, None, 0),
    )


def _rolling(name: str) -> Callable[..., Column | Deferred]:
    """Over the last ``window_size`` rows; null where fewer than ``min_samples`` of them, by default all, have a value."""

    def over(c: Column, w: Any, window_size: int, min_samples: int | None = None) -> Column:
        w = w.rowsBetween(1 - window_size, 0)
        value = F.percentile(c, F.lit(0.5)) if name == "median_of_rows" else getattr(F, name)(c)
        return F.when(F.count(c).over(w) >= (window_size if min_samples is None else min_samples), value.over(w))

    def spread(c: Column, window_size: int, min_samples: int | None = None) -> Callable[[Frame], Column]:
        return lambda frame: frame.want(Near(lambda w: over(c, w, window_size, min_samples), window_size - 1, 0))

    return _over(over, spread)


RANKS = ("average", "min", "max", "dense", "ordinal")


def _rank(c: Column, method: str = "average", order_by: Any = None, partition_by: Any = None, descending: bool = False) -> Column | Deferred:
    """The rank of each value, from 1, among those of its partition, or that of the rows by ``order_by``; nulls have none."""
    if method not in RANKS:
        raise ValueError(f"rank method '{method}'; known are {RANKS}")
    keys, order = [col(x) for x in as_list(partition_by)], [By(x, descending) for x in ([col(x) for x in as_list(order_by)] or [c])]
    known = c.isNotNull()
    if not keys:
        return Deferred((By(known, True), *order), ordered.rank(c, method))
    w = Window.partitionBy(*keys, known).orderBy(*[o.directed() for o in order])
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, known, *[o.c for o in order]))
    lowest = F.rank().over(w)
    ranks = {"average": lambda: lowest + (ties - 1) / 2, "min": lambda: lowest, "max": lambda: lowest + ties - 1, "dense": lambda: F.dense_rank().over(w), "ordinal": lambda: F.row_number().over(w)}
    return F.when(known, ranks[method]())


def _fill_null(c: Column, value: Any = None, strategy: str | None = None, order_by: Any = None, partition_by: Any = None) -> Column | Deferred:
    """``value``, or the value before (``forward``) or after (``backward``) in the order given, or ``zero`` or ``one``."""
    if (value is None) == (strategy is None):
        raise ValueError("give either 'value' or 'strategy'")
    if strategy is None:
        return F.coalesce(c, F.lit(value))
    if strategy in ("zero", "one"):
        return F.coalesce(c, F.lit(0 if strategy == "zero" else 1))
    if strategy not in ("forward", "backward"):
        raise ValueError(f"strategy '{strategy}'; known are forward, backward, zero and one")
    near = F.last if strategy == "forward" else F.first
    frame = (Window.unboundedPreceding, 0) if strategy == "forward" else (0, Window.unboundedFollowing)
    return _over(lambda c, w: near(c, ignorenulls=True).over(w.rowsBetween(*frame)), lambda c: ordered.fill(c, strategy == "forward"))(c, order_by=order_by, partition_by=partition_by)


def _occurrence(last: bool) -> Callable[..., Column | Deferred]:
    """Whether a row is the first, or last, in the order given of those with its value; null is a value."""

    def run(c: Column, order_by: Any = None, partition_by: Any = None) -> Column:
        if order_by is None:
            raise ValueError("rows have no order in Spark: give 'order_by'")
        keys, order = [col(x) for x in as_list(partition_by)], tuple(By(col(x), last) for x in as_list(order_by))
        alike = F.struct(*[k.alias(f"k{i}") for i, k in enumerate([*keys, c])])  # rows with the value lie together, over as many tasks as they need
        return Deferred((By(alike), *order), lambda frame: frame.want(Near(lambda w: ~F.coalesce(F.lag(alike).over(w).eqNullSafe(alike), F.lit(False)), 1, 0)))

    return run


def _alike(make: Callable[[Column], Column]) -> Callable[..., Counted]:
    """Of how many rows have the value; null is a value."""
    return lambda c, partition_by=None: Counted((*[col(x) for x in as_list(partition_by)], c), make)


COLUMN_METHODS: dict[str, Callable[..., Column]] = {
    "abs": F.abs,
    "round": lambda c, decimals=0: F.round(c, decimals),
    "cast": lambda c, dtype: cast(c, resolve(dtype)),
    "floor": F.floor,
    "ceil": F.ceil,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "log": lambda c, base=None: F.log(c) if base is None else F.log(float(base), c),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "pow": lambda c, exponent: F.pow(c, F.lit(exponent)),
    "sign": F.signum,
    "clip": _clip,
    "is_finite": lambda c: ~F.isnan(c) & ~c.isin(float("inf"), float("-inf")),
    "fill_null": _fill_null,
    "fill_nan": lambda c, value=None: F.when(F.isnan(c), F.lit(value)).otherwise(c),
    "is_null": lambda c: c.isNull(),
    "is_not_null": lambda c: c.isNotNull(),
    "is_nan": lambda c: F.coalesce(F.isnan(c), F.lit(False)),
    "is_in": lambda c, other: c.isin(list(other)),
    "is_between": lambda c, lower_bound, upper_bound: c.between(F.lit(lower_bound), F.lit(upper_bound)),
    "replace_strict": _replace_strict,
    "shift": _over(lambda c, w, n=1: F.lag(c, n).over(w), _shift),
    "diff": _over(lambda c, w, n=1: c - F.lag(c, n).over(w), lambda c, n=1: lambda frame: c - _shift(c, n)(frame)),
    "cum_sum": _cumulative("sum"),
    "cum_max": _cumulative("max"),
    "cum_min": _cumulative("min"),
    "cum_count": _cumulative("count"),
    "rank": _rank,
    "is_duplicated": _alike(lambda n: n > 1),
    "is_unique": _alike(lambda n: n == 1),
    "is_first_distinct": _occurrence(False),
    "is_last_distinct": _occurrence(True),
    "rolling_sum": _rolling("sum"),
    "rolling_mean": _rolling("avg"),
    "rolling_min": _rolling("min"),
    "rolling_max": _rolling("max"),
    "rolling_median": _rolling("median_of_rows"),
    "rolling_std": _rolling("stddev_samp"),
    "rolling_var": _rolling("var_samp"),
    "str.strip_chars": _strip("both"),
    "str.strip_chars_start": _strip("start"),
    "str.strip_chars_end": _strip("end"),
    "str.to_lowercase": F.lower,
    "str.to_uppercase": F.upper,
    "str.to_titlecase": F.initcap,
    "str.replace_all": _replace(True),
    "str.replace": _replace(False),
    "str.contains": _contains,
    "str.starts_with": lambda c, prefix: c.startswith(prefix),
    "str.ends_with": lambda c, suffix: c.endswith(suffix),
    "str.slice": _slice,
    "str.head": _head,
    "str.tail": _tail,
    "str.len_chars": F.char_length,
    "str.len_bytes": F.octet_length,
    "str.split": lambda c, by: F.split(c, _escape(by)),
    "str.zfill": _zfill,
    "str.to_date": lambda c, format=None: F.try_to_date(c, dates.pattern(format)) if format else c.try_cast("date"),
    "str.to_datetime": lambda c, format=None: F.try_to_timestamp(c, F.lit(dates.pattern(format))) if format else c.try_cast("timestamp"),
    "dt.year": F.year,
    "dt.month": F.month,
    "dt.quarter": F.quarter,
    "dt.week": F.weekofyear,
    "dt.day": F.dayofmonth,
    "dt.hour": F.hour,
    "dt.minute": F.minute,
    "dt.second": F.second,
    "dt.ordinal_day": F.dayofyear,
    "dt.weekday": lambda c: F.weekday(c) + 1,
    "dt.date": F.to_date,
    "dt.millisecond": dates.part_of_second(1000),
    "dt.microsecond": dates.part_of_second(1_000_000),
    "dt.nanosecond": dates.part_of_second(1_000_000_000),
    "dt.timestamp": dates.epoch,
    "dt.to_string": lambda c, format: F.date_format(c, dates.pattern(format)),
    "dt.truncate": dates.truncate,
    "dt.offset_by": dates.offset_by,
    "dt.replace_time_zone": lambda c, time_zone: F.to_utc_timestamp(c, time_zone),
    "dt.total_days": dates.total(86_400_000_000),
    "dt.total_hours": dates.total(3_600_000_000),
    "dt.total_minutes": dates.total(60_000_000),
    "dt.total_seconds": dates.total(1_000_000),
    "dt.total_milliseconds": dates.total(1000),
    "dt.total_microseconds": dates.total(1),
    "dt.total_nanoseconds": dates.total(0.001),
    "dt.convert_time_zone": lambda c, time_zone: F.convert_timezone(F.lit("UTC"), F.lit(time_zone), c),
    "list.len": F.size,
    "list.sort": lambda c, descending=False: F.sort_array(c, not descending),
    "list.unique": F.array_distinct,
    "list.contains": lambda c, item: F.array_contains(c, item),
    "list.get": lambda c, index: F.get(c, F.lit(index)),
    "list.max": F.array_max,
    "list.min": F.array_min,
    "struct.field": lambda c, name: c.getField(name),
}


def column_method(name: str) -> Callable[..., Column]:
    """A registered method; ValueError for more than one dot or an unknown name."""
    if name.count(".") > 1:
        raise ValueError(f"'{name}': at most one accessor")
    if name not in COLUMN_METHODS:
        raise ValueError(f"unknown column method '{name}'; known are {sorted(COLUMN_METHODS)}")
    return COLUMN_METHODS[name]


def _all(columns: list[Column], ignore_nulls: bool = False) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(True)) if ignore_nulls else c for c in columns])


def _any(columns: list[Column], ignore_nulls: bool = False) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) if ignore_nulls else c for c in columns])


def _concat(columns: list[Column], separator: str = "", ignore_nulls: bool = False) -> Column:
    texts = [c.cast("string") for c in columns]
    if ignore_nulls:
        return F.concat_ws(separator, *texts)
    return F.concat(*[x for t in texts for x in (F.lit(separator), t)][1:])


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in columns])


def _mean(columns: list[Column]) -> Column:
    known = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in columns])
    return F.try_divide(_sum([c.cast("double") for c in columns]), known.cast("double"))


HORIZONTAL: dict[str, Callable[..., Column]] = {
    "coalesce": lambda cs: F.coalesce(*cs),
    "concat_str": _concat,
    "max_horizontal": lambda cs: F.greatest(*cs) if len(cs) > 1 else cs[0],
    "min_horizontal": lambda cs: F.least(*cs) if len(cs) > 1 else cs[0],
    "sum_horizontal": _sum,
    "mean_horizontal": _mean,
    "all_horizontal": _all,
    "any_horizontal": _any,
    "format": lambda cs, template: F.concat(*_pieces(template, cs)),
}


def _pieces(template: str, columns: list[Column]) -> list[Column]:
    """The template's text with a column for each {}."""
    texts = template.split("{}")
    if len(texts) != len(columns) + 1:
        raise ValueError(f"'{template}' has {len(texts) - 1} places for {len(columns)} columns")
    out = [F.lit(texts[0])]
    for c, text in zip(columns, texts[1:], strict=True):
        out += [c.cast("string"), F.lit(text)]
    return out


def _sort(df: DataFrame, by: Any, *more: str, descending: bool | list[bool] = False, nulls_last: bool = False) -> DataFrame:
    names = as_list(by) + list(more)
    down = [descending] * len(names) if isinstance(descending, bool) else list(descending)
    if len(down) != len(names):
        raise ValueError("'descending' must be one value or one for each column")
    kinds = {(False, False): "asc_nulls_first", (False, True): "asc_nulls_last", (True, False): "desc_nulls_first", (True, True): "desc_nulls_last"}
    return df.orderBy(*[getattr(col(n), kinds[d, nulls_last])() for n, d in zip(names, down, strict=True)])


def _unique(df: DataFrame, subset: Any = None, keep: str = "any", **_: Any) -> DataFrame:
    if keep == "none":
        keys = as_list(subset) or df.columns
        row = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
        once = df.groupBy(*[col(k).alias(f"weftline__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"), F.first(row).alias("row")).filter("n = 1")
        return once.select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(df.columns)])
    if keep != "any":
        raise ValueError("rows have no order in Spark: 'keep' is 'any' or 'none'")
    return df.dropDuplicates(as_list(subset)) if subset is not None else df.dropDuplicates()


def _sample(df: DataFrame, n: int | None = None, fraction: float | None = None, with_replacement: bool = False, seed: int | None = None) -> DataFrame:
    if (n is None) == (fraction is None):
        raise ValueError("give either 'n' or 'fraction'")
    if fraction is not None:
        return df.sample(with_replacement, fraction, seed)
    if with_replacement:
        raise ValueError("'n' rows cannot be drawn with replacement")
    return sample_rows(df, n, random.getrandbits(31) if seed is None else seed)


def _explode(df: DataFrame, columns: Any) -> DataFrame:
    for c in as_list(columns):
        df = df.select(*[F.explode_outer(col(x)).alias(x) if x == c else col(x) for x in df.columns])
    return df


def _rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.select(*[col(c).alias(mapping.get(c, c)) for c in df.columns])


def _top(descending: bool) -> Callable[..., DataFrame]:
    return lambda df, k, by: _sort(df, by, descending=descending, nulls_last=True).limit(k)


def _join_asof(df: DataFrame, other: DataFrame, on: str, by: Any = None, strategy: str = "backward", suffix: str = "_right", tolerance: Any = None) -> DataFrame:
    """For each row the other frame's latest row at or before it (``backward``), the first at or after it (``forward``), or the ``nearest``, the one before where both are as near.

    Both sides are sorted together by ``by`` and ``on`` over all tasks, and the last row of the other side is carried along, over borders of tasks too; it counts
    where ``by`` is the same. So neither no ``by`` nor one value of most rows puts many rows in one task. Equal times match; of the
    other frame's rows at one time any one is taken. Null times and keys match nothing. ``tolerance``: the most that both may be apart, a number or, for times, an interval such as 2h.
    """
    if strategy not in ("backward", "forward", "nearest"):
        raise ValueError("'strategy' is 'backward', 'forward' or 'nearest'")
    keys = as_list(by)
    taken = [c for c in other.columns if c != on and c not in keys]
    names = {c: c + suffix if c in df.columns else c for c in taken}
    mine, held = "weftline__left", "weftline__right"
    key = [f"weftline__k{i}" for i in range(len(keys))]
    at = F.struct(*[F.col(k) for k in key], F.lit(0))  # of the keys

    def side(frame: DataFrame, name: str, columns: list[str]) -> DataFrame:
        row = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.lit(0).alias("there"))
        return frame.select(*[col(k).alias(n) for k, n in zip(keys, key, strict=True)], col(on).alias("weftline__on"), row.alias(name))

    known = reduce(lambda a, b: a & b, [col(k).isNotNull() for k in [on, *keys]])
    both = side(df, mine, df.columns).unionByName(side(other.filter(known), held, taken), allowMissingColumns=True)
    # rows of the other side come first at equal times where looking back, last where looking ahead
    is_mine = F.col(mine).isNotNull()
    frame = Frame(both, [*[By(F.col(k)) for k in key], By(F.col("weftline__on")), By(is_mine, strategy == "forward")])
    candidate = F.when(~is_mine, F.struct(at.alias("by"), F.col("weftline__on").alias("on"), F.col(held).alias("row")))
    if strategy != "forward":
        frame.add("weftline__before", frame.want(Running("last_known", candidate, None, 0)))
    if strategy != "backward":
        frame.add("weftline__behind", frame.want(Running("first_known", candidate, 0, None)))
    out, own = frame.result().filter(is_mine), F.col("weftline__on")

    def near(name: str, sign: int) -> Column:
        c = F.col(name)
        fits = (c["by"] == at) & own.isNotNull()
        if isinstance(tolerance, str):
            fits &= (dates.offset_by(c["on"], tolerance) >= own.cast("timestamp")) if sign < 0 else (dates.offset_by(own, tolerance) >= c["on"].cast("timestamp"))
        elif tolerance is not None:
            fits &= (own - c["on"]) * -sign <= tolerance
        return F.when(fits, c)

    if strategy == "nearest":
        a, b = near("weftline__before", -1), near("weftline__behind", 1)
        found = F.when(a.isNull() | (b["on"] - own < own - a["on"]), F.coalesce(b, a)).otherwise(a)
    else:
        found = near("weftline__before", -1) if strategy == "backward" else near("weftline__behind", 1)
    out = out.withColumn("weftline__found", found["row"])
    return out.select(*[F.col(mine)[f"c{i}"].alias(c) for i, c in enumerate(df.columns)], *[F.col("weftline__found")[f"c{i}"].alias(names[c]) for i, c in enumerate(taken)])


FRAME_METHODS: dict[str, Callable[..., DataFrame]] = {
    "sort": _sort,
    "unique": _unique,
    "head": lambda df, n=5: df.limit(n),
    "limit": lambda df, n: df.limit(n),
    "sample": _sample,
    "tail": lambda df, n=5, by=None: _tail_rows(df, n, by),
    "rename": _rename,
    "explode": _explode,
    "top_k": _top(True),
    "bottom_k": _top(False),
    "drop": lambda df, *columns, strict=False: df.drop(*[x for c in columns for x in as_list(c)]),
    "select": lambda df, *columns: df.select(*[col(x) for c in columns for x in as_list(c)]),
    "drop_nulls": lambda df, subset=None: df.filter(reduce(lambda a, b: a & b, [col(c).isNotNull() for c in as_list(subset) or df.columns])),
    "with_row_index": lambda df, name="index", order_by=None: _row_index(df, name, order_by),
    "join_asof": _join_asof,
    "gather_every": lambda df, n, offset=0, order_by=None: _gather_every(df, n, offset, order_by),
    "unpivot": lambda df, on=None, index=None, variable_name="variable", value_name="value": _unpivot(df, on, index, variable_name, value_name),
    "clear": lambda df: df.limit(0),
    "filter": lambda df, *predicates: df.filter(reduce(lambda a, b: a & b, [F.expr(p) for p in predicates])),
    "with_columns": lambda df, **columns: df.withColumns({c: F.expr(e) for c, e in columns.items()}),
    "null_count": lambda df: df.agg(*[F.count_if(col(c).isNull()).alias(c) for c in df.columns]),
}


def _tail_rows(df: DataFrame, n: int, by: Any) -> DataFrame:
    if by is None:
        raise ValueError("rows have no order in Spark: 'tail' needs 'by'")
    return _sort(df, by, descending=True, nulls_last=True).limit(n)


def _row_index(df: DataFrame, name: str, order_by: Any) -> DataFrame:
    """Row numbers from 0 in the order given."""
    if order_by is None:
        raise ValueError("rows have no order in Spark: 'with_row_index' needs 'order_by'")
    rows, _ = ordered.number(df, [By(col(c)).directed() for c in as_list(order_by)])
    return rows.select(F.col(ordered.ROW).alias(name), *[col(c) for c in df.columns if c != name])


def _gather_every(df: DataFrame, n: int, offset: int, order_by: Any) -> DataFrame:
    """Every n-th row in the order given, from row ``offset`` on."""
    if order_by is None:
        raise ValueError("rows have no order in Spark: 'gather_every' needs 'order_by'")
    if n < 1 or offset < 0:
        raise ValueError("'n' is 1 or more, 'offset' 0 or more")
    rows, _ = ordered.number(df, [By(col(c)).directed() for c in as_list(order_by)])
    row = F.col(ordered.ROW)
    return rows.filter((row >= offset) & ((row - offset) % n == 0)).select(*[col(c) for c in df.columns])


def _unpivot(df: DataFrame, on: Any, index: Any, variable_name: str, value_name: str) -> DataFrame:
    """A row for each of the columns ``on``, by default all but ``index``. NULLs stay."""
    ids = as_list(index)
    values = as_list(on) or [c for c in df.columns if c not in ids]
    return df.unpivot([col(c) for c in ids], [col(c) for c in values], variable_name, value_name)


def frame_method(name: str) -> Callable[..., DataFrame]:
    if name not in FRAME_METHODS:
        raise ValueError(f"unknown dataframe method '{name}'; known are {sorted(FRAME_METHODS)}")
    return FRAME_METHODS[name]

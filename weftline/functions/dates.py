"""Dates and intervals of the portable methods: strftime formats, interval texts, truncation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strftime directives and Spark's date pattern of each.
DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "j": "DDD", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a",
    "b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "f": "SSSSSS", "3f": "SSS", "6f": "SSSSSS", ".f": ".SSSSSS", ".3f": ".SSS", ".6f": ".SSSSSS",
    "z": "xx", ":z": "xxx", "Z": "z", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy",
}

#: Units of an interval text and of date_trunc.
UNITS = {"y": "year", "q": "quarter", "mo": "month", "w": "week", "d": "day", "h": "hour", "m": "minute", "s": "second", "ms": "millisecond", "us": "microsecond"}
MICROS = {"h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000, "ms": 1000, "us": 1}
MONTHS = {"y": 12, "q": 3, "mo": 1}


def pattern(format: str) -> str:
    """Spark's date pattern of a strftime format; a text without % is a pattern already. ValueError for unknown directives."""
    if "%" not in format:
        return format
    out = []
    for directive, text in re.findall(r"%(%|[:.]?\d?[A-Za-z])|([^%]+|%)", format):
        if directive and directive != "%":
            if directive not in DIRECTIVES:
                raise ValueError(f"'%{directive}' in '{format}' is not supported; known are {sorted(DIRECTIVES)}")
            out.append(DIRECTIVES[directive])
        elif text == "%":
            raise ValueError(f"'{format}' has a % without a directive")
        else:
            literal = text or "%"
            out.append("'" + literal.replace("'", "''") + "'" if re.search(r"[A-Za-z'\[\]{}#%]", literal) else literal)
    return "".join(out)


def intervals(text: str) -> list[tuple[int, str]]:
    """(number, unit) of an interval text such as 15m, 1mo or 1d12h; one sign before it holds for all."""
    sign, body = (-1, text[1:]) if text.startswith("-") else (1, text)
    found = re.findall(r"(\d+)(mo|ms|us|[yqwdhms])", body)
    if not found or "".join(n + u for n, u in found) != body:
        raise ValueError(f"'{text}' is not an interval; units are {sorted(UNITS)}")
    return [(sign * int(n), u) for n, u in found]


def truncate(c: Column, every: str) -> Column:
    """The start of the interval that a time is in, as a timestamp. Weeks begin on Mondays; several of a unit are counted from 1970, days and less in UTC."""
    (n, unit), *more = intervals(every)
    if more or n < 1:
        raise ValueError(f"'{every}': one unit and a number above 0")
    if n == 1:
        return F.date_trunc(UNITS[unit], c)
    if unit in MONTHS:
        months = (F.year(c) - 1970) * 12 + F.month(c) - 1
        start = months - F.pmod(months, F.lit(n * MONTHS[unit]))
        return F.add_months(F.lit("1970-01-01").cast("date"), start.cast("int")).cast("timestamp")
    if unit in ("d", "w"):
        first = F.lit("1970-01-01" if unit == "d" else "1970-01-05").cast("date")
        days = F.datediff(c, first)
        return F.date_add(first, (days - F.pmod(days, F.lit(n * (7 if unit == "w" else 1)))).cast("int")).cast("timestamp")
    micros = F.unix_micros(c.cast("timestamp"))
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(n * MICROS[unit])))


def offset_by(c: Column, by: str) -> Column:
    """A time, so much later or earlier; days of months that are too short become their last."""
    sums = dict.fromkeys(UNITS, 0)
    for n, unit in intervals(by):
        sums[unit] += n
    months = sum(sums[u] * k for u, k in MONTHS.items())
    micros = sum(sums[u] * k for u, k in MICROS.items())
    whole = F.make_interval(F.lit(0), F.lit(months), F.lit(sums["w"]), F.lit(sums["d"]), F.lit(0), F.lit(0), F.lit(0).cast("decimal(18,6)"))
    moved = c.cast("timestamp") + whole
    return F.timestamp_micros(F.unix_micros(moved) + F.lit(micros)) if micros else moved


def epoch(c: Column, time_unit: str = "us") -> Column:
    """Time since 1970 in ns, us or ms, rounded down."""
    micros = F.unix_micros(c.cast("timestamp"))
    if time_unit not in ("ns", "us", "ms"):
        raise ValueError(f"unit '{time_unit}': ns, us or ms")
    return {"ns": micros * 1000, "us": micros, "ms": F.call_function("div", micros - F.pmod(micros, F.lit(1000)), F.lit(1000))}[time_unit].cast("bigint")


def part_of_second(per_second: int):
    """The part of a time below a second, in so many parts of it."""

    def part(c: Column) -> Column:
        micros = F.pmod(F.unix_micros(c.cast("timestamp")), F.lit(1_000_000))
        return (micros * (per_second // 1_000_000) if per_second > 1_000_000 else F.call_function("div", micros, F.lit(1_000_000 // per_second))).cast("bigint")

    return part


def total(micros_each: float):
    """A day-time interval in whole units, without its rest."""

    def whole(c: Column) -> Column:
        part = lambda name: F.extract(F.lit(name), c)
        seconds = ((part("DAY") * 24 + part("HOUR")) * 60 + part("MINUTE")) * 60
        micros = seconds.cast("bigint") * 1_000_000 + (part("SECOND") * 1_000_000).cast("bigint")
        return micros * int(1 / micros_each) if micros_each < 1 else F.call_function("div", micros, F.lit(int(micros_each)))

    return whole

"""Portable type names and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Portable names and the Spark type of each.
PORTABLE = {
    "int": "bigint", "integer": "bigint", "long": "bigint", "int64": "bigint",
    "int8": "tinyint", "int16": "smallint", "int32": "int",
    "float": "double", "double": "double", "float64": "double", "float32": "float",
    "str": "string", "string": "string", "utf8": "string",
    "bool": "boolean", "boolean": "boolean",
    "date": "date", "datetime": "timestamp",
    "duration": "interval day to second", "timedelta": "interval day to second",
}
UNSIGNED = ("uint8", "uint16", "uint32", "uint64")
_WITH_UNIT = re.compile(r"(datetime|duration|timedelta)\[(us|ms|ns)\]")


def portable(name: str) -> str | None:
    """The Spark type of a portable name, in lower case; None if it is not one.

    Spark keeps microseconds: ``ms`` and ``us`` are both stored so, ``ns`` cannot be and is refused, as are unsigned
    integers, which Spark lacks.
    """
    if name in UNSIGNED:
        raise ValueError(f"Spark has no unsigned type '{name}'; use the next larger signed one")
    if m := _WITH_UNIT.fullmatch(name):
        if m[2] == "ns":
            raise ValueError(f"'{name}': Spark has no nanoseconds")
        return PORTABLE[m[1]]
    return PORTABLE.get(name)


def resolve(name: str) -> str:
    """The Spark type of a portable name in any case; unknown ones raise a ValueError."""
    found = portable(str(name).lower())
    if found is None:
        raise ValueError(f"unknown type '{name}'; known are {sorted(PORTABLE)}")
    return found


def resolve_all(types: dict[str, str]) -> dict[str, str]:
    """Types by column: all portable, or else all Spark's own.

    As soon as one is not portable, every name is read as Spark reads it, so that ``int`` then is Spark's 32-bit int.
    """
    found = {c: portable(str(t).lower()) for c, t in types.items() if str(t).lower() not in UNSIGNED}
    if len(found) < len(types):
        raise ValueError(f"Spark has no unsigned types: {types}")
    return {c: str(t) for c, t in types.items()} if None in found.values() else found


def cast(column: Column, spark_type: str, source: str | None = None) -> Column:
    """A cast that gives NULL where a text cannot be read, in place of ANSI's error; other casts are Spark's.

    Booleans in text and milliseconds behave as Spark's casts do.
    """
    if spark_type == "interval day to second" or source == "void":
        return column.cast(spark_type)
    return column.try_cast(spark_type) if source in (None, "string") else column.cast(spark_type)


def literal(value: object, spark_type: str | None = None) -> Column:
    """A literal; NULL without a type is a string, because a column of no type cannot be written."""
    if spark_type is None:
        return F.lit(None).cast("string") if value is None else F.lit(value)
    return F.lit(value).cast(spark_type)

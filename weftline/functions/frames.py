"""Whole-frame utilities: hashes, comparison, deterministic deduplication, splits, skew, schemas."""

from __future__ import annotations

import io
from collections.abc import Iterator
from contextlib import redirect_stdout
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.conditions import condition, null_to_false
from weftline.functions.selectors import as_list, col

HASHES = ("md5", "crc32", "sha1", "sha2", "xxhash64")


def get_spark_session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def planned_partitions(df: DataFrame) -> int:
    """Into how many partitions the plan puts the rows: those of the files, or of the last shuffle, before it is run and adapted to what there is. No stage runs for it."""
    conf, key = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    before = conf.get(key)
    conf.set(key, "false")  # an adaptive plan runs its shuffles to tell
    try:
        return df.select(*map(col, df.columns)).rdd.getNumPartitions()
    finally:
        conf.set(key, before)


def get_default_spark_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cast_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order; only those of another type are cast. Numbers of columns must be equal."""
    if len(df.columns) != len(schema.fields):
        raise AssertionError(f"{len(df.columns)} columns, but the schema has {len(schema.fields)}")
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[col(f.name) if have.get(f.name) == f.dataType else col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def row_hash(columns: list[str], hash_name: str = "md5", num_bits: int = 256) -> Column:
    """A hash of the columns, sorted by name, as texts joined by '-'. NULLs vanish in it, so that rows that differ in where NULLs are may agree."""
    if hash_name not in HASHES:
        raise ValueError(f"unknown hash '{hash_name}'; known are {HASHES}")
    text = F.concat_ws("-", *[col(c).cast("string") for c in sorted(columns)])
    return F.sha2(text, num_bits) if hash_name == "sha2" else getattr(F, hash_name)(text.cast("binary") if hash_name == "crc32" else text)


def hash_dataframe(
    df: DataFrame, hash_name: str = "md5", new_col: str | None = None, num_bits: int = 256, return_func: bool = False
) -> DataFrame | Column:
    """Adds the row hash as ``new_col``, or returns the hash column itself."""
    hashed = row_hash(df.columns, hash_name, num_bits)
    if return_func:
        return hashed
    if not new_col:
        raise ValueError("give 'new_col' or 'return_func'")
    return df.withColumn(new_col, hashed)


def compare_dfs(
    df1: DataFrame,
    df2: DataFrame,
    columns: str | list[str] | None = None,
    raise_if_row_number_mismatch: bool = True,
    return_mismatched_rows: bool = False,
) -> tuple[DataFrame | None, DataFrame | None]:
    """Raises AssertionError unless columns, types, number of rows and the rows themselves, repetitions included, agree.

    Rows are compared by counts per row, on the cluster: by a hash of the row as JSON, where nulls are written and texts quoted. With ``return_mismatched_rows`` nothing is raised for rows: the
    rows that one side has more often are returned.
    """
    names = as_list(columns)
    if names:
        df1, df2 = df1.select(*map(col, names)), df2.select(*map(col, names))
    if set(df1.columns) != set(df2.columns):
        raise AssertionError(f"columns differ: {sorted(set(df1.columns) ^ set(df2.columns))}")
    df2 = df2.select(*map(col, df1.columns))
    kinds1, kinds2 = dict(df1.dtypes), dict(df2.dtypes)
    if kinds1 != kinds2:
        raise AssertionError(f"types differ: {[(c, kinds1[c], kinds2[c]) for c in kinds1 if kinds1[c] != kinds2[c]]}")
    if raise_if_row_number_mismatch and (n1 := df1.count()) != (n2 := df2.count()):
        raise AssertionError(f"rows differ in number: {n1} and {n2}")
    key = "weftline__hash"
    one, two = (d.withColumn(key, F.sha2(F.to_json(F.struct(*map(col, d.columns)), {"ignoreNullFields": "false"}), 256)) for d in (df1, df2))
    counted = [d.groupBy(key).agg(F.count(F.lit(1)).alias(f"n{i}")) for i, d in enumerate((one, two))]
    both = counted[0].join(counted[1], key, "full").select(key, *[F.coalesce(f"n{i}", F.lit(0)).alias(f"n{i}") for i in (0, 1)])
    if return_mismatched_rows:
        return tuple(d.join(both.filter(c).select(key), key, "left_semi").drop(key) for d, c in ((one, "n0 > n1"), (two, "n1 > n0")))
    if odd := both.filter("n0 <> n1").limit(1).count():
        raise AssertionError(f"rows differ ({odd} kind of row at least)")
    return None, None


def drop_duplicates_no_randomness(df: DataFrame, subset: str | list[str], agg_func: str = "max") -> DataFrame:
    """One row per value of ``subset``, the same however the data lie.

    Every other column is the largest (or smallest) of its group, on its own: a row may combine values of several rows.
    Arrays and maps have no order there and take the first value. Columns come as subset, scalars, others.
    """
    if agg_func not in ("max", "min"):
        raise ValueError("'agg_func' is 'max' or 'min'")
    keys = as_list(subset)
    rest = [f for f in df.schema.fields if f.name not in keys]
    nested = [f.name for f in rest if isinstance(f.dataType, (T.ArrayType, T.MapType))]
    scalars = [f.name for f in rest if f.name not in nested]
    aggs = [getattr(F, agg_func)(col(c)).alias(c) for c in scalars] + [F.first(col(c)).alias(c) for c in nested]
    return df.groupBy(*map(col, keys)).agg(*aggs) if aggs else df.select(*map(col, keys)).distinct()


def orderable(c: Column, kind: T.DataType) -> Column:
    """A value in a form that can be compared, equal only for equal values: maps become their entries, sorted, within arrays and structs too."""
    if isinstance(kind, T.MapType):
        return F.when(c.isNotNull(), F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(orderable(e["key"], kind.keyType).alias("key"), orderable(e["value"], kind.valueType).alias("value")))))
    if isinstance(kind, T.ArrayType) and _has_map(kind):
        return F.transform(c, lambda x: orderable(x, kind.elementType))
    if isinstance(kind, T.StructType) and _has_map(kind):
        return F.when(c.isNotNull(), F.struct(*[orderable(c.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]))
    return c


def _has_map(kind: T.DataType) -> bool:
    parts = {T.MapType: lambda: True, T.ArrayType: lambda: _has_map(kind.elementType), T.StructType: lambda: any(_has_map(f.dataType) for f in kind.fields)}
    return parts.get(type(kind), lambda: False)()


def drop_duplicates_keeping_rows(df: DataFrame, subset: str | list[str], agg_func: str = "max") -> DataFrame:
    """One row for each value of the subset, a row of the input as it stands: the greatest, or with ``min`` the least, of them.

    Rows are compared column by column in the frame's order; NULL is less than all values, maps are compared by their sorted entries. So the
    row does not depend on how the data lie. Parts are reduced before the shuffle, so that a value of many rows is no burden. Columns keep their order.
    """
    if agg_func not in ("max", "min"):
        raise ValueError("'agg_func' is 'max' or 'min'")
    keys = as_list(subset)
    if missing := [k for k in keys if k not in df.columns]:
        raise AssertionError(f"columns not in the dataframe: {missing}")
    rest = [f for f in df.schema.fields if f.name not in keys]
    alike = [orderable(col(k), df.schema[k].dataType).alias(f"k{i}") for i, k in enumerate(keys)]
    row = F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    # keys that are alike may still be written differently (-0.0, entries of maps in another order), so that they are compared last
    order = F.struct(F.lit(0), *[orderable(col(f.name), f.dataType).alias(f"o{i}") for i, f in enumerate(rest)], *[col(k).cast("string").alias(f"s{i}") for i, k in enumerate(keys)])
    best = (F.max_by if agg_func == "max" else F.min_by)(row, order)
    return df.groupBy(*alike).agg(best.alias("row")).select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(df.columns)])


def row_digest(df: DataFrame, columns: list[str] | None = None) -> Column:
    """md5, as 16 bytes, of a row: each value as text, with its length in bytes before it, so that NULLs and borders of columns are told apart."""
    texts = [orderable(col(c), df.schema[c].dataType).cast("string") for c in columns or df.columns]
    return F.unhex(F.md5(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary")))


#: Copies of a row that a task numbers at a time.
COPIES = 1 << 20


def sample_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` rows, or all where there are fewer, each set of them as likely; the same ones however the rows lie, and whatever else the session does.

    Rows are known by their digest, copies of a row by numbers from 0, and those with the least md5 of seed, number and digest are taken. The search moves
    digests and counts alone: copies are counted where they lie, so that a row of many copies is numbered in blocks by several tasks. Only rows that are
    taken are looked up again.
    """
    digest = "weftline__digest"
    keyed = df.withColumn(digest, row_digest(df))
    counts = keyed.groupBy(digest).agg(F.count(F.lit(1)).alias("n"))
    blocks = counts.select(digest, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {COPIES}"))).alias("block")).repartition(digest, "block")
    begin = F.col("block") * COPIES
    copies = blocks.select(digest, F.explode(F.sequence(begin, F.least(begin + (COPIES - 1), F.col("n") - 1))).alias("copy"))
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.col("copy").cast("string"), F.lit(":"), F.lower(F.hex(digest))).cast("binary"))
    taken = copies.orderBy(drawn, digest, "copy").limit(n).groupBy(digest).agg(F.count(F.lit(1)).alias("weftline__n"))
    row = F.first(F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])).alias("row")
    found = keyed.join(taken, digest).groupBy(digest).agg(row, F.first("weftline__n").alias("n"))
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n")))).select(*[F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(df.columns)])


@dataclass
class Skew:
    """Rows per partition."""

    partitions: int
    rows: int
    mean: float
    std: float
    min: int
    q25: float
    q50: float
    q75: float
    max: int


def get_data_skew(df: DataFrame, persist: bool = False) -> Skew:
    """How rows are spread over partitions, empty ones included: one job, whose tasks count what they have; a row each on the driver."""
    if persist and not df.is_cached:
        df = df.persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"n": [sum(b.num_rows for b in batches)]})

    counts = sorted(r["n"] for r in df.select(F.lit(1).alias("one")).mapInArrow(count, "n bigint").collect())
    mean = sum(counts) / len(counts) if counts else 0.0
    std = (sum((c - mean) ** 2 for c in counts) / (len(counts) - 1)) ** 0.5 if len(counts) > 1 else 0.0

    def quantile(q: float) -> float:
        at = q * (len(counts) - 1)
        low = int(at)
        return counts[low] + (counts[min(low + 1, len(counts) - 1)] - counts[low]) * (at - low)

    if not counts:
        return Skew(0, 0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0)
    return Skew(len(counts), sum(counts), mean, std, counts[0], quantile(0.25), quantile(0.5), quantile(0.75), counts[-1])


def is_broadcast(df: DataFrame) -> bool:
    """Whether the plan has a broadcast or its hint."""
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(True)
    return "broadcast" in out.getvalue().lower()


def get_native_schema(df: DataFrame) -> T.StructType:
    """The schema to go back to by ``to_schema``."""
    return df.schema


def to_schema(frames: list[DataFrame], schema: T.StructType) -> list[DataFrame]:
    """Every frame cast to one schema."""
    return [cast_to_schema(f, schema) for f in frames]


def df_is_empty(df: DataFrame) -> bool:
    """Whether there is no row; looks for one."""
    return df.isEmpty()


def split_df(df: DataFrame, input_col: str, operator: str, value: Any = None, compare_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows where a condition is true, and all others, those where it is NULL too."""
    cond = condition(input_col, operator, value, compare_col)
    return df.filter(cond), df.filter(~null_to_false(cond))

"""Shards by a Feistel permutation of global row numbers.

Row number i goes to place p(i) of a permutation of 0..n-1; shard p mod k, slot p div k. Both are computable from i, n
and the seed alone, and ``row_of`` gives the row number back. Shards differ by one row at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.staging import scoped, stage

ROUNDS = 6
#: Cycle walking ends when the walk is back in the domain. The network's domain exceeds n by less than its side, so one step in many needs a second one; MAX_WALK is far beyond what can occur, and is checked.
MAX_WALK = 64
_MASK = (1 << 31) - 1


def round_key(seed: int, r: int) -> int:
    """The key of round r, below 2**31."""
    x = (seed * 0x9E3779B1 + r * 0x85EBCA77 + 0x165667B1) & 0xFFFFFFFF
    x = ((x ^ (x >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF
    x = ((x ^ (x >> 12)) * 0x297A2D39) & 0xFFFFFFFF
    return (x ^ (x >> 15)) & _MASK


def sides(n: int) -> tuple[int, int]:
    """a, b with a * b >= n and a * b - n < a."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def mix(x: int, key: int) -> int:
    """The round function, below 2**31; products stay below 2**63."""
    x = (x + key) % 2147483647
    x = ((x ^ (x >> 11)) * 1103515245 + 12345) % 2147483647
    return ((x ^ (x >> 13)) * 1220703125 + key) % 2147483647


def network(x: int, n: int, seed: int) -> int:
    """One pass of the unbalanced network over 0..a*b-1."""
    a, b = sides(n)
    left, right = x // b, x % b
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = (left + mix(right, round_key(seed, r))) % a
        else:
            right = (right + mix(left, round_key(seed, r))) % b
    return left * b + right


def place_of(i: int, n: int, seed: int) -> int:
    """The place of row number i."""
    x = network(i, n, seed)
    while x >= n:
        x = network(x, n, seed)
    return x


def row_of(place: int, n: int, seed: int) -> int:
    """The row number at a place."""
    a, b = sides(n)

    def back(x: int) -> int:
        left, right = x // b, x % b
        for r in reversed(range(ROUNDS)):
            if r % 2 == 0:
                left = (left - mix(right, round_key(seed, r))) % a
            else:
                right = (right - mix(left, round_key(seed, r))) % b
        return left * b + right

    x = back(place)
    while x >= n:
        x = back(x)
    return x


def _div(x: Column, by: int) -> Column:
    """Whole division; exact below 2**53, as what is divided is a multiple."""
    return ((x - x % F.lit(by)) / F.lit(by)).cast("bigint")


def _network_column(x: Column, n: int, seed: int) -> Column:
    """``network`` as an expression. Each round is a step of one fold over constants, so that the expression stays small."""
    a, b = sides(n)
    steps = F.array(*[F.struct(F.lit(r % 2 == 0).alias("first"), F.lit(round_key(seed, r)).cast("bigint").alias("key")) for r in range(ROUNDS)])

    def step(s: Column, k: Column) -> Column:
        def mixed(v: Column) -> Column:
            v = (v + k["key"]) % F.lit(2147483647)
            v = (v.bitwiseXOR(F.shiftright(v, 11)) * F.lit(1103515245) + F.lit(12345)) % F.lit(2147483647)
            return (v.bitwiseXOR(F.shiftright(v, 13)) * F.lit(1220703125) + k["key"]) % F.lit(2147483647)

        left = F.when(k["first"], (s["l"] + mixed(s["r"])) % F.lit(a)).otherwise(s["l"])
        right = F.when(k["first"], s["r"]).otherwise((s["r"] + mixed(s["l"])) % F.lit(b))
        return F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    start = F.struct(_div(x, b).alias("l"), (x % F.lit(b)).cast("bigint").alias("r"))
    return F.aggregate(steps, start, step, lambda s: s["l"] * F.lit(b) + s["r"])


def place_column(i: Column, n: int, seed: int) -> Column:
    """``place_of`` as an expression; a walk of more than MAX_WALK steps raises instead of giving a wrong place."""
    first = _network_column(i, n, seed)
    walked = F.aggregate(F.sequence(F.lit(2), F.lit(MAX_WALK)), first, lambda x, _: F.when(x < F.lit(n), x).otherwise(_network_column(x, n, seed)))
    return F.when(walked < F.lit(n), walked).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("bigint"))


def numbered(df: DataFrame, order: list[Column], name: str = "weftline__row") -> DataFrame:
    """``df`` with global row numbers from 0 in the given order.

    A range shuffle sorts the rows over all tasks; rows equal in ``order`` are told apart by where they were read, so
    that copies of one row spread too. The sorted rows are staged with their task and their place in it; the offsets of
    the tasks, as many as there are tasks, are summed and broadcast. No task sees all rows.
    """
    at, part, rank, tie = f"{name}__at", f"{name}__part", f"{name}__rank", f"{name}__tie"
    mask = F.lit((1 << 33) - 1)
    spread = df.withColumn(tie, F.monotonically_increasing_id()).sort(*order, F.col(f"`{tie}`")).drop(tie)
    kept = stage(
        spread.withColumn(at, F.monotonically_increasing_id())
        .withColumn(part, F.shiftright(F.col(f"`{at}`"), 33).cast("int"))
        .withColumn(rank, F.col(f"`{at}`").bitwiseAND(mask))
        .drop(at),
        "numbered",
    )
    sizes = kept.groupBy(F.col(f"`{part}`").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o"))
    joined = kept.join(F.broadcast(offsets), F.col(f"`{part}`") == F.col("p"), "inner")
    return joined.withColumn(name, F.col("o") + F.col(f"`{rank}`")).drop(part, rank, "p", "o")


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 16; null has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("bigint")


@scoped
def shard(df: DataFrame, order: list[Column], n_shards: int, seed: int = 1) -> DataFrame:
    """Adds shard (int, 0 to n_shards - 1) and slot (long, without gaps from 0) to all columns of ``df``.

    Shards differ by one row at most: law ``rows``. The result depends on the rows and the seed, not on how they are
    stored; rows equal in ``order`` may swap places. Nulls in ``order`` come first. Columns of ``df`` called shard or
    slot are replaced. An empty table gives an empty result with both columns.
    """
    df, row = df.drop("shard", "slot"), "weftline__row"
    rows = numbered(df, order, row)
    place = place_column(F.col(row), max(rows.count(), 1), seed)
    return (
        rows.withColumn(row, place)
        .withColumn("shard", (F.col(row) % n_shards).cast("int"))
        .withColumn("slot", _div(F.col(row), n_shards))
        .drop(row)
    )


def _rounds_sql(source: str) -> str:
    """One pass of the network over column x of ``source`` in DuckDB; other columns stay."""

    def mixed(v: str, key: str) -> str:
        one = f"(({v} + {key}) % 2147483647)"
        two = f"((xor({one}, {one} >> 11) * 1103515245 + 12345) % 2147483647)"
        return f"((xor({two}, {two} >> 13) * 1220703125 + {key}) % 2147483647)"

    out = f"SELECT *, x // b AS l, x % b AS r FROM {source}"
    for i in range(ROUNDS):
        key = f"KEY{i}"
        new = f"(l + {mixed('r', key)}) % a AS l" if i % 2 == 0 else f"(r + {mixed('l', key)}) % b AS r"
        out = f"SELECT * REPLACE ({new}) FROM ({out})"
    return f"SELECT * EXCLUDE (l, r) REPLACE (l * b + r AS x) FROM ({out})"


def shard_sql(n_shards: int, seed: int = 1) -> str:
    """The shards of table ``documents`` by doc_id in DuckDB; crc32 is folded byte by byte with a table made by its rule."""
    step = _rounds_sql("(SELECT * FROM w WHERE k = 0 OR x >= n)")
    for i in range(ROUNDS):
        step = step.replace(f"KEY{i}", str(round_key(seed, i)))
    return rf"""
    WITH RECURSIVE t AS (
        SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS crc
    ), h AS (
        SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
    ), d AS (
        SELECT doc_id, length(h) // 2 + 16 AS size,
               xor(list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT),
                               lambda c, v: xor(c >> 8, crc[xor(c & 255, v) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32
        FROM h, t
    ), w AS (
        SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY doc_id, text_crc32, size) - 1 AS x, 0 AS k, n, a, CAST(greatest(1, ceil(n / a)) AS BIGINT) AS b
        FROM d, (SELECT n, CAST(floor(sqrt(greatest(n - 1, 0))) AS BIGINT) + 1 AS a FROM (SELECT count(*) AS n FROM documents))
        UNION ALL
        SELECT * REPLACE (k + 1 AS k) FROM ({step})
    )
    SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {n_shards} AS INTEGER) AS shard, x // {n_shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM w WHERE k > 0 AND x < n
    """

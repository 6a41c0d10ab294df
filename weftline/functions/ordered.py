"""Windows over the order of a whole frame, without a task that holds all rows.

The rows are sorted by range over all tasks and numbered; what is numbered is checkpointed, as numbers must not change from
one use to the next. Rows then fall into chunks of equal size by their numbers, whatever the values they are sorted by.

* A frame of so many rows before and behind is a window within a chunk, to which the rows at the neighbours' borders are copied.
* A frame that begins or ends with the frame of rows is the same, and a carry: an aggregate of each chunk, summed over the
  chunks before (or behind) it. There are as many carries as chunks, a few for each task.
* Rows that are alike in the order (peers) are found by comparing neighbours; what holds for all of them is carried from the
  last one to the others.

Making such a frame sorts its rows, as a sort does when it is planned; all after that is lazy.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW, CHUNK = "weftline__row", "weftline__chunk"
_TIE, _PART, _AT, _FROM = "weftline__tie", "weftline__part", "weftline__at", "weftline__from"
#: Chunks for each shuffle partition.
CHUNKS_PER_TASK = 3

WindowSpec = Any


def reliable(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the folder of spark.checkpoint.dir; a local session without one gets a temporary folder."""
    spark: SparkSession = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir", None)
        if not shared:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="weftline-")
            atexit.register(shutil.rmtree, shared, True)
        sc.setCheckpointDir(shared)
    return df.checkpoint()


def number(df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, int]:
    """``df`` with its rows' numbers from 0 in the order given as column ROW, and their total.

    Rows equal in ``order`` are told apart by where they were read, so that many equal ones spread over tasks too.
    """
    if df.isStreaming:
        raise ValueError("a stream has no order of all its rows; use 'run_per_batch'")
    spread = df.withColumn(_TIE, F.monotonically_increasing_id()).sort(*order, F.col(_TIE)).drop(_TIE)
    placed = reliable(spread).withColumns({_PART: F.spark_partition_id(), _AT: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy(_PART).agg(F.count(F.lit(1)).alias("n")).collect()  # a row a task
    before, total = [], 0
    for r in sorted(counts):
        before.append((r[_PART], total))
        total += r["n"]
    offsets = df.sparkSession.createDataFrame(before, f"{_FROM}p int, {_FROM} bigint")
    rows = placed.join(F.broadcast(offsets), F.col(_PART) == F.col(f"{_FROM}p"))
    return rows.withColumn(ROW, F.col(_AT) + F.col(_FROM)).drop(_PART, _AT, _FROM, f"{_FROM}p"), total


@dataclass(frozen=True)
class Near:
    """What ``build`` makes of a window of all rows in order that looks at most so many rows back and ahead."""

    build: Callable[[WindowSpec], Column]
    back: int = 0
    ahead: int = 0


@dataclass(frozen=True)
class Running:
    """An aggregate over the rows from ``lo`` to ``hi``, counted from each row, of which one is None: no bound.

    ``agg`` is sum, count, min, max, first_known or last_known (of values that are not null).
    """

    agg: str
    c: Column
    lo: int | None
    hi: int | None

    @property
    def back(self) -> int:
        return max(0, -(self.hi if self.lo is None else self.lo))

    @property
    def ahead(self) -> int:
        return max(0, self.hi if self.lo is None else self.lo)


Request = Near | Running


def _plain(agg: str, c: Column) -> Column:
    return {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max, "first_known": lambda x: F.first(x, True), "last_known": lambda x: F.last(x, True)}[agg](c)


def _mirrored(agg: str) -> str:
    """The same aggregate of rows in the reversed order."""
    return {"first_known": "last_known", "last_known": "first_known"}.get(agg, agg)


def _partial(r: Running) -> Column:
    """The aggregate of a chunk's rows, as they come in no order."""
    known = F.when(r.c.isNotNull(), F.col(ROW))
    return {"first_known": lambda: F.min_by(r.c, known), "last_known": lambda: F.max_by(r.c, known)}.get(r.agg, lambda: _plain(r.agg, r.c))()


def _both(r: Running, carry: Column, own: Column) -> Column:
    if r.agg == "sum":
        return F.coalesce(carry + own, carry, own)
    if r.agg == "count":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(own, F.lit(0))
    if r.agg in ("min", "max"):
        return (F.least if r.agg == "min" else F.greatest)(carry, own)
    near_first = (r.agg == "first_known") == (r.lo is not None)  # the own chunk comes before what is carried
    return F.coalesce(own, carry) if near_first else F.coalesce(carry, own)


def evaluate(rows: DataFrame, total: int, wanted: dict[str, Request]) -> DataFrame:
    """Adds the columns wanted to numbered rows; ROW stays."""
    back, ahead = (max([getattr(r, side) for r in wanted.values()], default=0) for side in ("back", "ahead"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = max(-(-total // (CHUNKS_PER_TASK * tasks)), back, ahead, 1)
    chunk = lambda row: F.call_function("div", row, F.lit(size))
    row = F.col(ROW)
    if back or ahead:
        first, last = F.greatest(chunk(row - ahead), F.lit(0)), F.least(chunk(row + back), F.lit(max(total - 1, 0) // size))
        spread = rows.withColumn(CHUNK, F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    else:
        spread = rows.withColumn(CHUNK, chunk(row))
    w, to_end = Window.partitionBy(CHUNK).orderBy(ROW), Window.partitionBy(CHUNK).orderBy(F.col(ROW).desc())
    begin = F.col(CHUNK) * F.lit(size)
    end = begin + F.lit(size)
    made: dict[str, Column] = {}
    carried: dict[tuple[bool, int], dict[str, Running]] = {}
    for name, r in wanted.items():
        if isinstance(r, Near):
            made[name] = r.build(w)
        elif r.lo is None:  # all rows before the chunk, and so many fewer as the frame ends before the row, are carried
            made[name] = _plain(r.agg, F.when(row >= begin - r.back, r.c)).over(w.rowsBetween(Window.unboundedPreceding, r.hi))
            carried.setdefault((True, r.back), {})[name] = r
        else:  # from the end in the reversed order, as Spark makes a frame that runs to the end anew for each row
            made[name] = _plain(_mirrored(r.agg), F.when(row < end + r.ahead, r.c)).over(to_end.rowsBetween(Window.unboundedPreceding, -r.lo))
            carried.setdefault((False, r.ahead), {})[name] = r
    kept = [F.col(f"`{c}`") for c in rows.columns]
    out = spread.select(*kept, CHUNK, *[c.alias(n) for n, c in made.items()])
    if back or ahead:
        out = out.filter((row >= begin) & (row < end))
    for i, ((forward, shift), these) in enumerate(carried.items()):
        of = f"weftline__c{i}"
        at = chunk(row + shift) if forward else chunk(row - shift)
        sums = rows.groupBy(at.alias(of)).agg(*[_partial(r).alias(f"weftline__k_{n}") for n, r in these.items()])
        of_chunks = Window.orderBy(F.col(of) if forward else F.col(of).desc()).rangeBetween(Window.unboundedPreceding, -1)  # a row for each chunk
        carries = sums.select(of, *[_plain("sum" if r.agg == "count" else r.agg if forward else _mirrored(r.agg), F.col(f"weftline__k_{n}")).over(of_chunks).alias(f"weftline__k_{n}") for n, r in these.items()])
        out = out.join(F.broadcast(carries), F.col(CHUNK) == F.col(of), "left")
    final = {n: _both(r, F.col(f"weftline__k_{n}"), F.col(n)) if isinstance(r, Running) else F.col(n) for n, r in wanted.items()}
    return out.select(*kept, *[c.alias(n) for n, c in final.items()])


#: Aggregates of ``frame_aggregate``.
AGGREGATES = ("sum", "count", "min", "max", "avg", "stddev", "variance", "first", "last")


@dataclass(frozen=True)
class By:
    """A column to order by: ascending with nulls first, or descending with nulls last, unless ``nulls_last`` says otherwise."""

    c: Column
    descending: bool = False
    nulls_last: bool | None = None

    def directed(self, c: Column | None = None) -> Column:
        """The column, or another one in its place, with the direction."""
        c = self.c if c is None else c
        return {(False, False): c.asc_nulls_first, (False, True): c.asc_nulls_last, (True, False): c.desc_nulls_first, (True, True): c.desc_nulls_last}[self.descending, self.last]()

    @property
    def last(self) -> bool:
        """Whether nulls come last."""
        return self.descending if self.nulls_last is None else self.nulls_last

    def reversed(self) -> By:
        return By(self.c, not self.descending, not self.last)


class Frame:
    """Numbered rows to which aggregates over frames of rows are added, all in one pass.

    ``add`` takes what a column is made of; ``result`` gives the rows with the columns' values.
    """

    def __init__(self, df: DataFrame, order: Sequence[By]):
        self.columns, self.order = df.columns, list(order)
        self.keys = F.struct(*[F.col(f"weftline__o{i}") for i in range(len(self.order))])
        keyed = df.withColumns({f"weftline__o{i}": o.c for i, o in enumerate(self.order)}) if self.order else df
        self.rows, self.total = number(keyed, [o.directed(F.col(f"weftline__o{i}")) for i, o in enumerate(self.order)])
        self._wanted: dict[str, Request] = {}
        self._made: dict[str, Column] = {}
        self._peers: dict[str, bool] = {}
        self._marks = 0

    def want(self, r: Request) -> Column:
        name = f"weftline__w{len(self._wanted)}"
        self._wanted[name] = r
        return F.col(name)

    def add(self, alias: str, c: Column, peers: bool = False) -> None:
        """A column made of what was wanted; with ``peers``, the value of the last row that is alike in the order."""
        self._made[alias], self._peers[alias] = c, peers

    def aggregate(self, agg: str, c: Column, lo: int | None, hi: int | None) -> Column:
        """An aggregate over the rows from ``lo`` to ``hi`` of each row; None: no bound."""
        if lo is not None and hi is not None:
            plain = {"avg": F.avg, "stddev": F.stddev, "variance": F.variance, "first": F.first, "last": F.last}.get(agg)
            return self.want(Near(lambda w: (plain(c) if plain else _plain(agg, c)).over(w.rowsBetween(lo, hi)), max(0, -lo, -hi), max(0, lo, hi)))
        if lo is None and hi is None:
            return self._whole(agg, c)
        if agg in ("first", "last"):
            row = F.col(ROW)
            if (agg == "first") == (lo is None):  # the end of all rows that the frame does not leave
                some = row + F.lit(hi) >= 0 if lo is None else row + F.lit(lo) < self.total
                return F.when(some, self._whole(agg, c))
            n = lo if hi is None else hi
            near = self.want(Near(lambda w: F.lead(c, n).over(w) if n >= 0 else F.lag(c, -n).over(w), max(0, -n), max(0, n)))
            if n < 0 and hi is None or n > 0 and lo is None:  # a frame that would begin before all rows begins with the first
                return F.when(row + F.lit(n) < 0 if n < 0 else row + F.lit(n) >= self.total, self._whole(agg, c)).otherwise(near)
            return near
        part = lambda a, x: self.want(Running(a, x, lo, hi))
        if agg == "avg":
            return F.try_divide(part("sum", c).cast("double"), part("count", c))
        if agg in ("stddev", "variance"):  # about the mean of all rows, so that squares stay small
            d = c.cast("double") - F.lit(self.rows.agg(F.avg(c)).first()[0]).cast("double")
            n, s, q = part("count", d), part("sum", d), part("sum", d * d)
            v = F.when(n > 1, F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))
            return F.sqrt(v) if agg == "stddev" else v
        return part(agg, c)

    def distinct(self, c: Column, lo: int | None, hi: int | None) -> Column:
        """The number of distinct values, nulls not counted, over the rows from ``lo`` to ``hi`` of each row; at most one is None: no bound.

        Between two bounds each frame's values are held; from the start the first row of each value counts, to the end the last one.
        """
        if lo is not None and hi is not None:
            return self.want(Near(lambda w: F.size(F.collect_set(c).over(w.rowsBetween(lo, hi))).cast("bigint"), max(0, -lo, -hi), max(0, lo, hi)))
        mark, self._marks = f"weftline__f{self._marks}", self._marks + 1
        ends = self.rows.filter(c.isNotNull()).groupBy(c.alias("weftline__v")).agg((F.min if lo is None else F.max)(ROW).alias(mark))
        self.rows = self.rows.join(ends.select(mark), F.col(ROW) == F.col(mark), "left")
        return self.want(Running("count", F.col(mark), lo, hi))

    def _whole(self, agg: str, c: Column) -> Column:
        if agg in ("first", "last"):
            end = self.rows.filter(F.col(ROW) == (0 if agg == "first" else self.total - 1))
            return end.select(c).scalar()
        plain = {"avg": F.avg, "stddev": F.stddev, "variance": F.variance}.get(agg)
        return self.rows.agg(plain(c) if plain else _plain(agg, c)).scalar()

    def result(self, keep_row: bool = False) -> DataFrame:
        wanted, alike = dict(self._wanted), any(self._peers.values())
        if alike:
            wanted["weftline__last"] = Near(lambda w: ~self.keys.eqNullSafe(F.lead(self.keys).over(w)), 0, 1)
        gone = set(self._made)
        out = evaluate(self.rows, self.total, wanted) if wanted else self.rows
        own = [F.col(f"`{c}`") for c in self.columns if c not in gone]
        out = out.select(*own, ROW, *(["weftline__last"] if alike else []), *[c.alias(a) for a, c in self._made.items()])
        if alike:
            ends = [a for a, p in self._peers.items() if p]
            held = F.when(F.col("weftline__last"), F.struct(*[F.col(f"`{a}`").alias(f"v{i}") for i, a in enumerate(ends)]))
            out = evaluate(out, self.total, {"weftline__held": Running("first_known", held, 0, None)})
            out = out.withColumns({a: F.col("weftline__held")[f"v{i}"] for i, a in enumerate(ends)}).drop("weftline__held", "weftline__last")
        return out if keep_row else out.drop(ROW)


@dataclass(frozen=True)
class Deferred:
    """A column that needs the order of all rows: made by ``make`` of a Frame in that order, when an operator has the rows."""

    order: tuple[By, ...]
    make: Callable[[Frame], Column]
    peers: bool = False


@dataclass(frozen=True)
class Counted:
    """A column made of how many rows are alike in ``by``, nulls being alike."""

    by: tuple[Column, ...]
    make: Callable[[Column], Column]


def _counted(df: DataFrame, name: str, wanted: Counted) -> DataFrame:
    """The count of each value, made where the rows lie, joined back: no task sorts the rows of one value."""
    own, other = [f"weftline__q{i}" for i in range(len(wanted.by))], [f"weftline__r{i}" for i in range(len(wanted.by))]
    keyed = df.withColumns(dict(zip(own, wanted.by, strict=True)))
    counts = keyed.groupBy(*own).agg(F.count(F.lit(1)).alias("weftline__n")).select(*[F.col(a).alias(b) for a, b in zip(own, other, strict=True)], "weftline__n")
    alike = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own, other, strict=True)])
    return keyed.join(counts, alike, "left").withColumn(name, wanted.make(F.col("weftline__n"))).drop(*own, *other, "weftline__n")


def with_deferred(df: DataFrame, columns: dict[str, Column | Deferred | Counted]) -> DataFrame:
    """``df.withColumns``, where some columns need an order of all rows or counts; those of one order share a pass. Existing columns keep their place."""
    if all(isinstance(c, Column) for c in columns.values()):
        return df.withColumns(columns) if columns else df
    # all are made of the frame's own columns, so that replaced ones are only put in at the end
    names = {a: f"weftline__d{i}" for i, a in enumerate(columns)}
    out = df
    if plain := {names[a]: c for a, c in columns.items() if isinstance(c, Column)}:
        out = out.withColumns(plain)
    for a, c in columns.items():
        if isinstance(c, Counted):
            out = _counted(out, names[a], c)
    groups: list[tuple[tuple, dict[str, Deferred]]] = []
    for a, d in columns.items():
        if not isinstance(d, Deferred):
            continue
        key = tuple((str(o.c), o.descending, o.nulls_last) for o in d.order)
        for known, members in groups:
            if known == key:
                members[a] = d
                break
        else:
            groups.append((key, {a: d}))
    for _, members in groups:
        frame = Frame(out, next(iter(members.values())).order)
        for a, d in members.items():
            frame.add(names[a], d.make(frame), d.peers)
        out = frame.result()
    kept = [F.col(names[c]).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns]
    return out.select(*kept, *[F.col(names[a]).alias(a) for a in columns if a not in df.columns])


def fill(c: Column, forward: bool = True) -> Callable[[Frame], Column]:
    """The last value known up to a row, or the first from it on."""
    return lambda frame: frame.want(Running("last_known", c, None, 0) if forward else Running("first_known", c, 0, None))


def rank(c: Column, method: str) -> Callable[[Frame], Column]:
    """The rank of a row among those whose ``c`` is known, in a frame ordered by whether it is, then by the order wanted."""

    def make(frame: Frame) -> Column:
        row, keys = F.col(ROW), frame.keys
        if method == "ordinal":
            return F.when(c.isNotNull(), row + 1)
        begins = Near(lambda w: F.when(~keys.eqNullSafe(F.lag(keys).over(w)), row), 1, 0)
        ends = Near(lambda w: F.when(~keys.eqNullSafe(F.lead(keys).over(w)), row), 0, 1)
        return _ranked(frame, c, method, begins, ends)

    return make


def _ranked(frame: Frame, c: Column, method: str, begins: Near, ends: Near) -> Column:
    """Marks at the borders of peers first, as carries need columns that are there."""
    marks = {"weftline__b": begins, "weftline__e": ends}
    for name in marks:
        if name in frame.rows.columns:
            break
    else:
        frame.rows = evaluate(frame.rows, frame.total, marks)
    begin, end = F.col("weftline__b"), F.col("weftline__e")
    low = lambda: frame.want(Running("last_known", begin, None, 0)) + 1
    high = lambda: frame.want(Running("first_known", end, 0, None)) + 1
    of = {"min": low, "max": high, "average": lambda: (low() + high()) / 2, "dense": lambda: frame.want(Running("count", begin, None, 0))}
    return F.when(c.isNotNull(), of[method]())

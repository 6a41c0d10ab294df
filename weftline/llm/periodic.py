"""Periodic runs of words by probing harmonic grids.

A run of period p and three periods' length or more covers three places jp, (j+1)p and (j+2)p of the grid of p. So for
each p the words at neighbouring places of its grid are compared, which over all p costs n log n probes; survivors are
narrowed by comparing the words that follow them, all at once, and what is left is extended by chunks to both sides.
Places within a run that was found with a divisor of p cannot give another run, and are skipped.

The texts of a batch are probed together: longest first, as one array of word numbers with a number of its own between
two texts, which no run can cover. For each p the texts long enough for it are a prefix of the array.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.manifest import CRC_SQL, CRC_TABLE_SQL
from weftline.llm.staging import prepare_workers
from weftline.llm.textvec import NOT_SPACE, Words, chunks, release

#: A run has this many words at least, and this many periods.
SHORTEST, PERIODS = 24, 3
#: Words that follow a survivor are compared for all survivors at once up to this many.
TOGETHER = 16


def _reach(seq: np.ndarray, x: int, p: int) -> tuple[int, int]:
    """The stretch [a, b) around x of places that equal the place p further on."""
    b, n, size = x, len(seq) - p, 64
    while b < n:
        same = seq[b : min(b + size, n)] == seq[b + p : min(b + size, n) + p]
        if not same.all():
            b += int(same.argmin())
            break
        b, size = b + len(same), min(2 * size, 1 << 16)
    a, size = x, 64
    while a > 0:
        from_ = max(a - size, 0)
        same = (seq[from_:a] == seq[from_ + p : a + p])[::-1]
        if not same.all():
            a -= int(same.argmin())
            break
        a, size = from_, min(2 * size, 1 << 16)
    return a, b


def find_runs(seq: np.ndarray, reach: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of ``seq``.

    ``reach[p]``: the length of the prefix in which runs of period p are looked for; it does not grow with p. Runs over
    its end are found whole if they hold three places of the grid in it.
    """
    found: list[tuple[int, int, int]] = []
    known: set[tuple[int, int]] = set()
    cover = np.full(len(seq), -1, np.int32)  # the run found last that covers a place
    ends, periods = np.zeros(16, np.int64), np.ones(16, np.int64)
    for p in range(1, len(reach)):
        grid = seq[: reach[p] : p]
        if len(grid) < PERIODS:
            break
        same = grid[:-1] == grid[1:]
        x = np.flatnonzero(same[:-1] & same[1:]) * p
        if not len(x):
            continue
        run = cover[x]
        x = x[(run < 0) | (p % periods[run] != 0) | (x + p >= ends[run])]
        # behind the first place of its grid, a run equals itself p further on for so many places at least
        for t in range(1, min(max(SHORTEST - p, (PERIODS - 1) * p) - p, TOGETHER) + 1):
            if not len(x):
                break
            x = x[x + t + p < len(seq)]
            x = x[seq[x + t] == seq[x + t + p]]
        i = 0
        while i < len(x):
            a, b = _reach(seq, int(x[i]), p)
            if b - a + p >= max(SHORTEST, PERIODS * p) and (a, b + p) not in known:  # a stretch known already has a divisor of p as its period
                if len(found) == len(ends):
                    ends, periods = np.concatenate([ends, np.zeros_like(ends)]), np.concatenate([periods, np.ones_like(periods)])
                ends[len(found)], periods[len(found)] = b + p, p
                cover[a : b + p] = len(found)
                found.append((a, b + p, p))
                known.add((a, b + p))
            i += max(1, int(np.searchsorted(x[i:], b)))
    return found


def text_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Of a run of texts: the number of words, the runs by start and period, the words that are kept, joined by spaces."""
    words = Words(data, offs, NOT_SPACE, lower=False)
    size = words.end - words.start
    cut = np.concatenate([[0], np.cumsum(size)])
    array = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(cut.astype(np.int64)), pa.py_buffer(data[NOT_SPACE[data]]))
    number = array.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count, first = words.count, words.first
    order = np.argsort(-count, kind="stable")
    order = order[count[order] >= SHORTEST]
    n_runs, starts, lengths, periods = np.zeros(len(count), np.int64), [], [], []
    kept = np.ones(len(number), bool)
    if len(order):
        begins = np.concatenate([[0], np.cumsum(count[order] + 1)])
        seq = np.empty(begins[-1], np.int64)
        for k, d in enumerate(order):
            seq[begins[k] : begins[k + 1] - 1] = number[first[d] : first[d + 1]]
            seq[begins[k + 1] - 1] = -1 - k
        most = np.arange(count[order[0]] // PERIODS + 1)
        reach = begins[np.searchsorted(-count[order], -np.maximum(PERIODS * most, SHORTEST), "right")]
        runs = np.array(find_runs(seq, reach), np.int64).reshape(-1, 3)
        at = np.searchsorted(begins, runs[:, 0], "right") - 1
        doc, start, length, period = order[at], runs[:, 0] - begins[at], runs[:, 1] - runs[:, 0], runs[:, 2]
        by = np.lexsort((period, start, doc))
        doc, start, length, period = doc[by], start[by], length[by], period[by]
        for d, s, n, p in zip(doc, start, length, period, strict=True):
            kept[first[d] + s + p : first[d] + s + n] = False
        n_runs = np.bincount(doc, minlength=len(count))
        starts, lengths, periods = start, length, period
    spans = pa.StructArray.from_arrays([pa.array(np.asarray(v, np.int64)) for v in (starts, lengths, periods)], ["start", "length", "period"])
    runs_of = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_runs)]).astype(np.int32)), spans)
    before = np.concatenate([[0], np.cumsum(kept)])[first]
    left = pa.LargeListArray.from_arrays(pa.array(before.astype(np.int64)), array.filter(pa.array(kept)))
    return count, runs_of, pc.binary_join(left, pa.scalar(" ", pa.large_string()))


def _schema() -> pa.Schema:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    return pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", spans), ("collapsed", pa.string())])


RUNS = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def periodic_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``documents``: doc_id, n_words, runs, collapsed.

    Words are what white space of ASCII separates, as they stand. A run is a stretch with smallest period p, of 24 words and
    three periods or more, that neither neighbour extends; ``runs`` has the place of its first word, its length and its period, by
    start, then period. ``collapsed`` is the text without what any run repeats, that is all of it but its first period,
    the words joined by one space. Null and empty texts have no words and collapse to an empty text; repeated rows and
    null ids are rows of their own; an empty table gives an empty result. Texts are read whole; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema()
        for batch in batches:
            at = 0
            for data, offs in chunks(batch.column(1), 1 << 23):
                ids = batch.column(0).slice(at, len(offs) - 1)
                at += len(offs) - 1
                n, runs, text = text_runs(data, offs)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), runs.cast(schema.field("runs").type), text.cast(pa.string())], schema=schema)
            release()

    prepare_workers(documents.sparkSession)
    return documents.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, RUNS)


def planted(doc_id: Column, text: Column) -> Column:
    """``text``, where one doc_id in ten, by its crc32, gets a periodic end: from word a on, word i is that at a + (i - a) % p."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("bigint")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("bigint")
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x)), " ")

    return F.when((h % 10 == 0) & F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.element_at(F.transform(F.array(words), repeated), 1)).otherwise(text)


def summary(found: DataFrame) -> DataFrame:
    """The digests of ``periodic_runs``: of its runs and its text, and the run of the greatest exponent."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    runs = F.col("runs")

    def better(a: Column, b: Column) -> Column:  # runs come by start, then period: the first of equal ones stays
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate(runs, none, better)
    milli = F.col("best")["length"] * 1000
    out = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return out.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        *[F.col("best")[c].alias(c) for c in ("start", "length", "period")],
        ((milli - milli % F.col("best")["period"]) / F.col("best")["period"]).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def runs_sql() -> str:
    """``summary`` of table ``documents``, planted, in DuckDB: by all pairs of equal words, in place of the grids."""
    return rf"""
    WITH c AS (
        {CRC_TABLE_SQL}
    ), o AS (
        SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {CRC_SQL} AS h FROM documents, c
    ), g AS (
        SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a FROM o
    ), s AS (
        SELECT *, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM g
    ), d AS (
        SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN w[1:a] || flatten(list_transform(range((n - a) // p + 1), lambda i: w[a + 1:a + p]))[1:n - a] ELSE w END AS w FROM s
    ), x AS (
        SELECT row, n, unnest(range(n)) AS i, unnest(w) AS word FROM d
    ), e AS (
        SELECT u.row, u.i, v.i - u.i AS p FROM x u JOIN x v USING (row, word) WHERE v.i > u.i AND {PERIODS} * (v.i - u.i) <= u.n
    ), m AS (
        SELECT row, p FROM e GROUP BY ALL HAVING count(*) >= greatest({SHORTEST} - p, {PERIODS - 1} * p)
    ), k AS (
        SELECT row, p, min(i) AS start, count(*) + p AS length
        FROM (SELECT row, p, i, i - row_number() OVER (PARTITION BY row, p ORDER BY i) AS island FROM e SEMI JOIN m USING (row, p)) GROUP BY row, p, island
    ), r AS (
        SELECT row, start, length, min(p) AS period FROM k WHERE length >= greatest({SHORTEST}, {PERIODS} * p) GROUP BY ALL
    ), f AS (
        SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
               first({{'start': start, 'length': length, 'period': period}} ORDER BY length / period DESC, start, period) AS best
        FROM r GROUP BY row
    ), y AS (
        SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM r
    ), z AS (
        SELECT row, string_agg(word, ' ' ORDER BY i) AS collapsed FROM x ANTI JOIN y USING (row, i) GROUP BY row
    )
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, best.length * 1000 // best.period AS exponent_milli,
           sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
    FROM d LEFT JOIN f USING (row) LEFT JOIN z USING (row)
    """

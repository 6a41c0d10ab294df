"""Benchmark decontamination by suffix arrays of the training text.

Documents that follow each other in a task, up to SHARD_BYTES of text, are a shard. All its suffixes of words are sorted by
prefix doubling: by one word, then two, four and so on, each round ordering pairs of ranks of the round before. The test
items are read once, as numbers of their own vocabulary. Each test suffix is searched by binary search in every round:
its word among the shard's words, its pairs among the shard's pairs and so on; a suffix that is not found leaves. With
the last round, whose length p is the largest power of two in a window of k words, the suffixes of the shard that begin with its p words are one
range of the array, and those whose last p words of k agree too are its occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.staging import prepare_workers, scoped, stage
from weftline.llm.textvec import ALNUM, Words, chunks, release

WINDOW = 10
#: Bytes of text of a shard; a longer document is in a shard with those before it. Sorting holds some twenty bytes for each of them.
SHARD_BYTES = 2 << 20
#: Bytes of test text that a pass over the documents searches, so that what the driver and a task hold is bounded; about twice that is held.
PART_BYTES = 16 << 20
#: Pairs that are expanded at once.
BLOCK = 1 << 21

HITS = "n_words bigint, n_hit bigint, hit array<int>, items array<string>, longest bigint, longest_at bigint"
HITS_TYPE = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_at", pa.int64())]
)


@dataclass
class TestSet:
    """Items as runs of word numbers."""

    __test__ = False

    names: list[str | None]
    vocabulary: np.ndarray  # sorted hashes
    words: np.ndarray  # place in the vocabulary plus 1 of the words of all items, each item followed by 0
    first: np.ndarray  # where each item begins, and the end
    suffix: np.ndarray  # where each searched suffix begins
    need: np.ndarray  # how many of its words must match: the window, or the whole of a shorter item

    def item(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, "right") - 1


def test_set(names: list[str | None], items: list[bytes], window: int = WINDOW) -> TestSet:
    """``items`` are the hashes of each item's words, as bytes. Items without words have no window. Equal items all count."""
    sizes = np.array([len(b) // 8 + 1 for b in items], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    vocabulary, code = np.unique(np.frombuffer(b"".join(items), np.uint64), return_inverse=True)
    words = np.zeros(first[-1], np.int32)
    inside = np.ones(first[-1], bool)
    inside[first[1:] - 1] = False
    words[inside] = code + 1
    n = sizes - 1
    need = np.minimum(n, window)
    count = np.where(n > 0, n - need + 1, 0)
    suffix = np.repeat(first[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return TestSet(names, vocabulary, words, first, suffix.astype(np.int32), np.repeat(need, count).astype(np.int16))


def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The hashes of a text's words, as bytes."""
    for texts in batches:
        out = []
        for data, offs in chunks(texts):
            w = Words(data, offs, ALNUM)
            out += [w.hash[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        yield pa.array(out, pa.binary())
        release()


def _ahead(x: np.ndarray, step: int) -> np.ndarray:
    """x, ``step`` places on; 0 beyond the end."""
    return np.concatenate([x[step:], np.zeros(min(step, len(x)), x.dtype)])


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from each low to below its high."""
    n = high - low
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class Shard:
    """The sorted suffixes of some texts. ``hash``: of all words; ``count``: words of each text."""

    def __init__(self, hash: np.ndarray, count: np.ndarray):
        self.count = count
        self.start = np.concatenate([[0], np.cumsum(count + 1)])[:-1]  # a text's first word; one 0 follows each text, so that no match crosses texts
        self.length = 1
        self._sort(hash, (np.repeat(self.start - (np.cumsum(count) - count), count) + np.arange(len(hash))).astype(np.int32))

    def _sort(self, key: np.ndarray, at: np.ndarray) -> None:
        """The array of the suffixes that begin at ``at``, in the order of their keys; ``rank`` is from 1, and 0 for other places."""
        order = np.argsort(key).astype(np.int32)
        key, self.array = key[order], at[order]
        del order
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.keys, self.head = key[new], np.append(np.flatnonzero(new), len(key)).astype(np.int32)
        del key
        self.rank = np.zeros(int(self.count.sum()) + len(self.count), np.int32)
        self.rank[self.array] = np.cumsum(new, dtype=np.int32)

    def double(self) -> None:
        """Sorts by twice as many words; suffixes that a text ends within leave."""
        second = _ahead(self.rank, self.length)
        live = np.flatnonzero((self.rank > 0) & (second > 0)).astype(np.int32)
        self._sort(self.pair(self.rank[live], second[live]), live)
        self.length *= 2

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.int64) << 32) | b

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each key by binary search, or 0."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, at + 1, 0).astype(np.int32) if len(self.keys) else np.zeros(len(keys), np.int32)

    def occurrences(self, tests: TestSet) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each number of words that must match: it, the places of this shard where a window stands, the window's number, and the windows' numbers and places in the test set."""
        at, need = tests.suffix, tests.need
        found = np.concatenate([np.zeros(1, np.int32), self.find(tests.vocabulary)])[tests.words]
        while True:
            lengths = [int(k) for k in np.unique(need) if self.length <= k < 2 * self.length]
            for k in lengths:
                own = at[need == k]
                last = k - self.length
                own = own[(found[own] > 0) & (found[own + last] > 0)]
                windows, number = np.unique(self.pair(found[own], found[own + last]), return_inverse=True)
                ranks = np.unique(windows >> 32)
                places = self.array[_ranges(self.head[ranks - 1], self.head[ranks])]
                key = self.pair(self.rank[places], _ahead(self.rank, last)[places])
                w = np.minimum(np.searchsorted(windows, key), max(0, len(windows) - 1))
                same = windows[w] == key if len(windows) else np.zeros(0, bool)
                yield k, places[same], w[same], number, own
            live = np.flatnonzero((found > 0) & (_ahead(found, self.length) > 0))
            if not len(live) or 2 * self.length > need.max(initial=0):
                return
            key = self.pair(found[live], found[live + self.length])
            self.double()
            found = np.zeros(len(found), np.int32)
            found[live] = self.find(key)


def _blocks(size: np.ndarray) -> Iterator[slice]:
    """Runs whose sizes are BLOCK together, or one that is larger."""
    ends = np.cumsum(size)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK, "right")))
        yield slice(i, j)
        i = j


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique((a.astype(np.int64) << 32) | b)
    return pairs >> 32, pairs & 0xFFFFFFFF


def search(shard: Shard, tests: TestSet, longest: bool = True) -> list[tuple]:
    """(n_words, hit places, item numbers, longest match in words, where it begins) of each text, in order; the last two are 0 and None without ``longest``."""
    n = len(shard.count)
    cover = np.zeros(int(shard.count.sum()) + n + 1, np.int32)
    owner, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    best = np.zeros(n, np.int64)
    best_at = np.zeros(n, np.int64)
    for k, places, window, number, at in shard.occurrences(tests):
        if not len(places):
            continue
        cover[places] += 1  # each place once
        cover[places + k] -= 1
        text = np.searchsorted(shard.start, places, "right") - 1
        t, w = _distinct(text, window)
        of, item = _distinct(number, tests.item(at))
        low, high = np.searchsorted(of, w), np.searchsorted(of, w, "right")
        for b in _blocks(high - low):
            a, c = _distinct(np.repeat(t[b], (high - low)[b]), item[_ranges(low[b], high[b])])
            owner.append(a)
            items.append(c)
        if not longest:
            continue
        # a match of more words than the window is a run of windows that advance by a word on either side
        order = np.argsort(places)
        places, window = places[order], window[order]
        order = np.argsort(number, kind="stable")
        of, at = number[order], at[order]
        low, high = np.searchsorted(of, window), np.searchsorted(of, window, "right")
        text = np.searchsorted(shard.start, places, "right") - 1
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(text)) + 1])
        for b in _blocks(np.add.reduceat(high - low, cuts)):
            begin, end = cuts[b.start], cuts[b.stop] if b.stop < len(cuts) else len(places)
            size = (high - low)[begin:end]
            here = np.repeat(places[begin:end], size)
            away = here - at[_ranges(low[begin:end], high[begin:end])]
            order = np.lexsort((here, away))
            here, away = here[order], away[order]
            new = np.ones(len(here), bool)
            new[1:] = (away[1:] != away[:-1]) | (here[1:] != here[:-1] + 1)
            begins = np.flatnonzero(new)
            length = np.diff(np.append(begins, len(here))) + k - 1
            d = np.searchsorted(shard.start, here[begins], "right") - 1
            order = np.lexsort((here[begins], -length, d))
            d, length, where = d[order], length[order], here[begins][order]
            top = np.ones(len(d), bool)
            top[1:] = d[1:] != d[:-1]
            d, length, where = d[top], length[top], where[top] - shard.start[d[top]]
            more = (length > best[d]) | ((length == best[d]) & (where < best_at[d]))
            best[d[more]], best_at[d[more]] = length[more], where[more]
    hit = np.flatnonzero(np.cumsum(cover) > 0)
    text = np.searchsorted(shard.start, hit, "right") - 1
    cuts = np.searchsorted(text, np.arange(n + 1))
    of, item = _distinct(np.concatenate(owner), np.concatenate(items))
    ends = np.searchsorted(of, np.arange(n + 1))
    return [
        (int(shard.count[i]), (hit[cuts[i] : cuts[i + 1]] - shard.start[i]).astype(np.int32), item[ends[i] : ends[i + 1]], int(best[i]), int(best_at[i]) if best[i] else None)
        for i in range(n)
    ]


def _shards(batches: Iterator[pa.Array]) -> Iterator[tuple[list[int], Shard]]:
    """The texts that follow each other, as shards, with the number of rows of each batch."""
    rows, size, hashed, counts = [], 0, [], []
    for texts in batches:
        rows.append(len(texts))
        for data, offs in chunks(texts):
            w = Words(data, offs, ALNUM)
            hashed.append(w.hash)
            counts.append(w.count)
            size += len(data)
        if size >= SHARD_BYTES:
            yield rows, Shard(np.concatenate(hashed), np.concatenate(counts))
            rows, size, hashed, counts = [], 0, [], []
    if rows:
        yield rows, Shard(np.concatenate([np.zeros(0, np.uint64), *hashed]), np.concatenate([np.zeros(0, np.int64), *counts]))


def searcher(spark: SparkSession, tests: TestSet, longest: bool = True) -> tuple[Callable[[Column], Column], Broadcast]:
    """The search as a column function, and the test set that travels once per executor."""
    prepare_workers(spark)
    shared = spark.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for rows, shard in _shards(batches):
            found = search(shard, known, longest)
            for n in rows:
                own, found = found[:n], found[n:]
                yield pa.array(
                    [
                        {"n_words": words, "n_hit": len(hit), "hit": hit, "items": sorted({known.names[i] for i in items}, key=lambda x: (x is None, x or "")), "longest": most, "longest_at": at}
                        for words, hit, items, most, at in own
                    ],
                    HITS_TYPE,
                )
            release()

    return F.arrow_udf(run, HITS), shared


def parts(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", unnamed: bool = False, window: int = WINDOW) -> tuple[int, Callable[[int], TestSet]]:
    """How many parts of about PART_BYTES of text the test set has, and a function that reads one. Repeated items count once. ``unnamed`` has the items with a null id too."""
    prepare_workers(benchmark.sparkSession)
    rows = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("name"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = (rows if unnamed else rows.filter(F.col("name").isNotNull())).distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // PART_BYTES

    def read(k: int) -> TestSet:
        own = rows.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n)) == k).select("name", F.arrow_udf(hashes, "binary")("text").alias("words"))
        found = sorted(((r["name"], bytes(r["words"])) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or "", x[1]))
        return test_set([name for name, _ in found], [words for _, words in found], window)

    return n, read


def _passes(rows: DataFrame, benchmark: DataFrame, add: Callable[[DataFrame, Callable, int], DataFrame], longest: bool, unnamed: bool) -> tuple[DataFrame, int]:
    """``rows`` after a pass of ``add`` for each part, and the number of parts. All passes but the last are staged, and their parts let go."""
    n, read = parts(benchmark, unnamed=unnamed)
    for k in range(n):
        find, shared = searcher(rows.sparkSession, read(k), longest)
        rows = add(rows, find, k)
        if k + 1 < n:
            rows = stage(rows, "searched")
            shared.destroy()
    return rows, n


@scoped
def contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", unnamed: bool = False) -> DataFrame:
    """Finds the test passages in each document.

    Adds one column ``matches`` (n_words, n_hit, hit: the word places inside matches, items: the item ids with an
    occurring window, longest: words of the longest verbatim match, longest_at: where it begins) to all columns of
    ``documents``; a column of that name is replaced. Null and empty texts have no words and no matches. Items with the
    same id count as one. Items with a null id are left out unless ``unnamed`` is set; then they are searched like the others and
    count as one null in items. Rows are kept whole and in number, repeated ones too; an empty table
    or an empty benchmark gives no matches. The result is the same in however many parts the test set is read.
    """
    name = lambda k: f"weftline__matches{k}"
    rows, n = _passes(documents.drop("matches"), benchmark, lambda rows, find, k: rows.withColumn(name(k), find(F.col(f"`{text_col}`"))), True, unnamed)
    m = F.array(*[F.col(name(k)) for k in range(n)])
    longest = F.array_max(F.transform(m, lambda x: F.struct(x["longest"], (-x["longest_at"]).alias("at"))))
    hit = F.array_sort(F.array_distinct(F.flatten(F.transform(m, lambda x: x["hit"]))))
    merged = F.struct(
        F.col(name(0))["n_words"].alias("n_words"),
        F.size(hit).cast("bigint").alias("n_hit"),
        hit.alias("hit"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(m, lambda x: x["items"])))).alias("items"),
        longest["longest"].alias("longest"),
        (-longest["at"]).alias("longest_at"),
    )
    return rows.withColumn("matches", merged).drop(*[name(k) for k in range(n)])


@scoped
def decontaminate(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents without a match, of items with a null id too, with their own columns."""
    return _passes(documents, benchmark, lambda rows, find, k: rows.filter(find(F.col(f"`{text_col}`"))["n_hit"] == 0), False, True)[0]


def items_digest(items: Column) -> Column:
    """Hex sha256 of the ids, sorted as strings and comma-joined, without a null."""
    return F.sha2(F.array_join(F.array_sort(items), ",").cast("binary"), 256)

"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes, with the counts of what followed. The code length of a
text is the sum over its bytes of what the longest known context needs, paying an escape for each shorter context it
falls back to (method C: a context seen n times with q different followers gives an escape q of n + q shares). The
statistics are frozen: nothing is learned from the text that is scored. The language with the shortest code wins.

As the code length of a byte depends on it and the three bytes before alone, the lengths of all four-byte sequences seen in
training are tabled once; others are computed from the trees. Lengths are whole numbers of 1/65536 bit, so that sums
are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.staging import prepare_workers
from weftline.llm.textvec import chunks, release

ORDER = 3
#: Documents per language that training takes on average, chosen by a hash of doc_id: the bound of the sample.
DOCS_PER_LANGUAGE = 300
UNIT = 65536
UNKNOWN = "und"


def sequences(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Each byte with the three before it as one number; before a text's first byte stand zeros."""
    n = len(data)
    b = np.zeros(n + ORDER, np.uint32)
    b[ORDER:] = data
    place = np.full(n, ORDER, np.int8)
    starts = offs[:-1][offs[:-1] < offs[1:]]
    for j in range(ORDER):
        at = starts + j
        ends = np.minimum(at, n - 1)
        place[ends[at < n]] = np.minimum(place[ends[at < n]], j)
    # a text shorter than ORDER must not lend its places to the next one
    place[starts] = 0
    out = b[ORDER:].copy()
    for j in range(1, ORDER + 1):
        out |= np.where(place >= j, b[ORDER - j : n + ORDER - j] << np.uint32(8 * j), np.uint32(0))
    return out


class Trees:
    """The context tree of one language."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels = []
        for order in range(ORDER + 1):
            grams = keys.astype(np.int64) & ((1 << 8 * (order + 1)) - 1)
            gram, code = np.unique(grams, return_inverse=True)
            n = np.bincount(code, counts, len(gram))
            context, code = np.unique(gram >> 8, return_inverse=True)
            self.levels.append((gram, n, context, np.bincount(code, n, len(context)), np.bincount(code, None, len(context)).astype(float)))

    def lengths(self, keys: np.ndarray) -> np.ndarray:
        """Bits of each sequence's last byte after the others."""
        bits = np.full(len(keys), 8.0)
        for order, (gram, n, context, total, kinds) in enumerate(self.levels):
            own = keys.astype(np.int64) & ((1 << 8 * (order + 1)) - 1)
            if not len(gram):
                continue
            at = np.minimum(np.searchsorted(gram, own), len(gram) - 1)
            c = np.minimum(np.searchsorted(context, own >> 8), len(context) - 1)
            known, seen = gram[at] == own, context[c] == own >> 8
            bits = np.where(known, np.log2((total[c] + kinds[c]) / n[at]), bits + np.where(seen, np.log2((total[c] + kinds[c]) / kinds[c]), 0.0))
        return bits


class Model:
    """The frozen trees of all languages and the table of known sequences."""

    def __init__(self, languages: list[str], trees: list[Trees], keys: np.ndarray):
        self.languages, self.trees = languages, trees
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint32(32 - size.bit_length() + 1)
        self.slot = np.full(size, -1, np.int32)
        todo, at = np.arange(len(keys)), self._home(keys)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]
            left = self.slot[at] != todo
            todo, at = todo[left], (at[left] + 1) & (size - 1)
        self.keys = np.append(keys, np.uint32(0))
        self.units = [self._units(t, keys) for t in trees]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> self.shift).astype(np.int64)

    @staticmethod
    def _units(tree: Trees, keys: np.ndarray) -> np.ndarray:
        return np.round(tree.lengths(keys) * UNIT).astype(np.int32)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The table row of each sequence, or -1."""
        at = self._home(keys)
        out = self.slot[at]
        open_ = np.flatnonzero((self.keys[out] != keys) & (out >= 0))
        at = at[open_]
        while len(open_):
            at = (at + 1) & (len(self.slot) - 1)
            out[open_] = got = self.slot[at]
            more = (self.keys[got] != keys[open_]) & (got >= 0)
            open_, at = open_[more], at[more]
        return out

    def lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length in units, by text and language."""
        keys = sequences(data, offs)
        rows = self.rows(keys)
        new = np.flatnonzero(rows < 0)
        others, place = np.unique(keys[new], return_inverse=True)
        out = np.zeros((len(offs) - 1, len(self.languages)), np.int64)
        sums = np.zeros(len(keys) + 1, np.int64)
        for i, tree in enumerate(self.trees):
            each = self.units[i][rows] if len(self.units[i]) else np.zeros(len(keys), np.int32)
            if len(new):
                each[new] = self._units(tree, others)[place]
            np.cumsum(each, out=sums[1:])
            out[:, i] = sums[offs[1:]] - sums[offs[:-1]]
        return out


COUNTS = "lang string, seq bigint, n bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The four-byte sequences of a task's texts by language."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            held = batch.column(1).filter(pa.array(langs == lang))
            keys, n = np.unique(np.concatenate([sequences(d, o) for d, o in chunks(held)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], ["lang", "seq", "n"])


def train(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Trees from (doc_id, text, lang); rows with a null lang or text are left out.

    A language's documents take part where a hash of doc_id falls below the share that gives ``docs_per_language`` on
    average; whole texts count. What reaches the driver is bounded by the sample.
    """
    prepare_workers(labelled.sparkSession)
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    totals = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("total"))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * F.col("total") < F.lit(docs_per_language << 20)
    sample = rows.join(F.broadcast(totals), "lang").filter(chosen).select("lang", F.lower("text").alias("text"))
    counts = sample.mapInArrow(_count, COUNTS).groupBy("lang", "seq").agg(F.sum("n").alias("n")).toPandas()
    names, trees = sorted(counts["lang"].unique()), []
    for name in names:
        own = counts[counts["lang"] == name].sort_values("seq")
        trees.append(Trees(own["seq"].to_numpy(np.uint32), own["n"].to_numpy(float)))
    return Model(names, trees, np.unique(counts["seq"].to_numpy(np.uint32)))


RESULT = "lang_pred string, score double"
RESULT_TYPE = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def predict(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    """The language of each text, and how sure: the share of 2 to the power of minus the code lengths, taken over 32 bytes. Equal lengths: the first by name."""
    pred, scores = [], []
    for data, offs in chunks(texts):
        bits = model.lengths(data, offs) / UNIT
        n = np.diff(offs)
        gap = (bits - bits.min(axis=1, keepdims=True)) * (np.minimum(n, 32) / np.maximum(n, 1))[:, None]
        scores.append(1 / np.exp2(-gap).sum(axis=1))
        pred += [model.languages[i] for i in bits.argmin(axis=1)]
    return pred, np.concatenate(scores) if scores else np.zeros(0)


def identifier(model: Model, text: Column) -> Column:
    """lang_pred and score of a text. ``und`` with score 0: null, no letter, or nothing was learned."""
    from pyspark.sql import SparkSession

    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if not model.languages:
        return none
    shared = SparkSession.active().sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            pred, scores = predict(texts, shared.value)
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(scores)], fields=list(RESULT_TYPE))
            release()

    scored = F.arrow_udf(run, RESULT)(F.lower(text))
    return F.when(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), scored).otherwise(none)


def is_training(doc_id: Column) -> Column:
    """Documents whose labels may be learned: crc32 of the id as text, modulo 5, is not 0; never a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document.

    Learned from the rows of ``documents`` that ``is_training`` admits. Null texts and texts without a letter are
    ``und``. Repeated rows are scored alike. An empty table gives an empty result. Columns besides doc_id, text and lang
    are not read.
    """
    rows = documents.select("doc_id", "text", "lang")
    model = train(rows.filter(is_training(F.col("doc_id"))))
    best = identifier(model, F.col("text"))
    out = rows.select("doc_id", (~is_training(F.col("doc_id"))).alias("held_out"), best.alias("best"))
    return out.select("doc_id", "held_out", "best.lang_pred", "best.score")


def known_language(documents: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents with a language and a score of ``least`` or more, with their own columns."""
    rows = documents.select("doc_id", "text", "lang")
    model = train(rows.filter(is_training(F.col("doc_id"))))
    best = identifier(model, F.col("text"))
    return documents.filter((best["lang_pred"] != UNKNOWN) & (best["score"] >= least))

"""Toxicity by compression distance.

A window is one word between spaces. Two zstandard dictionaries are trained: the ordinary one on the texts of ordinary
documents, the toxic one on the windows that set toxic documents apart, followed by the ordinary content, so that
ordinary syllables cost the same with either. Each window of a text is compressed with both. Two lengths matter: how many
bytes the toxic dictionary saves, and how many bytes are left with it. Windows that save at least s bytes and leave at most t
have the log-odds that a toxic and an ordinary document hold such a window; these thresholds are calibrated on
documents that the dictionaries have not seen. A document's three largest log-odds, and how many more of its windows are
above limits than in ordinary text of its length, go through a logistic calibration.

Both dictionaries end in a fixed carrier that is appended to every window, because the compressor looks for no match in
the last bytes of its input and stores small inputs raw.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.labels import is_training, logistic, sample, sigmoid
from weftline.llm.staging import prepare_workers, scoped, stage
from weftline.llm.textvec import NOT_SPACE, Words, chunks, release

#: The bounds of the sample: documents of a class on average, and bytes of text in all; where there are more bytes, documents are thinned by a hash.
PER_CLASS, SAMPLE_BYTES = 4000, 32 << 20
#: Parts of the sample; each is seen through dictionaries of the others.
FOLDS = 3
#: A window sets toxic documents apart by this much evidence (twice the log-likelihood ratio) and this many times more often.
EVIDENCE, CONTRAST = 12.0, 20.0
#: Bytes of the ordinary dictionary, most of the toxic one before it, and most of a window that is learned.
ORDINARY, TOXIC, LEARNED = 12288, 32768, 256
#: Greedy search over chains: every byte of a dictionary is indexed; faster ones skip bytes, so that content would shift distances.
PARAMETERS = {"window_log": 17, "hash_log": 15, "chain_log": 16, "search_log": 6, "min_match": 4, "target_length": 64, "strategy": zstandard.STRATEGY_GREEDY}
CARRIER = b"\x01carrier:0123456789abcdefghijklmnopqrstuvwxyz:ABCDEFGHIJKLMNOPQRSTUVWXYZ:\x02"
#: Saved bytes from 0 to SAVED, and left bytes from 0 to LEFT, are told apart; more count as the last.
SAVED, LEFT = 24, 31
CELLS = (SAVED + 1) * (LEFT + 1)
#: Windows above so much log-odds are counted.
CLEAR = (1.0, 2.5)
#: Ridge of the calibration.
RIDGE = 0.3
#: Windows whose cells a worker remembers.
REMEMBERED = 1 << 18
CUTOFF = 0.7


def compressor(content: bytes) -> Callable[[bytes], int]:
    """Length of a window, compressed with the dictionary."""
    raw = content + CARRIER
    params = zstandard.ZstdCompressionParameters(**PARAMETERS, write_content_size=0, write_checksum=0, write_dict_id=0)
    held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    compress = zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress
    return lambda window: len(compress(window + CARRIER))


def ordinary_dictionary(texts: list[bytes]) -> bytes | None:
    """What the trainer takes from whole texts; smaller where it refuses, None where it refuses 1 kB."""
    cleaned = [b" " + b" ".join(t.split()) + b" " for t in texts]
    size = ORDINARY
    while size >= 1024:
        try:
            return zstandard.train_dictionary(size, cleaned, k=64, d=8, split_point=1.0).as_bytes()[-size:]
        except zstandard.ZstdError:
            size //= 2
    return None


def toxic_dictionary(found: dict[bytes, float], ordinary: bytes) -> bytes:
    """What the trainer takes from the windows, the windows that it leaves out before it, the ordinary content after it.

    Beyond the size of the dictionary the windows with least evidence are not learned.
    """
    strongest = sorted(found, key=lambda w: (-found[w], w))
    room = np.cumsum([len(w) + 4 for w in strongest]) <= TOXIC // 2
    windows = sorted(w for w, fits in zip(strongest, room, strict=True) if fits)
    samples = [b" " + w + b" \x00\x00" for w in windows]  # the trainer counts no sequence in the last two bytes
    try:
        trained = zstandard.train_dictionary(max(512, 2 * sum(map(len, samples))), samples, k=32, d=6, split_point=1.0).as_bytes()
    except zstandard.ZstdError:  # too few windows for the trainer
        trained = b""
    missing = [b" " + w + b" " for w in sorted(windows, key=lambda w: (found[w], w)) if b" " + w + b" " not in trained]
    return b"".join(missing) + b"\x00" + trained + b"\x00" + ordinary


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    log_odds: np.ndarray = field(default_factory=lambda: np.zeros(CELLS))
    usual: np.ndarray = field(default_factory=lambda: np.zeros(len(CLEAR)))
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros(9))

    def cells(self) -> Callable[[list[bytes]], np.ndarray]:
        """The cell of each window: the bytes that the toxic dictionary saves, and those left with it beyond an empty window's."""
        plain, toxic = compressor(self.ordinary), compressor(self.toxic)
        empty = plain(b" ")

        def of(windows: list[bytes]) -> np.ndarray:
            left = np.array([toxic(w) for w in windows], np.int64)
            saved = np.array([plain(w) for w in windows], np.int64) - left
            return np.clip(saved, 0, SAVED) * (LEFT + 1) + np.clip(left - empty, 0, LEFT)

        return of

    def histograms(self) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, cell, number of windows) of a run of texts; a window met before is not compressed again."""
        of = self.cells()
        known, cell = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def run(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            nonlocal known, cell
            w = Words(data, offs, NOT_SPACE, lower=False)
            key, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
            if len(known) > REMEMBERED:
                known, cell = known[:0], cell[:0]
            new = ~np.isin(key, known, assume_unique=True)
            raw = data.tobytes()
            found = of([b" " + raw[w.start[i] : w.end[i]] + b" " for i in at[new]])
            known, cell = np.concatenate([known, key[new]]), np.concatenate([cell, found])
            order = np.argsort(known)
            known, cell = known[order], cell[order]
            code, count = np.unique(w.doc() * CELLS + cell[np.searchsorted(known, key)][back], return_counts=True)
            return code // CELLS, code % CELLS, count

        return run

    def probability(self, text: np.ndarray, cell: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        return sigmoid(features(self.log_odds, self.usual, text, cell, count, n) @ self.coefficients[:-1] + self.coefficients[-1])


def features(log_odds: np.ndarray, usual: np.ndarray, text: np.ndarray, cell: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Of each of n texts: the three largest log-odds of its windows, at least 0; for each limit of CLEAR the logarithm of the number above it, and how
    many standard deviations, from -3 to 8, that is above the usual share; the logarithm of all."""
    odds = log_odds[cell]
    total = np.bincount(text, count, n)
    columns = []
    for limit, share in zip(CLEAR, usual, strict=True):
        clear = np.bincount(text, count * (odds > limit), n)
        columns += [np.log1p(clear), np.clip((clear - share * total) / np.sqrt(share * total + 1), -3, 8)]
    top = np.zeros((n, 3))
    t, o = np.repeat(text, np.minimum(count, 3)), np.repeat(odds, np.minimum(count, 3))
    order = np.lexsort((-o, t))
    t, o = t[order], o[order]
    rank = np.arange(len(t)) - np.searchsorted(t, t)
    first = rank < 3
    top[t[first], rank[first]] = np.maximum(0, o[first])
    return np.column_stack([top, *columns, np.log1p(total)])


def log_odds(text: np.ndarray, cell: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of each cell: the log-odds that a toxic and an ordinary document hold a window that saves as much or more and leaves as little or less."""
    n = np.array([(y == 0).sum(), (y == 1).sum()], float)
    held = np.zeros((2, SAVED + 1, LEFT + 1))
    cuts = np.searchsorted(text, np.arange(len(y) + 1))
    for i, label in enumerate(y):
        has = np.zeros(CELLS, bool)
        has[cell[cuts[i] : cuts[i + 1]]] = True
        has = has.reshape(SAVED + 1, LEFT + 1)
        held[label] += np.logical_or.accumulate(np.logical_or.accumulate(has[::-1], axis=0)[::-1], axis=1)
    rate = (held + (n / n.sum())[:, None, None]) / n[:, None, None]  # a cell that nobody holds says nothing
    return (np.log(rate[1]) - np.log(rate[0])).ravel()


def evidence(toxic: Column, ordinary: Column, n_toxic: int, n_ordinary: int) -> Column:
    """Twice the log-likelihood ratio of a window that so many documents of each class hold; null unless it is contrasted."""
    both = (toxic + ordinary).cast("double")
    part = lambda k, n: F.when(k > 0, k * F.log(k * F.lit(n_toxic + n_ordinary) / (both * n))).otherwise(0.0)
    g = 2 * (part(toxic, n_toxic) + part(ordinary, n_ordinary))
    return F.when((toxic / F.lit(n_toxic) > F.lit(CONTRAST) * (ordinary + 1) / F.lit(n_ordinary)) & (g > EVIDENCE), g)


def contrasted(rows: DataFrame) -> list[dict[bytes, float]] | None:
    """The windows that set toxic documents of (text, y, fold) apart, with their evidence: without each fold, and of all. None where a class is missing from any."""
    sizes = {(r["fold"], r["y"]): r["n"] for r in rows.groupBy("fold", "y").agg(F.count(F.lit(1)).alias("n")).collect()}
    without = [[j for j in range(FOLDS) if j != k] for k in range(FOLDS)] + [list(range(FOLDS))]
    n = [[sum(sizes.get((j, y), 0) for j in folds) for y in (0, 1)] for folds in without]
    if not all(all(x) for x in n):
        return None
    words = rows.select("fold", "y", F.explode(F.array_distinct(F.split("text", r"[ \t\n\x0B\f\r]+"))).alias("word"))
    words = words.filter((F.col("word") != "") & (F.octet_length("word") <= LEARNED))
    of = {(j, y): F.count_if((F.col("fold") == j) & (F.col("y") == y)).alias(f"n{j}_{y}") for j in range(FOLDS) for y in (0, 1)}
    held = words.groupBy("word").agg(*of.values()).filter(" + ".join(f"n{j}_1" for j in range(FOLDS)) + " > 1")
    total = lambda folds, y: sum((F.col(f"n{j}_{y}") for j in folds), F.lit(0))
    found = held.select("word", *[evidence(total(f, 1), total(f, 0), n[i][1], n[i][0]).alias(f"g{i}") for i, f in enumerate(without)])
    found = found.filter(" OR ".join(f"g{i} IS NOT NULL" for i in range(FOLDS + 1))).collect()
    return [{r["word"].encode(): round(r[f"g{i}"], 6) for r in found if r[f"g{i}"] is not None} for i in range(FOLDS + 1)]


@scoped
def train(documents: DataFrame, labels: DataFrame) -> Model | None:
    """Dictionaries from the whole sample; log-odds and calibration from each fold seen through dictionaries of the others.

    None unless all folds together, and without any one, have both classes and text enough for the trainer. Equal texts count once.
    """
    prepare_workers(documents.sparkSession)
    rows = sample(documents, labels, "toxic", PER_CLASS).withColumn("text", F.lower("text"))
    one = rows.groupBy(F.xxhash64("text").alias("key")).agg(F.min(F.struct("doc_id", "text", "y", "weight")).alias("r"))
    rows = stage(one.select("key", F.pmod("key", F.lit(FOLDS)).alias("fold"), "r.*"), "toxic-sample")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    share = min(1.0, SAMPLE_BYTES / max(1, size))
    rows = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30))))
    found = contrasted(rows)
    if found is None:
        return None
    texts = sorted((r["fold"], bytes(r["text"])) for r in rows.filter("y = 0").select("fold", F.col("text").cast("binary").alias("text")).collect())
    models = []
    for k in range(FOLDS + 1):
        ordinary = ordinary_dictionary([t for fold, t in texts if fold != k])
        if ordinary is None:
            return None
        models.append(Model(toxic_dictionary(found[k], ordinary), ordinary))
    seen = [rows.filter(F.col("fold") == k).select("doc_id", "y", "weight", _scored(models[k], "histogram")("text").alias("x")) for k in range(FOLDS)]
    seen = sorted(seen[0].unionByName(seen[1]).unionByName(seen[2]).collect(), key=lambda r: (r["doc_id"], r["y"], r["x"]))
    y, weight = np.array([r["y"] for r in seen]), np.array([r["weight"] for r in seen], float)
    pairs = [np.array(r["x"], np.int64).reshape(-1, 2) for r in seen]
    text = np.repeat(np.arange(len(seen)), [len(p) for p in pairs])
    cell, count = np.concatenate(pairs).T
    model = models[FOLDS]
    model.log_odds = log_odds(text, cell, y)
    plain = y[text] == 0
    model.usual = np.array([np.sum(count[plain] * (model.log_odds[cell[plain]] > limit)) for limit in CLEAR]) / max(1, count[plain].sum())
    model.coefficients = logistic(features(model.log_odds, model.usual, text, cell, count, len(seen)), y, weight, RIDGE)
    return model


def _scored(model: Model, what: str):
    """The histogram (cell, number, cell, number ...) or the probability of a text, as a column function."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = model.histograms()
        for texts in batches:
            out = []
            for data, offs in chunks(texts, 1 << 20):
                n = len(offs) - 1
                text, cell, count = of(data, offs)
                if what == "histogram":
                    cuts = np.searchsorted(text, np.arange(n + 1)).astype(np.int32) * 2
                    out.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.column_stack([cell, count]).ravel().astype(np.int32))))
                else:
                    out.append(pa.array(model.probability(text, cell, count, n)))
            yield pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()) if what == "histogram" else pa.float64())
            release()

    return F.arrow_udf(run, "array<int>" if what == "histogram" else "double")


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``documents`` (doc_id, text).

    Whole texts are scored, lower case. Null and empty texts have no window and get the score of a text of which no window
    saves anything. Repeated rows are scored alike; of repeated labels of an id the largest counts. Where no model can be trained
    (no labels of both classes, or too little text) every score is 0. An empty table gives an empty
    result. Other columns are not read. ``labels`` has doc_id and toxic.
    """
    model = train(documents, labels)
    probability = _scored(model, "score")(F.lower(F.coalesce("text", F.lit("")))) if model else F.lit(0.0)
    out = documents.select("doc_id", (~is_training(F.col("doc_id"))).alias("held_out"), probability.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))

"""Quality by random-indexing word vectors and a small network.

Every token has a fixed sparse random index vector; a token's word vector is the sum of the index vectors of its
neighbours over the whole corpus. A document is the pooled vectors of its tokens, which a network of two layers in numpy
turns into a probability, calibrated by a temperature.

Tokens are words and runs of punctuation; marks tell words in capitals and repetition. Token types are hashed to
a fixed number of rows, so that the table of word vectors has the same size for any corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.labels import is_training, sample, sigmoid
from weftline.llm.staging import prepare_workers
from weftline.llm.textvec import NOT_SPACE, Words, chunks, flags, release

#: Labelled documents per class that training takes on average: the bound of the sample.
PER_CLASS = 6000
ROWS, DIMENSIONS, NONZERO = 1 << 15, 24, 2
#: Neighbours on each side.
REACH = 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 0.01, 1e-4
SEED = 5

#: Bytes of letters and digits; the others but white space make runs of punctuation.
WORDLIKE = flags((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_KIND = np.where(WORDLIKE, 1, np.where(NOT_SPACE, 2, 0)).astype(np.uint8)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Rows of the marks, before those of hashed tokens.
CAPITALS, REPEATED = 0, 1
MARKS = 8


def index_vectors() -> np.ndarray:
    """Ternary vectors with NONZERO entries of either sign."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((ROWS, DIMENSIONS), np.int32)
    for sign in (1, -1):
        at = rng.integers(0, DIMENSIONS, (ROWS, NONZERO))
        np.add.at(out, (np.arange(ROWS)[:, None], at), sign)
    return out


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, document, word mark) of each token of a run of texts; word mark: 1 for words in capitals, 2 for a word that repeats the one before."""
    kind = _KIND[data]
    n = len(data)
    begins = kind > 0
    begins[1:] &= kind[1:] != kind[:-1]
    starts = offs[:-1][offs[:-1] < n]
    begins[starts] = kind[starts] > 0
    start = np.flatnonzero(begins)
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z
    # a run ends where the next begins or where white space does
    edge = np.append(begins[1:] | (kind[1:] == 0), True)
    edge[offs[1:][offs[1:] > 0] - 1] = True
    end = np.flatnonzero(edge & (kind > 0)) + 1
    w = Words.__new__(Words)
    w.bytes, w.start, w.end, w._hash = data | (_UPPER[data].astype(np.uint8) << 5), start, end, None
    w.count = np.zeros(0)
    row = (w.hash % np.uint64(ROWS - MARKS)).astype(np.int64) + MARKS
    doc = np.searchsorted(offs, start, "right") - 1
    ups = np.concatenate([[0], np.cumsum(_UPPER[data])])
    capitals = (ups[end] - ups[start] == end - start) & (end - start > 1)
    again = np.zeros(len(row), bool)
    again[1:] = (row[1:] == row[:-1]) & (doc[1:] == doc[:-1])
    return row, doc, capitals.astype(np.int64) + 2 * again


def add_contexts(table: np.ndarray, index: np.ndarray, row: np.ndarray, doc: np.ndarray, mark: np.ndarray) -> None:
    """Adds to each token's row the index vectors of its neighbours, and of its marks."""
    n = len(row)
    near = np.zeros((n, DIMENSIONS), np.int32)
    for step in range(1, REACH + 1):
        if n <= step:
            break
        same = (doc[:-step] == doc[step:])[:, None]
        near[:-step] += index[row[step:]] * same
        near[step:] += index[row[:-step]] * same
    near += index[CAPITALS] * (mark & 1)[:, None]
    near += index[REPEATED] * (mark >> 1)[:, None]
    order = np.argsort(row, kind="stable")
    cut = np.flatnonzero(np.diff(row[order], prepend=-1))
    table[row[order][cut]] += np.add.reduceat(near[order], cut, axis=0, dtype=np.int64)


def pool(vectors: np.ndarray, row: np.ndarray, doc: np.ndarray, mark: np.ndarray, n_docs: int) -> np.ndarray:
    """For each document the mean and the spread of its tokens' vectors, the length of the mean, the shares of marks and the log of the number of tokens."""
    count = np.bincount(doc, minlength=n_docs).astype(np.float64)
    size = np.maximum(count, 1)[:, None]
    cut = np.searchsorted(doc, np.arange(n_docs))
    has = np.flatnonzero(count)
    mean, square = np.zeros((n_docs, DIMENSIONS)), np.zeros((n_docs, DIMENSIONS))
    if len(has):
        v = vectors[row]
        mean[has] = np.add.reduceat(v, cut[has], axis=0, dtype=np.float64)
        square[has] = np.add.reduceat(v * v, cut[has], axis=0, dtype=np.float64)
    mean, square = mean / size, square / size
    spread = np.sqrt(np.maximum(square - mean**2, 0))
    marks = np.column_stack([np.bincount(doc, (mark & 1), n_docs), np.bincount(doc, mark >> 1, n_docs)]) / size
    # how the tokens' rows repeat: the share of distinct ones
    pair = np.unique(doc * ROWS + row) // ROWS
    distinct = np.bincount(pair, minlength=n_docs)[:, None] / size
    return np.column_stack([mean, spread, np.linalg.norm(mean, axis=1), marks, distinct, np.log1p(count)])


FEATURES = 2 * DIMENSIONS + 5


def _vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, DIMENSIONS)


def word_vectors(documents: DataFrame) -> np.ndarray:
    """The vectors of all rows, learned from every text of the corpus and scaled to length 1.

    A task adds up a table of fixed size and gives its rows that are not zero; the sums by row, as many as the table has, reach the driver.
    Sums are whole numbers, so that neither the order of tasks nor a task that runs again changes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, table = index_vectors(), np.zeros((ROWS, DIMENSIONS), np.int64)
        for batch in batches:
            for data, offs in chunks(batch.column(0)):
                row, doc, mark = tokens(data, offs)
                if len(row):
                    add_contexts(table, index, row, doc, mark)
            release()
        used = np.flatnonzero(table.any(axis=1))
        for part in np.array_split(used, max(1, len(used) // 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([v.tobytes() for v in table[part]], pa.binary())], ["row", "v"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((ROWS, DIMENSIONS), np.int64)
        for batch in batches:
            np.add.at(table, batch.column(0).to_numpy(), _vectors(batch.column(1)))
        used = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([v.tobytes() for v in table[used]], pa.binary())], ["row", "v"])

    parts = documents.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "row bigint, v binary")
    rows = parts.repartition("row").mapInArrow(total, "row bigint, v binary").toArrow()
    out = np.zeros((ROWS, DIMENSIONS), np.float32)
    if rows.num_rows:
        out[rows.column(0).to_numpy()] = _vectors(rows.column(1))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


@dataclass
class Network:
    """Two layers and what scales their input; the temperature divides the output."""

    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.center) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Network:
    """Trains on four fifths with Adam, and sets the temperature on the rest. Weights undo the thinning of classes."""
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(x))
    held, use = order[: len(x) // 5], order[len(x) // 5 :]
    weight = weight / weight.mean()
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - center) / scale, -8, 8)
    p = {"w1": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "b2": np.zeros(1)}
    m, v, t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        mixed = rng.permutation(use)
        for i in range(0, len(mixed), BATCH):
            k = mixed[i : i + BATCH]
            h = np.tanh(z[k] @ p["w1"] + p["b1"])
            e = weight[k] * (sigmoid(h @ p["w2"] + p["b2"]) - y[k]) / len(k)
            back = np.outer(e, p["w2"]) * (1 - h * h)
            grad = {"w1": z[k].T @ back + DECAY * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ e + DECAY * p["w2"], "b2": np.array([e.sum()])}
            t += 1
            for name, g in grad.items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                p[name] = p[name] - rate * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
    net = Network(center, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]))
    out = net.logits(x[held])

    def loss(temperature: float) -> float:
        q = np.clip(sigmoid(out / temperature), 1e-9, 1 - 1e-9)
        return float(-(weight[held] * (y[held] * np.log(q) + (1 - y[held]) * np.log(1 - q))).sum())

    if len(held):
        net.temperature = float(min(np.exp(np.linspace(np.log(0.25), np.log(8), 61)), key=loss))
    return net


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None


def _pooled(shared, what: str):
    """The pooled vector, or the score, of a text, as a column function."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            parts = [pool(model.vectors, *tokens(data, offs), len(offs) - 1) for data, offs in chunks(texts)]
            x = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
            yield pa.array(list(x), pa.list_(pa.float64())) if what == "vector" else pa.array(model.network(x))
            release()

    return F.arrow_udf(run, "array<double>" if what == "vector" else "double")


def train(documents: DataFrame, labels: DataFrame) -> Model:
    """Word vectors from all texts, the network from the bounded sample; no network unless both classes are there."""
    prepare_workers(documents.sparkSession)
    context = documents.sparkSession.sparkContext
    model = Model(word_vectors(documents), None)
    rows = sample(documents, labels, "quality", PER_CLASS)
    x = rows.select("doc_id", "y", "weight", _pooled(context.broadcast(model), "vector")("text").alias("x")).toPandas().sort_values("doc_id")
    y = x["y"].to_numpy(float)
    if len(x) and 0 < y.sum() < len(y):
        model.network = fit(np.stack(x["x"].to_numpy()), y, x["weight"].to_numpy(float))
    return model


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``documents`` (doc_id, text).

    Whole texts are scored. Null and empty texts have no token and get the score of the zero vector. Repeated rows are
    scored alike. Without labels of both classes every score is 0. An empty table gives an empty result. Other columns are
    not read. ``labels`` has doc_id and quality.
    """
    rows = documents.select("doc_id", "text")
    model = train(rows, labels)
    if model.network:
        probability = _pooled(rows.sparkSession.sparkContext.broadcast(model), "score")(F.coalesce("text", F.lit("")))
    else:
        probability = F.lit(0.0)
    out = rows.select("doc_id", (~is_training(F.col("doc_id"))).alias("held_out"), probability.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""Mixing sources to target weights by iterative proportional fitting.

Topics are learned from the corpus: the topic words are those in most documents of all that are in no more than a
twentieth of them, and a document's topic is the one of them that it holds most often. Token counts by (source,
language, topic) are raked until their margins are the targets; a document is then kept with its cell's probability, decided by a hash of its id.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.staging import discard, prepare_workers, scoped, stage
from weftline.llm.textvec import ALNUM, NOT_SPACE, Words, chunks, release

#: Up to so many cells are raked on the driver and broadcast; more are raked and joined as tables, with the same result.
MAX_CELLS = 200_000
#: Rounds of raking, and what margins may miss their targets by without a warning.
ROUNDS, RESIDUAL = 60, 1e-6
#: Exponents of the token shares that give the target shares: 0 makes all equal, 1 leaves them.
ALPHA = {"source": 0.5, "lang": 0.7, "topic": 0.7}
DIMENSIONS = tuple(ALPHA)
#: Part of the corpus's tokens that the sample has on average.
SAMPLE_SHARE = 0.8
#: Topic words; the least part of the documents that they may not exceed is one in RARER; their least and most bytes.
TOPICS, RARER, SHORTEST, LONGEST = 16, 20, 3, 40
NONE = "(none)"


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, documents of this run that hold it); words are alphanumeric, A-Z lowered."""
    for batch in batches:
        for data, offs in chunks(batch.column(0), 1 << 20):
            w = Words(data, offs, ALNUM)
            fits = np.flatnonzero((w.end - w.start >= SHORTEST) & (w.end - w.start <= LONGEST))
            key, doc = w.hash[fits], w.doc()[fits]
            order = np.argsort(key)
            key = key[order]
            word = np.ones(len(key), bool)
            word[1:] = key[1:] != key[:-1]
            number = np.cumsum(word) - 1
            pairs = np.sort(number * (len(offs) - 1) + doc[order])  # each word's documents
            new = np.ones(len(pairs), bool)
            new[1:] = pairs[1:] != pairs[:-1]
            first = fits[order[word]]
            held = np.bincount(pairs[new] // max(1, len(offs) - 1), minlength=len(first))
            at, size = w.start[first], (w.end - w.start)[first]
            ends = np.concatenate([[0], np.cumsum(size)])
            raw = w.bytes[np.repeat(at - ends[:-1], size) + np.arange(ends[-1])]
            texts = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
            yield pa.RecordBatch.from_arrays([texts, pa.array(held.astype(np.int64))], ["word", "n"])
        release()


def topic_words(documents: DataFrame) -> list[str]:
    """The topic words of the whole table, sorted; ties in the number of documents go to the word that sorts first. There are TOPICS at most."""
    prepare_workers(documents.sparkSession)
    total = documents.count()
    counts = documents.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_document_counts, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") * RARER <= total).orderBy(F.desc("n"), "word").limit(TOPICS)
    return sorted(r["word"] for r in top.collect())


def topic_and_tokens(text: Column, topics: list[str]) -> Column:
    """(topic, tokens): the topic word that stands most often in a text, the first by name of several; words between white space of ASCII. Null is empty."""
    data = [t.encode() for t in topics]
    w = Words(np.frombuffer(b" ".join(data), np.uint8), np.array([0, len(b" ".join(data))]), ALNUM)
    key = w.hash if data else np.zeros(0, np.uint64)
    order = np.argsort(key)
    names = np.array([*topics, NONE], object)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            topic, tokens = [np.zeros(0, object)], [np.zeros(0, np.int64)]
            for data, offs in chunks(texts):
                n = len(offs) - 1
                tokens.append(Words(data, offs, NOT_SPACE).count)
                best = np.full(n, len(topics))
                if len(key):
                    w = Words(data, offs, ALNUM)
                    at = np.minimum(np.searchsorted(key[order], w.hash), len(key) - 1)
                    hit = np.flatnonzero(key[order][at] == w.hash)
                    counts = np.bincount(w.doc()[hit] * len(key) + order[at[hit]], minlength=n * len(key)).reshape(n, len(key))
                    best = np.where(counts.any(axis=1), counts.argmax(axis=1), best)
                topic.append(names[best])
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(topic), pa.string()), pa.array(np.concatenate(tokens).astype(np.int64))], ["topic", "tokens"])
            release()

    return F.arrow_udf(run, "topic string, tokens bigint")(F.coalesce(text, F.lit("")))


def described(documents: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and tokens; null source and lang become one value of their own."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c)
    rows = documents.select("doc_id", name("source"), name("lang"), topic_and_tokens(F.col("text"), topic_words(documents)).alias("t"))
    return rows.select("doc_id", "source", "lang", "t.topic", "t.tokens")


def _warn(residual: float) -> None:
    if residual > RESIDUAL:
        warnings.warn(f"raking leaves margins up to {residual:.2g} from their targets after {ROUNDS} rounds: the cells cannot meet them, or only slowly", stacklevel=3)


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]]) -> np.ndarray:
    """The weights of the cells, 1 together, after raking. Warns where margins are still off; then the last margin raked is met."""
    w = cells["tokens"].to_numpy(float)
    w = w / w.sum() if w.sum() else w
    margins = []
    for d in DIMENSIONS:
        code, values = pd.factorize(cells[d])
        margins.append((code, np.array([targets[d].get(v, 0.0) for v in values])))
    for _ in range(ROUNDS):
        for code, want in margins:
            have = np.bincount(code, w, len(want))
            w = w * np.divide(want, have, out=np.zeros(len(want)), where=have > 0)[code]
    _warn(max([float(np.abs(np.bincount(code, w, len(want)) - want).max(initial=0)) for code, want in margins], default=0.0) if w.any() else 0.0)
    return w


def smoothed(cells: pd.DataFrame, alpha: dict[str, float] = ALPHA) -> dict[str, dict[str, float]]:
    """Target shares: the token shares to the power alpha, 1 together."""
    out = {}
    for d, a in alpha.items():
        share = cells.groupby(d)["tokens"].sum()
        share = share[share > 0].astype(float) ** a
        out[d] = {v: 0.0 for v in cells[d].unique()} | (share / share.sum()).to_dict()
    return out


def scale(ratio: np.ndarray, tokens: np.ndarray, budget: float) -> float:
    """c for which min(1, c * ratio) keeps ``budget`` tokens on average; infinite where all must stay.

    Cells that c would keep more than whole are full; c is what the others need for the rest, until no more become full.
    """
    c, full = 0.0, np.zeros(len(ratio), bool)
    while True:
        rest = float((ratio * tokens)[~full].sum())
        if rest <= 0:
            return float("inf")
        c = (budget - float(tokens[full].sum())) / rest
        more = c * ratio > 1
        if (more <= full).all():
            return c
        full |= more


def _probabilities(cells: pd.DataFrame, targets: dict[str, dict[str, float]] | None, share: float) -> pd.DataFrame:
    cells = cells.sort_values(list(DIMENSIONS)).reset_index(drop=True)
    tokens = cells["tokens"].to_numpy(float)
    total = tokens.sum()
    w = rake(cells, targets or smoothed(cells))
    ratio = np.divide(w * total, tokens, out=np.zeros(len(w)), where=tokens > 0)
    c = scale(ratio, tokens, share * total)
    p = np.where(tokens > 0, np.minimum(1.0, np.where(ratio > 0, c * ratio, 0.0)) if np.isfinite(c) else 1.0, 1.0)
    return cells[list(DIMENSIONS)].assign(weight=ratio, probability=p)


@scoped
def _probabilities_as_tables(cells: DataFrame, targets: dict[str, dict[str, float]] | None, share: float) -> DataFrame:
    """The same for any number of cells, as joins and sums."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    w = cells.withColumn("w", F.col("tokens") / F.lit(float(total or 1)))
    wanted = {}
    for d, a in ALPHA.items():
        if targets:
            wanted[d] = spark.createDataFrame([(v, float(x)) for v, x in targets[d].items()], f"{d} string, want double")
        else:
            m = cells.groupBy(d).agg(F.sum("tokens").alias("m")).filter("m > 0").select(d, F.pow(F.col("m").cast("double"), F.lit(a)).alias("want"))
            wanted[d] = stage(m.withColumn("want", F.col("want") / (m.agg(F.sum("want")).first()[0] or 1.0)), "targets", narrow=True)
    margin = lambda d: w.groupBy(d).agg(F.sum("w").alias("have")).join(wanted[d], d, "left").select(d, "have", F.coalesce("want", F.lit(0.0)).alias("want"))
    before = None
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            factor = margin(d).select(d, F.when(F.col("have") > 0, F.col("want") / F.col("have")).otherwise(0.0).alias("f"))
            w = w.join(factor, d).withColumn("w", F.col("w") * F.col("f")).drop("f")
        w = stage(w, "raked", narrow=True)
        if before is not None:
            discard(before)
        before = w
    _warn(max((margin(d).agg(F.max(F.abs(F.col("have") - F.col("want")))).first()[0] or 0.0) for d in DIMENSIONS) if total else 0.0)
    w = w.withColumn("weight", F.when(F.col("tokens") > 0, F.col("w") * F.lit(float(total)) / F.col("tokens")).otherwise(0.0))
    c, known = 0.0, -1
    while True:  # as in scale
        full = F.lit(c) * F.col("weight") > 1
        r = w.agg(F.count_if(full), F.sum(F.when(full, F.col("tokens"))), F.sum(F.when(~full, F.col("weight") * F.col("tokens")))).first()
        if r[0] == known:
            break
        known = r[0]
        if not r[2]:
            c = float("inf")
            break
        c = (share * total - (r[1] or 0)) / r[2]
    p = F.lit(1.0) if c == float("inf") else F.least(F.lit(1.0), F.lit(c) * F.col("weight"))
    return w.select(*DIMENSIONS, "weight", F.when(F.col("tokens") > 0, p).otherwise(1.0).alias("probability"))


def _rated(cells: DataFrame, targets: dict[str, dict[str, float]] | None, share: float, max_cells: int) -> DataFrame:
    """Weight and probability of each staged cell."""
    if cells.count() > max_cells:
        return _probabilities_as_tables(cells, targets, share)
    schema = "source string, lang string, topic string, weight double, probability double"
    return F.broadcast(cells.sparkSession.createDataFrame(_probabilities(cells.toPandas(), targets, share).to_dict("records"), schema))


def uniform(doc_id: Column) -> Column:
    """A number from 0 to below 1, fixed by the id: 13 hex digits of its md5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


@scoped
def mix(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SAMPLE_SHARE, max_cells: int = MAX_CELLS) -> DataFrame:
    """Adds weight, probability and kept to ``rows`` (doc_id, source, lang, topic, tokens); columns of these names are replaced.

    weight: the raked share of a cell over its share of tokens. probability: min(1, c * weight), c such that the sample
    has ``share`` of all tokens on average. kept: the hash of doc_id is below it, so repeated rows share their fate.
    ``targets`` give shares, 1 together, by value of each dimension, and default to smoothed token shares; a value without one gets none.
    Margins that no weights can meet are warned of. Rows of cells without tokens have weight 0 and stay. An empty table
    gives an empty result.
    """
    rows = rows.drop("weight", "probability", "kept")
    cells = stage(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells", narrow=True)
    out = rows.join(_rated(cells, targets, share, max_cells), list(DIMENSIONS), "inner")
    return out.withColumn("kept", uniform(F.col("doc_id")) < F.col("probability"))


@scoped
def sample(documents: DataFrame, share: float = SAMPLE_SHARE, targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """The documents that the mix keeps, with their own columns; ids decide, so the texts are not shuffled where cells are few."""
    mine = "weftline__mix"
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    keyed = documents.withColumn(mine, topic_and_tokens(F.col("text"), topic_words(documents)))
    keyed = keyed.withColumn(mine, F.struct(name("source").alias("source"), name("lang").alias("lang"), F.col(mine)["topic"].alias("topic"), F.col(mine)["tokens"].alias("tokens")))
    cells = stage(keyed.select(f"{mine}.*").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells", narrow=True)
    rated = _rated(cells, targets, share, MAX_CELLS).select(*[F.col(d).alias(f"{mine}_{d}") for d in DIMENSIONS], F.col("probability").alias(f"{mine}_p"))
    same = [F.col(mine)[d] == F.col(f"{mine}_{d}") for d in DIMENSIONS]
    out = keyed.join(rated, same, "inner").filter(uniform(F.col("doc_id")) < F.col(f"{mine}_p"))
    return out.select([F.col(f"`{c}`") for c in documents.columns])

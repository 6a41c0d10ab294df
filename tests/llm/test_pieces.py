import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

ODD = [
    "", " ", "  ", "a", " a", "a ", "  a  b  ", "a\n\n b\t", "▁", "a▁b", "a ▁ b", "▁▁a", "a▁▁", "　a\xa0b", "ｆｕｌｌ ｗｉｄｔｈ", "é é", "\x00 a\x00", "<s> a</s> <unk> <0x41>",
    "🙂 🙂🙂", "x" * 5000, "ab" * 3000 + " c", " " * 3000, "one two one two", "▀ ▂ ⊁", "​﻿",
]


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def test_chunks_alone_and_together(model, library):
    raw = [t.encode() for t in ODD]
    chunks, first = pieces.split(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    ids, sizes = pieces.segment(chunks.to_pylist(), model)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for text, a, b in zip(ODD, first[:-1], first[1:], strict=True):
        assert ids[ends[a] : ends[b]].tolist() == library.encode(text), text


def test_packing():
    for x in ([], [0], [1, 2, 1 << 31, 70_000]):
        assert pieces.unpack(pieces.pack(np.array(x, np.uint32))).tolist() == x
    assert pieces.gather(np.arange(10), np.array([7, 0, 3]), np.array([2, 0, 3])).tolist() == [7, 8, 3, 4, 5]


def rows_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, list(r.ids), r.text) for r in df.collect())


@pytest.mark.parametrize(("unit", "buckets"), [(1 << 25, None), (5000, 3), (1, 1)])
def test_equals_the_library(spark, docs, model, library, unit, buckets):
    given = [(i, t) for i, t in enumerate(ODD)] + [(None, "a b"), (3, "a"), (3, "a"), (100, None)]
    rows = spark.createDataFrame(given, "doc_id bigint, text string").unionByName(docs.select("doc_id", "text")).withColumns({c: F.lit("x") for c in ("ids", "unit", "batch", "bucket", "words", "size")})
    got = rows_of(pieces.decode(pieces.encode(rows.repartition(3), model, True, buckets, unit), model))
    want = []
    for r in rows.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_eos=True)
        want.append((r.doc_id is None, r.doc_id or 0, ids, library.decode(ids)))
    assert got == sorted(want)


def test_without_end_and_empty(spark, none, model, library):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: list(r.ids) for r in pieces.encode(df, model, end=False).collect()}
    assert got == {1: library.encode("a b"), 2: [], 3: []}
    assert pieces.decode(pieces.encode(none, model), model).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(nulls, model).collect()} == {1: None, 2: ""}


def test_units_are_not_moved(spark, docs, model):
    plan = pieces.encode(docs, model)._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    assert any("Bucketed: true" in x for x in scans) and "hashpartitioning(bucket" in plan


def test_a_model_whose_pieces_cross_is_refused(model, monkeypatch):
    class Crossing:
        def get_piece_size(self):
            return 2

        def id_to_piece(self, i):
            return ["▁a", "a▁b"][i]

        def encode(self, x, **_):
            return [[0]] * len(x) if isinstance(x, list) else [0]

    monkeypatch.setattr(pieces, "processor", lambda _: Crossing())
    with pytest.raises(ValueError, match="cross"):
        pieces.check(model)

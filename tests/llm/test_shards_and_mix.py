import collections

import pytest
from pyspark.sql import functions as F

from weftline.llm import mixing, sharding


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 41, 1000])
def test_permutation(n):
    places = [sharding.place_of(i, n, 5) for i in range(n)]
    assert sorted(places) == list(range(n))
    assert all(sharding.row_of(p, n, 5) == i for i, p in enumerate(places))


def test_shards(spark, docs, none):
    out = sharding.shard(docs, [F.col("doc_id")], 7, seed=2)
    rows = out.collect()
    assert set(out.columns) == {*docs.columns, "slot"} and len(rows) == docs.count()
    count = collections.Counter(r.shard for r in rows)
    assert max(count.values()) - min(count.values()) <= 1
    for s in count:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    ids = sorted(r.doc_id for r in rows)
    want = {}
    for i, d in enumerate(ids):
        p = sharding.place_of(i, len(ids), 2)
        want.setdefault(d, set()).add((p % 7, p // 7))
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add((r.shard, r.slot))
    assert got == want
    again = sharding.shard(docs.repartition(5), [F.col("doc_id")], 7, seed=2).select("doc_id", "shard", "slot").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.shard, r.slot) for r in rows)
    empty = sharding.shard(none, [F.col("doc_id")], 7)
    assert empty.count() == 0 and {"shard", "slot"} <= set(empty.columns)


def test_copies_of_one_row_spread(spark):
    df = spark.range(5000).select(F.lit(1).alias("doc_id"), F.lit("t").alias("text")).repartition(4)
    parts = sharding.numbered(df, [F.col("doc_id")])
    assert sorted(r.weftline__row for r in parts.collect()) == list(range(5000))


def test_mix(docs, none, monkeypatch):
    rows = mixing.described(docs)
    got = mixing.mix(rows).collect()
    assert len(got) == docs.count() and all(0 <= r.probability <= 1 for r in got)
    total = sum(r.tokens for r in got)
    assert sum(r.tokens * r.probability for r in got) == pytest.approx(mixing.SAMPLE_SHARE * total, rel=1e-6)
    tables = mixing.mix(rows, max_cells=0).collect()
    key = lambda r: (r.doc_id, r.source, r.lang, r.topic)
    a, b = ({key(r): (r.weight, r.probability) for r in x} for x in (got, tables))
    assert set(a) == set(b) and all(a[k] == pytest.approx(b[k], rel=1e-12, abs=1e-14) for k in a)
    monkeypatch.setattr(mixing, "ROUNDS", 6)
    for share in (0.0, 0.3, 1.0):  # given targets, and shares at the ends, are the same either way too
        targets = {d: dict.fromkeys({r[d] for r in got}, 0.0) for d in mixing.DIMENSIONS}
        targets = {d: {v: (i + 1) * 2 / len(t) / (len(t) + 1) for i, v in enumerate(sorted(t))} for d, t in targets.items()}
        with pytest.warns(UserWarning, match="margins"):
            a, b = ({key(r): (r.weight, r.probability, r.kept) for r in mixing.mix(rows, targets, share, most).collect()} for most in (mixing.MAX_CELLS, 0))
        assert set(a) == set(b) and all(a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-12) for k in a)
    monkeypatch.undo()
    assert mixing.mix(mixing.described(none)).count() == 0
    kept = mixing.sample(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert mixing.sample(none).count() == 0


def test_raking_meets_its_margins():
    import pandas as pd

    cells = pd.DataFrame([(s, g, t, 10 + 3 * i + j) for i, s in enumerate("ab") for j, g in enumerate("xy") for t in "pq"], columns=["source", "lang", "topic", "tokens"])
    targets = {"source": {"a": 0.3, "b": 0.7}, "lang": {"x": 0.6, "y": 0.4}, "topic": {"p": 0.5, "q": 0.5}}
    w = pd.Series(mixing.rake(cells, targets))
    for d, t in targets.items():
        assert w.groupby(cells[d]).sum().to_dict() == pytest.approx(t)


def test_topics_are_those_of_the_definition(spark, docs):
    import re

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(1000 + i, f"Alpha beta alpha {'x' * (38 + i % 5)} é{i % 3}é\x00beta") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'s' AS source", "1 AS lang").repartition(3)
    words = [[w.translate({i: i + 32 for i in range(65, 91)}) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")] for _, t in rows]
    held = collections.Counter(w for x in words for w in set(x) if 3 <= len(w.encode()) <= 40)
    fits = sorted((w for w in held if held[w] * 20 <= len(rows)), key=lambda w: (-held[w], w.encode()))
    topics = sorted(fits[: mixing.TOPICS], key=str.encode)
    assert mixing.topic_words(df) == topics
    want = []
    for (i, t), x in zip(rows, words, strict=True):
        n = {w: x.count(w) for w in topics if w in x}
        want.append((i, min(n, key=lambda w: (-n[w], topics.index(w))) if n else "(none)", len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))))
    assert sorted((r.doc_id, r.topic, r.tokens) for r in mixing.described(df).collect()) == sorted(want)
    assert mixing.topic_words(df.limit(0)) == []


def test_mix_replaces_columns_of_its_names(docs):
    rows = mixing.described(docs).selectExpr("*", "'w' AS weight", "1 AS probability", "2 AS kept", "3 AS extra")
    out = mixing.mix(rows)
    assert sorted(out.columns) == sorted(["doc_id", *mixing.DIMENSIONS, "tokens", "weight", "probability", "kept", "extra"])
    assert dict(out.dtypes)["weight"] == "double" and out.filter("extra = 3").count() == docs.count()
    clash = docs.selectExpr("*", "1 AS topic", "2 AS tokens", "3 AS weight", "4 AS probability")
    kept = mixing.sample(clash)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in mixing.sample(docs).collect())


def test_raking_warns_of_margins_that_cannot_be_met():
    import pandas as pd

    cells = pd.DataFrame([("a", "x", "p", 10), ("b", "y", "p", 30)], columns=["source", "lang", "topic", "tokens"])
    with pytest.warns(UserWarning, match="margins"):
        mixing.rake(cells, {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.1, "y": 0.9}, "topic": {"p": 1.0}})

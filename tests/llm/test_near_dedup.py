import random
import re

import pytest

from weftline.llm import near_dedup as nd
from weftline.llm.components import components

LOWER = {i: i + 32 for i in range(65, 91)}


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute(rows):
    sets = sets_of(rows)
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows, n = [(0, None), (1, ""), (2, "a b"), (3, "A  b"), (4, "c")], 5
    common = [word() for _ in range(60)]
    for group in range(6):
        base = [word() for _ in range(90)] + (common if group % 2 else [])
        for _ in range(40 if group == 0 else 14):  # copies at all distances, around the limit too
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 9])):
                t[rng.randrange(len(t))] = word()
            rows.append((n, " ".join(t)))
            n += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_blocks_and_shuffled_ids_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    monkeypatch.setattr(nd, "MAX_BROADCAST_IDS", -1)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            t[rng.randrange(80)] = f"x{rng.random()}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_awkward_rows(docs, none):
    got = {r.doc_id: r for r in nd.near_duplicates(docs).collect()}
    assert nd.near_duplicates(docs).count() == docs.count()
    assert got[0].n_shingles == got[1].n_shingles == got[2].n_shingles == 0
    assert all(got[i].kept and got[i].component_id == i for i in (0, 1, 2))
    assert {got[i].component_id for i in (3, 4, 5, 6)} == {3}
    assert got[7].component_id == got[8].component_id == 7 and got[7].n_shingles == 1
    assert nd.near_duplicates(none).count() == 0
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    assert {4, 5, 6, 8}.isdisjoint(r.doc_id for r in kept.collect())


def test_null_ids_stay(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (1, t), (2, t)], "doc_id bigint, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in nd.near_duplicates(df).collect()}
    assert got == {None: (None, True), 1: (1, True), 2: (1, False)}


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (300, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[i] for i in (100, 101, 102)} == {100} and got[300] == 200
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sketches_estimate_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, shared in ((3, 2), (40, 30), (400, 300), (5000, 4500)):
        pool = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[n - shared :])
        bins = nd.sketches(np.array([0, n, 2 * n]), np.concatenate([a, b]))
        assert (bins != np.uint64(0xFFFFFFFFFFFFFFFF)).all()  # every bin is filled
        true = shared / (2 * n - shared)
        assert abs((bins[0] == bins[1]).mean() - true) < 5 * (true * (1 - true) / nd.BINS) ** 0.5 + 0.02
    assert (nd.sketches(np.array([0, 0]), np.zeros(0, np.uint64)) == np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_scheme():
    how = nd.scheme(85)
    assert (how.bands, how.rows, how.agree) == (25, 5, 85)
    for similarity in (50, 70, 80, 90, 100):
        how = nd.scheme(similarity)
        assert (1 - (similarity / 100) ** how.rows) ** how.bands <= nd.MISS and 0 < how.agree <= nd.BINS
    for similarity in (0, 0.85, 101):
        with pytest.raises(ValueError):
            nd.scheme(similarity)


def test_similarity_of_the_stage_is_80(spark):
    import corpus_pipeline

    rng = random.Random(5)
    rows = []
    for group in range(80):  # a pair each: 62 words have 58 shingles, of which one changed word takes five, 53 / 63 = 0.84
        base = [f"g{group}w{i}" for i in range(62)]
        other = list(base)
        other[rng.randrange(8, 54)] = "changed"
        rows += [(2 * group, " ".join(base)), (2 * group + 1, " ".join(other))]
    for group in range(80, 100):  # 46 words have 42 shingles, 37 / 47 = 0.79
        base = [f"g{group}w{i}" for i in range(46)]
        rows += [(2 * group, " ".join(base)), (2 * group + 1, " ".join([*base[:20], "changed", *base[21:]]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert nd.near_duplicates(df).filter("kept").count() == 200
    assert nd.near_duplicates(df, 80).filter("kept").count() == 120
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert kept == [*range(0, 160, 2), *range(160, 200)]


def test_rows_with_a_null_id_keep_one_of_each_group(spark):
    one, two, three = (" ".join(f"{k}w{i}" for i in range(30)) for k in "abc")
    rows = [(None, one), (5, one), (None, two), (None, two), (6, three), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = nd.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, one), (None, two), (6, three), (None, None), (None, "")], key=str)


def test_repeated_ids_are_answered_as_their_least_text(spark):
    one, two, other = (" ".join(f"{k}w{i}" for i in range(30)) for k in "abz")
    rows = [(5, one)] * 3 + [(7, other), (7, two), (7, None), (8, other), (9, two), (3, "z")] + [(9, two)]
    got = sorted(tuple(r) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())
    # the least text of 7 is none at all
    assert got == sorted([(5, 26, 5, True)] * 3 + [(7, 0, 7, True)] * 3 + [(8, 26, 8, True), (9, 26, 9, True), (9, 26, 9, True), (3, 1, 3, True)])
    rows = [r for r in rows if r[1]] + [(2, one)]
    got = sorted(tuple(r) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())
    assert got == sorted([(2, 26, 2, True)] + [(5, 26, 2, False)] * 3 + [(7, 26, 7, True)] * 2 + [(8, 26, 8, True), (9, 26, 7, False), (9, 26, 7, False), (3, 1, 3, True)])
    kept = sorted(tuple(r) for r in nd.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert sorted(t for _, t in kept) == sorted([one, two, other, "z"]) and (2, one) in kept and (8, other) in kept


def test_many_repeats_of_two_rows_are_as_cheap_as_two(spark):
    import time

    one, two = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(1, 41))
    took = []
    for times in (1, 1, 1000):
        df = spark.createDataFrame([(1, one), (2, two)] * times, "doc_id bigint, text string")
        began = time.perf_counter()
        got = nd.near_duplicates(df).groupBy("doc_id", "component_id", "kept").count().collect()
        took.append(time.perf_counter() - began)
        assert {(r.doc_id, r.component_id, r.kept, r["count"]) for r in got} == {(1, 1, True, times), (2, 1, False, times)}
    assert took[2] < 2 * took[1] + 5


def test_hot_bucket_of_dissimilar_documents(spark, monkeypatch):
    """All share a long passage and a band, none is similar, two pairs are: blocks find them."""
    monkeypatch.setattr(nd, "BLOCK", 8)
    rng = random.Random(9)
    common = [f"c{i}" for i in range(120)]
    rows = [(i, " ".join([*common, *[f"r{rng.random()}" for _ in range(40)]])) for i in range(60)]
    rows += [(100, f"{rows[3][1]} end"), (101, f"{rows[40][1]} end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df).collect()}
    assert got == brute(rows)

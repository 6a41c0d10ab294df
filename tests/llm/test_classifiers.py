import random
import re
import zlib

import numpy as np
import pytest

from weftline.llm import language, quality, toxicity

from .conftest import prose


def held(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


def test_language(docs, none):
    got = language.identify(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == held(r.doc_id, 5, 0) and 0 <= r.score <= 1
        if r.doc_id in (0, 1, 2, 9):
            assert r.lang_pred == "und" and r.score == 0
        if r.doc_id >= 12:
            assert r.lang_pred == ["en", "de", "fr"][r.doc_id % 3]
    assert language.identify(none).count() == 0
    kept = language.known_language(docs)
    assert kept.columns == docs.columns and {0, 1, 2, 9}.isdisjoint(r.doc_id for r in kept.collect())
    unlabelled = docs.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_code_lengths_are_those_of_the_definition():
    rng = random.Random(2)
    train = ["".join(rng.choice("abc ") for _ in range(50)) for _ in range(5)] + ["a"]
    keys = np.concatenate([language.sequences(*_flat([t])) for t in train])
    keys, n = np.unique(keys, return_counts=True)
    tree = language.Trees(keys, n.astype(float))
    model = language.Model(["x"], [tree], keys)
    counts = {}
    for t in train:
        b = b"\0\0\0" + t.encode()
        for i in range(3, len(b)):
            for k in range(4):
                counts.setdefault(b[i - k : i], {}).setdefault(b[i], 0)
                counts[b[i - k : i]][b[i]] += 1

    def bits(context, symbol):
        seen = counts.get(context)
        if seen and symbol in seen:
            return -np.log2(seen[symbol] / (sum(seen.values()) + len(seen)))
        escape = -np.log2(len(seen) / (sum(seen.values()) + len(seen))) if seen else 0.0
        return escape + (bits(context[1:], symbol) if context else 8.0)

    tests = ["abca zz c", "", "a", "ab", "é", "cab cab"]
    data, offs = _flat(tests)
    got = model.lengths(data, offs)[:, 0] / language.UNIT
    for t, g in zip(tests, got, strict=True):
        b = b"\0\0\0" + t.encode()
        assert g == pytest.approx(sum(bits(b[i - 3 : i], b[i]) for i in range(3, len(b))), abs=1e-3)


def _flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def auc(rows, y):
    good, bad = ([r.score for r in rows if y[r.doc_id] == v] for v in (1, 0))
    return np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])


def check_contract(got, n, cutoff):
    assert len(got) == n
    assert all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cutoff) for r in got)


def test_quality(spark, docs, none):
    rng = random.Random(1)
    rows, y = [], {}
    for i in range(400):
        y[i] = int(i % 4 != 0)
        w = rng.choice(["stone", "river"])
        rows.append((i, prose(i, 60) if y[i] else rng.choice([" ".join([w] * 60), prose(i, 60).upper().replace(" ", "!! "), prose(i, 60).replace(" ", " | ")])))
    rows += [(400, None), (401, ""), (402, " \n ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, v) for i, v in y.items()] + [(7, None), (5000, 1)], "doc_id bigint, quality int")
    got = quality.score(df, labels).collect()
    check_contract(got, len(rows), 0.5)
    assert auc([r for r in got if r.doc_id < 400 and r.held_out], y) > 0.97
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.0}
    assert quality.score(none, labels).count() == 0
    assert quality.score(docs, labels).count() == docs.count()


def test_toxicity(spark, docs, none):
    rng = random.Random(1)
    rows, y = [], {}
    for i in range(900):
        y[i] = int(i % 3 == 0)
        w = prose(i, 60).split()
        for _ in range(3 if y[i] else 0):
            w[rng.randrange(60)] = rng.choice(["grubworm", "zilchface", "nastygob"])
        rows.append((i, " ".join(w)))
    rows += [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame(list(y.items()), "doc_id bigint, toxic int")
    got = toxicity.score(df, labels).collect()
    check_contract(got, len(rows), 0.7)
    assert auc([r for r in got if r.doc_id < 900 and r.held_out], y) > 0.97
    assert next(r.score for r in got if r.doc_id == 900) < 0.5
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(none, labels).count() == 0
    assert toxicity.score(docs, labels).count() == docs.count()


def _toxic_model():
    ordinary = toxicity.ordinary_dictionary([prose(i, 200).encode() for i in range(40)])
    return toxicity.Model(toxicity.toxic_dictionary({b"grubworm": 30.0, b"zilchface": 20.0, b"nastygob": 20.0}, ordinary), ordinary)


def test_toxic_windows_are_compressed_as_defined():
    model = _toxic_model()
    texts = ["", " \n", "grubworm and  stone", prose(3, 300) + " zilchface zilchface", "x" * 4000, "straße élève grubworm\x0bnastygob"]
    run = model.histograms()
    for batch in (texts, texts[::-1]):  # the second time from what is remembered
        data, offs = _flat(batch)
        got = {}
        for i, c, n in zip(*run(data, offs), strict=True):
            got.setdefault(int(i), {})[int(c)] = int(n)
        plain, toxic = toxicity.compressor(model.ordinary), toxicity.compressor(model.toxic)
        for i, t in enumerate(batch):
            want = {}
            for w in t.encode().split():
                window = b" " + w + b" "
                saved, left = plain(window) - toxic(window), toxic(window) - plain(b" ")
                cell = min(max(saved, 0), toxicity.SAVED) * (toxicity.LEFT + 1) + min(max(left, 0), toxicity.LEFT)
                want[cell] = want.get(cell, 0) + 1
            assert got.get(i, {}) == want
    saves = lambda w: model.cells()([b" " + w + b" "])[0] // (toxicity.LEFT + 1)
    assert all(saves(w) >= 3 for w in (b"grubworm", b"zilchface", b"nastygob")) and saves(b"garden") == 0


def test_toxic_log_odds_and_features_are_as_defined():
    rng = random.Random(4)
    docs = [[(rng.randrange(5), rng.randrange(6)) for _ in range(rng.randrange(6))] for _ in range(30)]
    y = np.array([i % 3 == 0 for i in range(30)], int)
    text = np.array([i for i, d in enumerate(docs) for _ in d])
    cell = np.array([s * (toxicity.LEFT + 1) + t for d in docs for s, t in d])
    odds = toxicity.log_odds(text, cell, y)
    for s, t in [(0, 0), (2, 3), (4, 1), (0, toxicity.LEFT), (toxicity.SAVED, 0)]:
        rate = []
        for label in (0, 1):
            n = int((y == label).sum())
            rate.append((sum(any(a >= s and b <= t for a, b in d) for d, v in zip(docs, y, strict=True) if v == label) + n / 30) / n)
        assert odds[s * (toxicity.LEFT + 1) + t] == pytest.approx(np.log(rate[1] / rate[0]))
    usual = np.array([0.1, 0.02])
    x = toxicity.features(odds, usual, text, cell, np.ones(len(text), int), 30)
    for i, d in enumerate(docs):
        own = sorted([odds[s * (toxicity.LEFT + 1) + t] for s, t in d] + [0.0] * 3, reverse=True)
        above = [sum(o > limit for o in own) for limit in toxicity.CLEAR]
        rest = [v for a, u in zip(above, usual, strict=True) for v in (np.log1p(a), min(8, max(-3, (a - u * len(d)) / (u * len(d) + 1) ** 0.5)))]
        assert x[i] == pytest.approx([*own[:3], *rest, np.log1p(len(d))])


def test_toxicity_of_ties_repeats_and_long_words(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        w = prose(i, 40).split()
        if i % 3 == 0:
            w[5] = w[9] = "grubworm"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    rows += rows[:3] + [(9001, rows[0][1]), (9002, "y" * 200_000), (None, "grubworm"), (9003, "grubworm " * 30_000)]
    labels += labels[:3] + [(1, 0), (2, None), (None, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = toxicity.score(df, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(v) == 1 for v in by.values()) and by[9001] == by[0]
    assert max(by[9002]) < 0.5 < min(by[9003])
    assert [r.held_out for r in got if r.doc_id is None] == [True]


def test_word_vectors_and_pooling_are_as_defined(spark):
    texts = [None, "", " \n", "One two -- TWO two, é́!! THREE three three", "a", "x " * 3 + "\x0b x\x00y", prose(5, 60), "STONE RIVER stone... river?! " * 5]
    single = lambda t: int(quality.tokens(*_flat([t]))[0][0])

    def read(text):
        """(row, in capitals, repeats the one before) of each token."""
        out = []
        for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]+", (text or "").encode()):
            row = single(re.sub(rb"[A-Z]", lambda m: m[0].lower(), t).decode("latin-1").encode("latin-1").decode("utf-8"))
            out.append((row, bool(re.fullmatch(rb"[A-Z]{2,}", t)), bool(out) and out[-1][0] == row))
        return out

    index = quality.index_vectors()
    table = np.zeros((quality.ROWS, quality.DIMENSIONS))
    for t in texts:
        read_ = read(t)
        for i, (row, capitals, again) in enumerate(read_):
            for j in range(max(0, i - 2), min(len(read_), i + 3)):
                if j != i:
                    table[row] += index[read_[j][0]]
            table[row] += index[quality.CAPITALS] * capitals + index[quality.REPEATED] * again
    want = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    vectors = quality.word_vectors(df)
    assert np.allclose(vectors, want, atol=1e-6)
    got = quality.pool(vectors, *quality.tokens(*_flat([t or "" for t in texts])), len(texts))
    for x, t in zip(got, texts, strict=True):
        own = read(t)
        n = max(1, len(own))
        v = np.array([want[r] for r, _, _ in own]).reshape(-1, quality.DIMENSIONS)
        mean = v.sum(axis=0) / n
        spread = np.sqrt(np.maximum((v**2).sum(axis=0) / n - mean**2, 0))
        rest = [np.linalg.norm(mean), sum(c for _, c, _ in own) / n, sum(a for _, _, a in own) / n, len({r for r, _, _ in own}) / n, np.log1p(len(own))]
        assert np.allclose(x, [*mean, *spread, *rest], atol=1e-3)


def test_a_training_step_follows_the_gradient(monkeypatch):
    """After one step of Adam from the same start, each weight has moved by the rate against the sign of a numeric gradient."""
    rng = np.random.default_rng(3)
    x, y, weight = rng.normal(size=(25, 4)), rng.integers(0, 2, 25).astype(float), rng.uniform(1, 2, 25)
    monkeypatch.setattr(quality, "DECAY", 0.0)
    monkeypatch.setattr(quality, "EPOCHS", 0)
    start = quality.fit(x, y, weight)
    monkeypatch.setattr(quality, "EPOCHS", 1)
    after = quality.fit(x, y, weight)
    use = np.random.default_rng(quality.SEED).permutation(25)[5:]

    def loss(w2):
        net = quality.Network(start.center, start.scale, start.w1, start.b1, w2, start.b2)
        q = 1 / (1 + np.exp(-net.logits(x[use])))
        return -(weight[use] * (y[use] * np.log(q) + (1 - y[use]) * np.log(1 - q))).sum()

    for i in range(quality.HIDDEN):
        step = np.zeros(quality.HIDDEN)
        step[i] = 1e-5
        slope = loss(start.w2 + step) - loss(start.w2 - step)
        assert after.w2[i] - start.w2[i] == pytest.approx(-quality.RATE * np.sign(slope), rel=1e-3)


def test_languages_are_those_of_the_shortest_code(spark):
    rng = random.Random(6)
    words = {"aa": "mala kasa tola".split(), "bb": "mola kesi tuli".split(), "cc": "xyz zzy".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 8))), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 12)]
    rows += [(100, None, "aa"), (101, "12 34", "bb"), (102, "", "cc"), (103, "MALA kesi", None), (104, "q", None), (105, "mala", "aa"), (105, "mala", "aa")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    counts = {}
    for i, t, lang in rows:
        if t is not None and lang is not None and not held(i, 5, 0):
            b = b"\0\0\0" + t.lower().encode()
            for k in range(3, len(b)):
                for n in range(4):
                    seen = counts.setdefault(lang, {}).setdefault(b[k - n : k], {})
                    seen[b[k]] = seen.get(b[k], 0) + 1

    def bits(lang, context, symbol):
        seen = counts[lang].get(context)
        if seen and symbol in seen:
            return -np.log2(seen[symbol] / (sum(seen.values()) + len(seen)))
        escape = -np.log2(len(seen) / (sum(seen.values()) + len(seen))) if seen else 0.0
        return escape + (bits(lang, context[1:], symbol) if context else 8.0)

    got = {r.doc_id: r for r in language.identify(df).collect()}
    assert len(got) == len(rows) - 1
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        b = b"\0\0\0" + t.lower().encode()
        length = {lang: sum(bits(lang, b[k - 3 : k], b[k]) for k in range(3, len(b))) for lang in sorted(counts)}
        best = min(length, key=lambda lang: (length[lang], lang))
        n = len(b) - 3
        score = 1 / sum(2 ** (-(x - length[best]) * min(n, 32) / n) for x in length.values())
        assert got[i].lang_pred == best and got[i].score == pytest.approx(score, abs=2e-3) and got[i].held_out == held(i, 5, 0)

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import periodic


def brute(words):
    """All runs, period by period, place by place."""
    out = []
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(24, 3 * p):
                smaller = any(p % q == 0 and all(words[k] == words[k + q] for k in range(i, j + p - q)) for q in range(1, p))
                if not smaller:
                    out.append((i, j - i + p, p))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def found(texts):
    raw = [t.encode() for t in texts]
    n, runs, text = periodic.text_runs(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [([(r["start"], r["length"], r["period"]) for r in rs], t) for rs, t in zip(runs.to_pylist(), text.to_pylist(), strict=True)]


@st.composite
def periodic_text(draw):
    """Words of a small vocabulary, some of them repeated as blocks."""
    out = []
    for _ in range(draw(st.integers(0, 4))):
        block = draw(st.lists(st.sampled_from("abc"), min_size=1, max_size=9))
        out += (block * draw(st.integers(1, 30)))[: draw(st.integers(1, 90))]
    return " ".join(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(periodic_text(), min_size=1, max_size=6))
def test_runs_are_those_of_brute_force(texts):
    for text, (runs, kept) in zip(texts, found(texts), strict=True):
        assert runs == brute(text.split())
        assert kept == collapsed(text.split(), runs)


def test_nested_and_touching_runs():
    line = "the cat sat on the mat".split()
    words = ["x"] * 30 + line * 9 + ["y", "z"] * 12 + line * 2
    block = (["a"] * 24 + ["b"]) * 4
    for w in (words, block, ["a"] * 23, ["a"] * 24, ["a", "b"] * 12, list(range(8)) * 3, list(range(9)) * 3, (list(range(9)) * 3)[:-1]):
        w = [str(x) for x in w]
        (runs, kept), = found([" ".join(w)])
        assert runs == brute(w) and kept == collapsed(w, runs)


def test_long_texts_of_one_word_and_of_one_line():
    line = [f"w{i % 7}" for i in range(10)]
    texts = ["a " * 200_000, " ".join(line * 20_000), " ".join(f"u{i}" for i in range(100_000))]
    (one, _), (lines, kept), (none, _) = found(texts)
    assert one == [(0, 200_000, 1)] and lines == [(0, 200_000, 10)] and none == [] and kept == " ".join(line)


def test_a_run_does_not_cross_texts():
    assert [r for r, _ in found(["a " * 20, "a " * 20, "a " * 24])] == [[], [], [(0, 24, 1)]]


def planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_columns(spark, docs, none):
    rows = [(i, " ".join(random.Random(i).choices("abcdefgh", k=i % 250))) for i in range(400)]
    rows += [(7, "a b " * 30), (7, "a b " * 30), (None, "a b " * 30), (900, None), (901, " \n\t "), (902, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("runs", "collapsed", "start", "period", "n_words")}).repartition(3)
    out = periodic.summary(periodic.periodic_runs(df.withColumn("text", periodic.planted(F.col("doc_id"), F.col("text")))))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for doc_id, text in rows:
        words = planted(doc_id, (text or "").split())
        runs = brute(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        milli = 1000 * best[1] // best[2] if runs else None
        want.append((doc_id, len(runs), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(collapsed(words, runs))))
    key = lambda r: str(r)
    got = sorted(map(tuple, out.collect()), key=key)
    assert got == sorted(want, key=key)
    assert any(planted(i, t.split()) != t.split() and brute(planted(i, t.split())) for i, t in rows if i is not None and t)
    assert periodic.summary(periodic.periodic_runs(none)).collect() == []
    assert periodic.periodic_runs(docs).count() == docs.count()


@pytest.mark.parametrize("text", ["a b c", "\x1ca b", "a\x00b\x0bc"])
def test_only_white_space_of_ascii_separates(spark, text):
    n = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert periodic.periodic_runs(n).first().n_words == len([w for w in __import__("re").split(r"[\x20\x09-\x0d]+", text) if w])

"""License scans, decontamination, exact dedup."""

import hashlib
import re

import duckdb
import pytest

from weftline.llm import contamination, exact_dedup, licenses, queries
from weftline.llm.staging import stage

LOWER = {i: i + 32 for i in range(65, 91)}
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return re.findall(WORD, (text or "").translate(LOWER))


def test_licenses(spark):
    rows = [
        (0, None),
        (1, ""),
        (2, "Released under the MIT-License. Released under the mit license!"),
        (3, "cc by nc cc by nc CC-BY-NC 4.0; licensed under cc by-nc 4.0."),
        (4, "under the mit licenses, der apache mit"),
        (5, "Licensed under the Apache License, Version 2.0 and the GNU General Public License, version 3"),
        (6, "this work is licensed under the gnu general public license, version 3."),
        (7, "word " * 3000 + "apache license version 2"),
        (8, "under the mit license" + "é"),
        (9, "UNDER THE MİT LICENSE under the Kmit license"),
    ]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id bigint, text string, licence string")
    got = {r.doc_id: r.licence for r in licenses.scan(df).collect()}
    for i, t in rows:
        w = words_of(t)
        at = [k for p in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        labels = sorted({v for p, v in licenses.BASE.items() if any(w[k : k + len(p.split())] == p.split() for k in range(len(w)))})
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(labels)), i
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[6].labels == "gpl-3" and got[6].score == 1.0 and got[6].base_labels == ""
    assert got[4].labels == "" and got[4].score == 0.0


def test_licenses_awkward(docs, none):
    assert licenses.scan(docs).count() == docs.count()
    assert licenses.scan(none).count() == 0


def brute_hits(text, items):
    w, hit, names = words_of(text), set(), set()
    for name, t in items:
        v = words_of(t)
        k = min(10, len(v))
        for i in range(len(v) - k + 1 if v else 0):
            for j in range(len(w) - k + 1):
                if w[j : j + k] == v[i : i + k]:
                    hit |= set(range(j, j + k))
                    names.add(name)
    return len(w), sorted(hit), sorted(names), *brute_longest(w, items)


def brute_longest(w, items):
    """Words of the longest run of windows, and its first place."""
    best = (0, None)
    for _, t in items:
        v = words_of(t)
        k = min(10, len(v))
        for i in range(len(w)):
            for j in range(len(v)):
                n = 0
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                if v and n >= k and n > best[0]:
                    best = (n, i)
    return best


def test_contamination_against_brute_force(spark, monkeypatch):
    long = " ".join(f"q{i}" for i in range(30))
    items = [("a", long), ("a", long), ("b", "short item here"), ("c", "one"), ("d", None), ("e", "..."), ("f", long), ("g", "q5 q6 q7 q8 q9 q10 q11 q12 q13 q14 q99")]
    texts = [
        None, "", "none of it", f"before {long} after", "Short, ITEM: here and One", "q0 q1 q2 q3 q4 q5 q6 q7 q8", "q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13",
        "x " * 400 + "q5 q6 q7 q8 q9 q10 q11 q12 q13 q14 q15", "short item", "here short item here item here", f"{long} {long}",
    ]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id bigint, text string, matches string").repartition(2)
    bench = spark.createDataFrame([*items, (None, "x x x")], "item_id string, text string")
    for part in (1 << 20, 40):  # one part, then several
        monkeypatch.setattr(contamination, "PART_BYTES", part)
        got = {r.doc_id: r.matches for r in contamination.contaminated(df, bench).collect()}
        for i, t in enumerate(texts):
            n, hit, names, longest, at = brute_hits(t, items)
            assert (got[i].n_words, got[i].hit, got[i].items, got[i].n_hit) == (n, hit, names, len(hit)), (part, i)
            assert (got[i].longest, got[i].longest_at) == (longest, at), (part, i)
        assert (got[3].longest, got[3].longest_at) == (30, 1)
        clean = contamination.decontaminate(df, bench)
        assert clean.columns == df.columns
        assert {r.doc_id for r in clean.collect()} == {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}


def test_suffix_arrays_are_sorted_and_searched_as_defined(monkeypatch):
    """Random texts of few words: arrays by definition, and every window length against brute force, whatever a block holds."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    for block in (1 << 21, 3):
        monkeypatch.setattr(contamination, "BLOCK", block)
        texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(25))) for _ in range(12)]
        items = [(f"i{k}", " ".join(rng.choice("abcd") for _ in range(n))) for k, n in enumerate([0, 1, 2, 3, 5, 7, 8, 9, 10, 11, 14, 20, 20])]
        items += [("copy", texts[2]), ("copy", f"d {texts[3]}")]
        hashed = next(contamination.hashes(iter([pa.array([t for _, t in items])])))
        tests = contamination.test_set([n for n, _ in items], [x.as_py() for x in hashed])
        (rows, shard), = contamination._shards(iter([pa.array(texts[:5]), pa.array(texts[5:])]))
        assert rows == [5, 7]
        for t, (n, hit, found, longest, at) in zip(texts, contamination.search(shard, tests), strict=True):
            want = brute_hits(t, items)
            assert (n, list(hit), sorted({tests.names[i] for i in found}), longest, at) == want
        assert shard.length == 8
        of = {p: tuple(x) for i, t in enumerate(texts) for p, x in enumerate([words_of(t)[j : j + 8] for j in range(len(words_of(t)))], start=int(shard.start[i]))}
        assert sorted(shard.array) == sorted(p for p, x in of.items() if len(x) == 8)
        runs = [of[p] for p in shard.array]
        assert [a == b for a, b in zip(runs, runs[1:])] == list(np.diff(shard.rank[shard.array]) == 0)
        assert len(set(runs)) == len(shard.keys) and (np.diff(shard.keys) > 0).all()


def test_contamination_awkward(spark, docs, none):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert contamination.contaminated(docs, empty).filter("matches.n_hit > 0").count() == 0
    assert contamination.decontaminate(docs, empty).count() == docs.count()
    assert contamination.contaminated(none, empty).count() == 0


def test_exact_dedup(spark, docs, none):
    index = exact_dedup.fresh_index(spark, 4)
    got = exact_dedup.exact_dedup(docs, index).collect()
    rows = docs.collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r.text), []).append(r)
    want = []
    for t, members in groups.items():
        best = min(members, key=lambda r: (-len(r.text or ""), r.doc_id)).doc_id
        want += [(r.doc_id, best, len(members), r.doc_id == best, hashlib.sha256(t.encode()).hexdigest()) for r in members]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert exact_dedup.exact_dedup(none, index).count() == 0
    ends = spark.createDataFrame([(-(2**63), "a"), (2**63 - 1, "a"), (0, "a"), (None, "a"), (None, "b")], "doc_id bigint, text string")
    got = exact_dedup.exact_dedup(ends, exact_dedup.fresh_index(spark, 2)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got if r.group_size > 1) == [
        *[(False, i, -(2**63), 4, i < 0) for i in (-(2**63), 0, 2**63 - 1)], (True, 0, -(2**63), 4, False),
    ]
    assert [(r.doc_id, r.keep_id, r.kept) for r in got if r.group_size == 1] == [(None, None, False)]


def test_index_persists(spark):
    first = exact_dedup.fresh_index(spark, 4)
    one = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (None, "c")], "doc_id bigint, text string")
    two = spark.createDataFrame([(10, "a  b"), (11, "new"), (None, "null id")], "doc_id bigint, text string")
    exact_dedup.exact_dedup(one, first).count()
    again = exact_dedup.DigestIndex(spark, first.path)
    assert again.buckets == 4
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.exact_dedup(two, again).collect()}
    assert got == {10: (1, False), 11: (11, True), None: (None, False)}
    assert again.read().count() == 4 and len(again.runs) == 2
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, first.path, 8)


def test_runs_are_read_as_they_are_sorted(spark):
    """After two appends: one exchange and one sort, both of the batch; the runs stay where and as they are."""
    index = exact_dedup.fresh_index(spark, 4)
    batch = lambda a, b: spark.range(a, b).selectExpr("id AS doc_id", "concat('text ', id % 500) AS text")
    for a, b in ((0, 300), (200, 450)):
        index.append(exact_dedup.groups_of(exact_dedup.digests(batch(a, b))))
    groups = stage(exact_dedup.groups_of(exact_dedup.digests(batch(400, 600))), "groups")
    with index.sorted_scans():
        plan = index.fresh(groups)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and plan.count("Bucketed: true") == 2 and "LeftAnti" in plan
        assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1, plan
        assert index.fresh(groups).count() == 50
    for k in range(4):  # more runs than MOST_RUNS become one, and nothing is lost
        index.append(exact_dedup.groups_of(exact_dedup.digests(batch(450 + 10 * k, 460 + 10 * k))))
    assert len(index.runs) <= exact_dedup.MOST_RUNS
    assert index.read().count() == index.read().select("digest").distinct().count() == 490
    assert exact_dedup.DigestIndex(spark, index.path).read().count() == 490
    index.close()
    assert not spark.sql("SHOW TABLES").filter(f"tableName IN ('{list(index.runs.values())}')").count()


def test_items_with_a_null_id_count(spark, tmp_path, monkeypatch):
    long = " ".join(f"q{i}" for i in range(30))
    items = [(None, long), (None, "short item"), (7, "short item here"), (8, "q1 q2")]
    texts = [None, "clean", f"before {long} after", "short item here", "a short item", "q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    columns = "doc_id, n_words, n_hit, n_items, items_sha256, contaminated"
    want = duck.sql(f"SELECT {columns} FROM ({queries.SQL['op8_decontamination']}) ORDER BY 1").fetchall()
    assert [w[3] for w in want] == [0, 0, 2, 2, 1, 1]
    for part in (1 << 20, 40):  # one part, then several
        monkeypatch.setattr(contamination, "PART_BYTES", part)
        got = queries.QUERIES["op8_decontamination"](spark, str(tmp_path)).select(*columns.split(", "))
        assert sorted(tuple(r) for r in got.collect()) == want
        assert {r.doc_id for r in contamination.decontaminate(docs, bench).collect()} == {0, 1}

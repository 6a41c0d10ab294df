import hashlib
import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.llm import manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(root, paths) by whole levels."""
    paths, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for path, k in zip(paths, at, strict=True):
            run = runs[k // 3]
            path.append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        nodes, at = [sha(*r) for r in runs], [k // 3 for k in at]
    return nodes[0], paths


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 10, 13, 26, 27, 28, 30, 81, 82, 100, 243, 500])
def test_traversal(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = manifest.height(n)
    root, paths = tree(leaves)
    assert manifest.root_of(iter(leaves), levels) == root
    assert list(manifest.traverse(leaves, levels)) == paths


def test_stacks_hold_few_nodes():
    stack, most = manifest.Stack(6), 0
    for i in range(700):
        stack.add(str(i))
        most = max(most, sum(map(len, stack.pending)))
    assert most <= 2 * 6 + 3


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows of doc_id, source, lang, n_chars, text."""
    leaf = lambda r, text: sha(*[field(x) for x in (*r[:4], text)])
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own, subroots = {}, []
    for s in sources:
        mine = sorted([r for r in rows if r[1] == s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        subroot, paths = tree([leaf(r, r[4]) for r in mine])
        subroots.append(subroot)
        own[s] = (mine, subroot, paths)
    root, above = tree(subroots)
    out = []
    for s, upper in zip(sources, above, strict=True):
        mine, subroot, paths = own[s]
        for r, path in zip(mine, paths, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            h = leaf(r, r[4].replace("\n", "") if tampered else r[4])
            for a, b in path + upper:
                h = sha(a, h, b)
            out.append((r[0], leaf(r, r[4]), subroot, root, sha(*itertools.chain(*(path + upper))), h))
    return out


def answer(df, levels=manifest.LEVELS):
    text = F.col("text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit("")))
    out = manifest.manifest(df, tampered, levels)
    return out.select("doc_id", "leaf", "subroot", "root", manifest.path_digest(F.col("path")), manifest.fold(F.coalesce("altered", "leaf"), F.col("path")))


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def cases():
    rows = [(i, ["hot", "hot", f"s{i % 7}", None, "é", ""][i % 6], "en", i, f"text {i}\nline") for i in range(200)]
    rows += [(None, None, None, None, None), (None, "hot", None, 3, ""), (5, "hot", "en", 1, "a\nb"), (5, "hot", "en", 1, "a\nb"), (-3, "alone", "de", 1, "x"), (7, "hot", None, None, None), (2**62, "alone", "", 0, "ü\n\n")]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_equals_brute_force(spark, levels):
    """Small blocks, so that there are rounds of them."""
    df = spark.createDataFrame(cases(), SCHEMA).withColumns({c: F.lit("x") for c in ("node", "tree", "pos", "path", "block", "part", "rank", "altered", "root")})
    want = sorted(brute(cases()), key=str)
    assert sorted(map(tuple, answer(df.repartition(5), levels).collect()), key=str) == want
    assert sorted(map(tuple, answer(df.repartition(1), levels).collect()), key=str) == want


def test_one_row_no_row_and_one_source(spark, none):
    one = [(1, "s", "en", 2, "a\nb")]
    assert list(map(tuple, answer(spark.createDataFrame(one, SCHEMA)).collect())) == brute(one)
    assert answer(none).collect() == []
    many = [(i, "s", "en", i, "t") for i in range(800)]
    assert sorted(map(tuple, answer(spark.createDataFrame(many, SCHEMA)).collect())) == sorted(brute(many))


def test_a_change_is_found(docs):
    out = manifest.manifest(docs, F.when(F.col("doc_id") == 3, F.concat("text", F.lit("!"))))
    rows = out.select("doc_id", "root", manifest.fold(F.coalesce("altered", "leaf"), F.col("path")).alias("folded")).collect()
    assert {r.doc_id for r in rows if r.folded != r.root} == {3}
    assert len({r.root for r in rows}) == 1 and len(rows) == docs.count()

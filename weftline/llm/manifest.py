"""Merkle manifest of a dataset: a digest for each row, a tree over each source, a tree over the sources.

Every three consecutive nodes become their hash, level by level, so that rows of one source fall into aligned blocks of
729 rows whose inner nodes depend on the block alone. A block is traversed leaf by leaf: for each level a stack hashes
the nodes that the next run of three will need, one leaf a step, while the current run serves authentication paths. The
state is a few nodes a level. Roots of blocks are the leaves of the next round, so that a round divides the rows by 729, and
what is above a block is one path, appended to the paths of all its rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.sharding import numbered
from weftline.llm.staging import prepare_workers, scoped, stage

FANOUT = 3
#: Levels of a block, which then has 729 leaves.
LEVELS = 6

Path = list[tuple[str, str]]


def combine(nodes: Sequence[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def height(n: int) -> int:
    """Levels of a tree of n leaves of its own: 0 for a lone leaf."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


class Stack:
    """Hashes leaves that are added one by one to the nodes of one level; holds two pending nodes a level at most."""

    def __init__(self, level: int):
        self.level = level
        self.pending: list[list[str]] = [[] for _ in range(level + 1)]

    def add(self, leaf: str) -> None:
        h = 0
        self.pending[0].append(leaf)
        while h < self.level and len(self.pending[h]) == FANOUT:
            self.pending[h + 1].append(combine(self.pending[h]))
            self.pending[h] = []
            h += 1

    def close(self) -> list[str]:
        """The nodes of the level; a last run of fewer nodes, even of one, is hashed too."""
        for h in range(self.level):
            if self.pending[h]:
                self.pending[h + 1].append(combine(self.pending[h]))
                self.pending[h] = []
        return self.pending[self.level]


def root_of(leaves: Iterator[str], levels: int) -> str:
    stack = Stack(levels)
    for leaf in leaves:
        stack.add(leaf)
    return stack.close()[0]


def traverse(leaves: Sequence[str], levels: int) -> Iterator[Path]:
    """The path of each leaf in turn, lowest level first: the texts of the siblings to its left and to its right."""
    n = len(leaves)
    runs: list[list[str]] = []  # of each level, the run that the current leaf is below
    for h in range(levels):  # the first ones; those of later leaves come from the stacks
        stack = Stack(h)
        for leaf in leaves[: FANOUT ** (h + 1)]:
            stack.add(leaf)
        runs.append(stack.close())
    ahead = [Stack(h) for h in range(levels)]
    path: Path = [("", "")] * levels
    for i in range(n):
        for h in range(levels):
            width = FANOUT**h
            if i % width:
                break
            k = i // width % FANOUT
            path[h] = ("".join(runs[h][:k]), "".join(runs[h][k + 1 :]))
        yield list(path)
        for h in range(levels):
            width = FANOUT ** (h + 1)
            if i + width < n:
                ahead[h].add(leaves[i + width])
            if (i + 1) % width == 0:
                runs[h], ahead[h] = ahead[h].close(), Stack(h)


def _height(block: int, n: int, levels: int) -> int:
    """Levels that a block of n leaves has in its tree: a tree of one block ends where one node is left."""
    return levels if block or n == FANOUT**levels else height(n)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, int, list[dict]]]:
    """Rows of each (tree, block) in turn, of batches sorted so."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["tree"], row["block"])
            if rows and own != key:
                yield *key, rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield *key, rows


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, node): the root of each block, numbered as the blocks are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {"tree": [], "pos": [], "node": []}
        for tree, block, rows in _blocks(batches):
            found["tree"].append(tree)
            found["pos"].append(block)
            found["node"].append(root_of((r["node"] for r in rows), _height(block, len(rows), levels)))
        yield pa.RecordBatch.from_pydict(found, schema=pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("node", pa.string())]))

    return _dealt(nodes.select("tree", _block(F.col("pos"), levels), "pos", "node")).mapInArrow(run, "tree string, pos bigint, node string")


def _block(pos: Column, levels: int) -> Column:
    return F.floor(pos / F.lit(FANOUT**levels)).cast("bigint").alias("block")


_PATH = "path array<struct<left: string, right: string>>"
_ARROW_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _paths(nodes: DataFrame, above: DataFrame, own: dict[str, str], levels: int) -> DataFrame:
    """``nodes`` with their paths to the top: within the block, then the path ``above`` (tree, pos, subroot, path) has for the block.

    ``own``: further columns of ``nodes`` with their types, kept.
    """
    schema = ", ".join(["tree string, pos bigint, node string, subroot string", *[f"{c} {t}" for c, t in own.items()], _PATH])
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    arrow = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("node", pa.string()), ("subroot", pa.string()), *[(c, kinds[t]) for c, t in own.items()], ("path", _ARROW_PATH)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, block, rows in _blocks(batches):
            head, rows = rows[0], rows[1:]  # the block's own row has pos -1
            upper = [(x["left"], x["right"]) for x in head["path"]]
            offs, left, right = [0], [], []
            for path in traverse([r["node"] for r in rows], _height(block, len(rows), levels)):
                for a, b in (*path, *upper):
                    left.append(a)
                    right.append(b)
                offs.append(len(left))
            pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
            columns = {"tree": [tree] * len(rows), "subroot": [head["subroot"]] * len(rows), **{c: [r[c] for r in rows] for c in ("pos", "node", *own)}}
            arrays = [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pairs) if f.name == "path" else pa.array(columns[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    heads = above.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"), "subroot", "path")
    rows = nodes.select("tree", _block(F.col("pos"), levels), "pos", "node", *own)
    return _dealt(rows.unionByName(heads, allowMissingColumns=True)).mapInArrow(run, schema)


def _rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes, and of each round the roots of blocks, until each tree has one: its root."""
    out = [nodes]
    while True:
        out.append(stage(_block_roots(out[-1], levels), "merkle-roots", narrow=True))
        if not out[-1].agg(F.max("pos")).first()[0]:
            return out


def field(c: Column) -> Column:
    """A value as it is hashed: '-' for null, else its bytes' number, a colon and itself."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(row: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*[field(row[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")]).cast("binary"), 256)


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, node, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def path_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def _places(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, doc_id, node, altered) with pos: the place within the tree by doc_id, then by digest, from 0.

    A range shuffle sorts all rows over all tasks. Each task numbers the rows of its trees in one pass; only the first
    tree of a task can have begun in the tasks before, so that one number a task, summed on the driver, completes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last, pos = TaskContext.get().partitionId(), 0, None, -1
        for batch in batches:
            places = []
            for tree in batch.column("tree").to_pylist():
                pos = pos + 1 if pos >= 0 and tree == last else 0
                last = tree
                places.append(pos)
            n = batch.num_rows
            own = [pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.array(places, pa.int64())]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, "part", "rank", "own"])

    spread = rows.withColumn("tie", F.monotonically_increasing_id()).sort("tree", "doc_id", "node", "tie").drop("tie")
    kept = stage(spread.mapInArrow(run, "tree string, doc_id bigint, node string, altered string, part int, rank bigint, own bigint"), "merkle-leaves")
    end = F.struct("tree", "own")
    ends = kept.groupBy("part").agg(F.min_by("tree", "rank").alias("first"), F.max_by(end, "rank").alias("last")).orderBy("part").collect()  # a row a task
    before, carry, open_at = [], 0, None
    for r in ends:
        carry = carry if open_at == (r["first"],) else 0
        before.append((r["part"], carry))
        carry = r["last"]["own"] + 1 + (carry if r["last"]["tree"] == r["first"] else 0)
        open_at = (r["last"]["tree"],)
    offsets = rows.sparkSession.createDataFrame(before, "part int, before bigint")
    pos = F.col("own") + F.when(F.col("own") == F.col("rank"), F.col("before")).otherwise(0)
    return kept.join(F.broadcast(offsets), "part").select("tree", "doc_id", "node", "altered", pos.alias("pos"))


@scoped
def manifest(documents: DataFrame, altered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of ``documents``: doc_id, source, leaf, altered, subroot, root, path.

    A leaf hashes doc_id, source, lang, n_chars and text, each with its length; null differs from empty. Leaves of a
    source ascend by doc_id, nulls first, then by digest, so that the result does not depend on how rows lie; rows repeated
    whole are leaves of their own with one digest. Null is a source, before all others. ``path`` is the authentication path
    from the leaf to the root, lowest level first: the siblings' digests to the left and to the right, joined. ``altered``
    may name a text in place of the row's, null where it is the row's own: its leaf, else null, comes as column
    ``altered``. Texts are hashed whole and not shuffled. An empty table gives an empty result. Columns other
    than the five are not read. ``levels``: those of a block; the result does not depend on it.
    """
    prepare_workers(documents.sparkSession)
    row = {c: F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")}
    other = F.lit(None).cast("string") if altered is None else F.when(altered.isNotNull(), leaf(row | {"text": altered}))
    places = _places(documents.select(F.col("source").cast("string").alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf(row).alias("node"), other.alias("altered")))
    rounds = _rounds(places, levels)
    sources = numbered(rounds[-1].select(F.col("tree").alias("source"), F.col("node")), [F.col("source")], "pos").select(F.lit(None).cast("string").alias("tree"), "pos", "node", "source")
    sources = stage(sources, "merkle-sources", narrow=True)
    upper = _rounds(sources, levels)
    top = upper[-1].first()
    root = top["node"] if top else None
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    paths = upper[-1].select("tree", "pos", F.lit(None).cast("string").alias("subroot"), nothing.alias("path"))
    for nodes in reversed(upper[1:-1]):
        paths = stage(_paths(nodes, paths, {}, levels), "merkle-paths", narrow=True)
    paths = _paths(sources, paths, {"source": "string"}, levels).select(F.col("source").alias("tree"), F.lit(0).cast("bigint").alias("pos"), F.col("node").alias("subroot"), "path")
    paths = stage(paths, "merkle-paths")
    for nodes in reversed(rounds[1:-1]):
        paths = stage(_paths(nodes, paths, {}, levels), "merkle-paths")
    out = _paths(places, paths, {"doc_id": "bigint", "altered": "string"}, levels)
    return out.select("doc_id", F.col("tree").alias("source"), F.col("node").alias("leaf"), "altered", "subroot", F.lit(root).cast("string").alias("root"), "path")


#: DuckDB's crc32 of the decimal doc_id, by a table made by its rule; ``t`` gives the table as column ``crc``.
CRC_TABLE_SQL = "SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x)) AS crc"
CRC_SQL = "xor(list_reduce(list_transform(range(strlen(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(substr(CAST(doc_id AS VARCHAR), CAST(i + 1 AS BIGINT), 1)) AS BIGINT)), lambda c, v: xor(c >> 8, crc[xor(c & 255, v) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


def manifest_sql() -> str:
    """The manifest of table ``documents`` in DuckDB, where every second doc_id by crc32 has its text's line ends deleted."""
    f = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    head = " || ".join(f(c) for c in ("doc_id", "source", "lang", "n_chars"))
    beside = "PARTITION BY tree, lvl, pos // 3 ORDER BY pos ROWS BETWEEN"
    return rf"""
    WITH RECURSIVE c AS (
        {CRC_TABLE_SQL}
    ), d AS (
        SELECT row_number() OVER () AS row, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, sha256({head} || {f("text")}) AS leaf,
               CASE WHEN {CRC_SQL} % 2 = 0 AND text IS NOT NULL THEN sha256({head} || {f("replace(text, chr(10), '')")}) END AS altered
        FROM documents, c
    ), p AS (
        SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
    ), t AS (
        SELECT tree, 0 AS lvl, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM p
        UNION ALL
        SELECT tree, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM t WHERE n > 1 GROUP BY tree, lvl, pos // 3
    ), s AS (
        SELECT tree, node AS subroot, lvl AS depth FROM t WHERE n = 1
    ), u AS (
        SELECT -1 AS tree, 0 AS lvl, tree AS pos, subroot AS node, count(*) OVER () AS n FROM s
        UNION ALL
        SELECT tree, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM u WHERE n > 1 GROUP BY tree, lvl, pos // 3
    ), b AS (
        SELECT tree, lvl, pos, coalesce(string_agg(node, '') OVER ({beside} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
               coalesce(string_agg(node, '') OVER ({beside} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
        FROM (FROM t WHERE n > 1 UNION ALL FROM u WHERE n > 1)
    ), a AS (
        SELECT row, tree, pos, 0 AS lvl, coalesce(altered, leaf) AS h, '' AS proof FROM p
        UNION ALL
        SELECT row, tree, pos // 3, lvl + 1, sha256(l || h || r), proof || l || r FROM a JOIN b USING (tree, lvl, pos)
    ), e AS (
        SELECT row, -1 AS tree, tree AS pos, 0 AS lvl, h, proof FROM a JOIN s USING (tree) WHERE lvl = depth
        UNION ALL
        SELECT row, tree, pos // 3, lvl + 1, sha256(l || h || r), proof || l || r FROM e JOIN b USING (tree, lvl, pos)
    ), o AS (
        SELECT node AS root, lvl AS depth FROM u WHERE n = 1
    )
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
    FROM p JOIN s USING (tree), o JOIN e ON e.lvl = o.depth WHERE e.row = p.row
    """

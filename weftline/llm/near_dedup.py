"""MinHash near-deduplication with fast similarity sketching.

A sketch has t bins. Round i of the first t rounds throws every shingle into one hashed bin with a value in [i, i + 1);
round t + j throws all of them into bin j, so that no bin stays empty. A bin keeps its smallest value, and rounds end
when all bins are filled. Two sets agree in a bin with a probability near their similarity, with concentration
as of independent bins.

Sets with equal fingerprints are one class. Classes that agree in a band of the sketch are candidates:

1. each is linked to the smallest of its bucket, where sketches agree enough; the best such link of each is verified;
2. in buckets that still hold several components, the best link of each member to another component is verified and
   components are joined, a few times over, so that candidates stay in proportion to members while components grow;
3. what is then left, every pair of different components in a bucket whose sketches agree enough, is verified where the
   bucket is, against the members' full sets. Pairs are never rows: only links found come out, at most one for each member and
   component. A pair is looked at in the first band that it shares, and not at all once others have joined its components.

Verification compares full shingle sets. No link is given up but by the sketch: at the similarity asked for, the chance that
a link shares no band or falls below the agreement asked for is below one in a hundred thousand. Bands and agreement are
derived from the similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import components
from weftline.llm.staging import prepare_workers, scoped, stage
from weftline.llm.textvec import NOT_SPACE, Words, chunks, mix, release, shingles

WORDS = 5
#: Least similarity in hundredths: that of op2, and that of a stage that is told no other.
SIMILARITY, STAGE_SIMILARITY = 85, 80
BINS = 125
#: Most chance that a link shares no band, and that it falls below the agreement asked for.
MISS = 1e-6
#: Buckets of more members are compared in blocks of this size.
BLOCK = 1024
#: Up to so many ids select texts by broadcast; more by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Rounds of best links before the rest is verified in full.
BEST_ROUNDS = 4


@dataclass(frozen=True)
class Scheme:
    """How links of a least similarity, in hundredths, are found."""

    similarity: int
    bands: int
    rows: int
    #: Bins that must agree before full sets are compared.
    agree: int


def scheme(similarity: int) -> Scheme:
    """The longest bands, and the most agreeing bins, that miss a link of the similarity with a chance of MISS at most."""
    if not 0 < similarity <= 100:
        raise ValueError(f"similarity is in hundredths, above 0 and up to 100: {similarity}")
    p = similarity / 100
    rows = next((r for r in (5, 4, 3, 2, 1) if (1 - p**r) ** (BINS // r) <= MISS), None)
    if rows is None:
        raise ValueError(f"{BINS} bins are too few for a similarity of {similarity} hundredths")
    agree, below = 0, (1 - p) ** BINS
    while below <= MISS and agree < BINS:
        agree += 1
        below += math.comb(BINS, agree) * p**agree * (1 - p) ** (BINS - agree)
    return Scheme(similarity, BINS // rows, rows, agree)


_SEEDS = mix(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketches(first: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The bins of each set, as round and value in one number; all ones for empty sets."""
    n = len(first) - 1
    size = np.diff(first)
    bins = np.full(n * BINS, np.uint64(0xFFFFFFFFFFFFFFFF))
    open_ = size > 0
    owner = np.repeat(np.arange(n), size)
    for r in range(2 * BINS):
        if not open_.any():
            break
        if r:
            inside = open_[owner]
            owner, hashes = owner[inside], hashes[inside]
        x = mix(hashes ^ _SEEDS[r])
        at = (((x >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64) if r < BINS else np.full(len(x), r - BINS)
        np.minimum.at(bins, owner * BINS + at, (np.uint64(r) << np.uint64(32)) | (x & np.uint64(0xFFFFFFFF)))
        open_ = (bins.reshape(n, BINS) == np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1) & (size > 0)
    return bins.reshape(n, BINS)


def fingerprints(first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(salt)))])
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


SKETCH = "n bigint, f1 bigint, f2 bigint, sig binary, bands array<bigint>"
_SKETCH_TYPE = pa.struct([("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sig", pa.binary()), ("bands", pa.list_(pa.int64()))])


def _sketch(how: Scheme):
    """n, f1, f2, sig and bands of each text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = []
            for data, offs in chunks(texts, 1 << 17):
                first, hashes = shingles(Words(data, offs, NOT_SPACE), WORDS)
                n = np.diff(first)
                bins = mix(sketches(first, hashes))
                bands = np.zeros((len(n), how.bands), np.uint64)
                for j in range(how.rows):
                    bands = bands * np.uint64(0xD6E8FEB86659FD93) + bins[:, j * how.bands : (j + 1) * how.bands]
                bands = mix(bands + np.arange(how.bands, dtype=np.uint64))
                has = n > 0
                f1, f2 = fingerprints(first, hashes)
                sig = np.ascontiguousarray((bins & np.uint64(0xFF)).astype(np.uint8))
                offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * BINS)
                lists = np.concatenate([[0], np.cumsum(np.where(has, how.bands, 0))]).astype(np.int32)
                parts.append(
                    pa.StructArray.from_arrays(
                        [
                            pa.array(n.astype(np.int64)),
                            pa.array(f1),
                            pa.array(f2),
                            pa.Array.from_buffers(pa.binary(), len(n), [None, offsets.buffers()[1], pa.py_buffer(sig.tobytes())]),
                            pa.ListArray.from_arrays(pa.array(lists), pa.array(bands[has].ravel().view(np.int64))),
                        ],
                        fields=list(_SKETCH_TYPE),
                    )
                )
            yield pa.concat_arrays(parts) if parts else pa.array([], _SKETCH_TYPE)
            release()

    return run


def _agreement(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        yield pa.array((_signatures(a) == _signatures(b)).sum(axis=1, dtype=np.int32))


def _signatures(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.frombuffer(column.buffers()[2], np.uint8)[column.offset * BINS : (column.offset + n) * BINS].reshape(n, BINS) if n else np.zeros((0, BINS), np.uint8)


def _similar(how: Scheme):
    """Whether the full sets of two texts reach the similarity."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            out, i = np.zeros(len(a), bool), 0
            for data, offs in chunks(a):
                m = len(offs) - 1
                first, mine = shingles(Words(data, offs, NOT_SPACE), WORDS)
                j = 0
                for data_b, offs_b in chunks(b.slice(i, m)):
                    first_b, yours = shingles(Words(data_b, offs_b, NOT_SPACE), WORDS)
                    for k in range(len(offs_b) - 1):
                        x, y = mine[first[j] : first[j + 1]], yours[first_b[k] : first_b[k + 1]]
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        union = len(x) + len(y) - both
                        out[i + j] = union > 0 and 100 * both >= how.similarity * union
                        j += 1
                i += m
            yield pa.array(out)
            release()

    return run


NAMES = ["bucket", "low", "high", "block", "rep", "component", "n", "sig"]


class _Group:
    """Rows of whole groups, sorted by group."""

    def __init__(self, rows: list[np.ndarray], how: Scheme):
        self.how = how
        self.group, self.bucket, self.block, self.rep, self.component, self.n, self.sig, self.cross, *self.more = rows

    def best_links(self) -> Iterator[pa.RecordBatch]:
        """For each row the row of another component of its group whose sketch agrees most, if enough."""
        best, partner = np.zeros(len(self.group), np.int32), np.zeros(len(self.group), np.int64)
        for step in range(1, len(self.group)):
            a = np.flatnonzero(self.group[:-step] == self.group[step:])
            if not len(a):
                break
            b = a + step
            ok = (self.component[a] != self.component[b]) & self._may(a, b)
            a, b = a[ok], b[ok]
            for c in range(0, len(a), 1 << 15):
                x, y = a[c : c + (1 << 15)], b[c : c + (1 << 15)]
                agree = (self.sig[x] == self.sig[y]).sum(axis=1, dtype=np.int32)
                for mine, other in ((x, y), (y, x)):
                    more = agree > np.maximum(best[mine], self.how.agree - 1)
                    best[mine[more]], partner[mine[more]] = agree[more], other[more]
        has = np.flatnonzero(best)
        yield self._batch(has, partner[has])

    def verified_links(self) -> Iterator[pa.RecordBatch]:
        """Links between components of a group whose full sets are similar; components join as links are found."""
        bands, sets = self.more
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(self.group)) + 1, [len(self.group)]]) if len(self.group) else np.zeros(1, int)
        found_a, found_b = [], []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            comp = self.component[low:high].copy()
            for x in range(low, high - 1):
                y = np.arange(x + 1, high)
                y = y[comp[y - low] != comp[x - low]]
                y = y[self._may(np.full(len(y), x), y)]
                y = y[(self.sig[y] == self.sig[x]).sum(axis=1) >= self.how.agree] if len(y) else y
                if not len(y):
                    continue
                shared = bands[y] == bands[x]
                y = y[bands[x][shared.argmax(axis=1)] == self.bucket[x]]
                if not len(y):
                    continue
                both = _common(sets[x], [sets[k] for k in y])
                y = y[100 * both >= self.how.similarity * (self.n[x] + self.n[y] - both)]
                for k in y:
                    if comp[k - low] != comp[x - low]:
                        comp[comp == comp[k - low]] = comp[x - low]
                        found_a.append(x)
                        found_b.append(k)
        yield self._batch(np.array(found_a, np.int64), np.array(found_b, np.int64))

    def _may(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sizes allow the similarity, and, between two blocks, whether the rows are of different ones."""
        small, large = np.minimum(self.n[a], self.n[b]), np.maximum(self.n[a], self.n[b])
        return (100 * small >= self.how.similarity * large) & (~self.cross[a] | (self.block[a] != self.block[b]))

    def _batch(self, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        one, two = np.minimum(self.rep[x], self.rep[y]), np.maximum(self.rep[x], self.rep[y])
        return pa.RecordBatch.from_arrays([pa.array(one), pa.array(two)], ["a", "b"])


def _common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values of a sorted set are in each of others."""
    values = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, values), len(one) - 1)
    sums = np.concatenate([[0], np.cumsum(one[at] == values)])
    ends = np.cumsum([len(o) for o in others])
    return sums[ends] - sums[np.concatenate([[0], ends[:-1]])]


def _linker(verify: bool, how: Scheme):
    """Links within each group of rows that arrive sorted by group; the groups of a batch, and the one it ends in, are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        number, last = 0, None

        def links(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            g = _Group(rows, how)
            return g.verified_links() if verify else g.best_links()

        for batch in batches:
            if not batch.num_rows:
                continue
            col = {k: batch.column(i) for i, k in enumerate([*NAMES, "bands", "set"][: batch.num_columns])}
            key = np.stack([col[k].to_numpy(zero_copy_only=False).astype(np.int64) for k in NAMES[:3]], axis=1)
            before = np.concatenate([key[:1] if last is None else last[None], key[:-1]])
            group = number + np.cumsum((key != before).any(axis=1))
            number, last = int(group[-1]), key[-1].copy()
            values = [col[k].to_numpy(zero_copy_only=False) for k in NAMES[3:7]]
            rows = [group, key[:, 0], *values, _signatures(col["sig"]), key[:, 1] != key[:, 2]]
            if verify:
                sets = np.empty(len(group), object)
                sets[:] = [np.frombuffer(b.as_buffer(), np.uint64) for b in col["set"]]
                rows += [col["bands"].flatten().to_numpy().reshape(-1, how.bands), sets]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            cut = int(np.searchsorted(rows[0], number))
            yield from links([x[:cut] for x in rows])
            held = [x[cut:].copy() for x in rows]
            release()
        if held is not None:
            yield from links(held)

    return run


def _sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The sorted shingles of each text as bytes."""
    for texts in batches:
        out = []
        for data, offs in chunks(texts):
            first, hashes = shingles(Words(data, offs, NOT_SPACE), WORDS)
            out += [hashes[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.array(out, pa.binary())
        release()


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of some ids; texts stay where they are while the ids are few."""
    ids = stage(ids, "candidate-ids", narrow=True)
    return texts.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "id", "left_semi")


@scoped
def _verified(links: DataFrame, texts: DataFrame, how: Scheme) -> DataFrame:
    """The links (a, b) whose texts are similar, staged."""
    links = stage(links.select("a", "b"), "candidates", narrow=True)
    own = _only(texts, links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct())
    similar = F.arrow_udf(_similar(how), "boolean")
    one = own.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = own.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = links.join(one, "a").join(two, "b")
    return stage(both.filter(similar("text_a", "text_b")).select("a", "b"), "verified", narrow=True)


@scoped
def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, component) after the links' ends are joined too."""
    at = lambda side: links.join(labels, links[side] == labels["node"], "left").select("a", "b", F.coalesce("component", F.col(side)).alias(f"c{side}"))
    one, two = at("a"), at("b")
    ends = one.join(two, ["a", "b"]).select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a != b").distinct()
    joined = components(ends).withColumnRenamed("node", "old").withColumnRenamed("component", "new")
    nodes = labels.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component"))).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component"))
    )
    nodes = nodes.groupBy("node").agg(F.min("component").alias("component"))
    out = nodes.join(joined, nodes["component"] == joined["old"], "left")
    return stage(out.select("node", F.coalesce("new", "component").alias("component")), "components", narrow=True)


@scoped
def links_between(classes: DataFrame, texts: DataFrame, how: Scheme) -> DataFrame:
    """(node, component) of the classes (rep, n, sig, bands) that have links; ``texts`` has (id, text) of each rep."""
    in_bucket = classes.select("rep", F.explode("bands").alias("bucket"))
    buckets = in_bucket.groupBy("bucket").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    buckets = stage(buckets, "buckets")
    member = stage(in_bucket.join(buckets, "bucket"), "members")

    # 1. stars
    star = member.filter("rep != pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    narrow = classes.select("rep", "n", "sig")
    pair = star.join(narrow.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a").join(
        narrow.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b"
    )
    pair = pair.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * how.similarity)
    agreement = F.arrow_udf(_agreement, "int")
    rated = pair.select("a", "b", agreement("sa", "sb").alias("agree")).filter(F.col("agree") >= how.agree)
    best = rated.groupBy("b").agg(F.max(F.struct("agree", (-F.col("a")).alias("a"))).alias("x")).select((-F.col("x.a")).alias("a"), "b")
    tried = stage(best, "tried", narrow=True)
    labels = stage(components(_verified(tried, texts, how)), "components", narrow=True)

    # 2. best links between components
    for _ in range(BEST_ROUNDS):
        links = _grouped(_unresolved(member, labels), narrow).mapInArrow(_linker(False, how), "a bigint, b bigint").distinct()
        links = stage(links.join(tried, ["a", "b"], "left_anti"), "links", narrow=True)
        good = _verified(links, texts, how)
        if not good.limit(1).count():
            break
        labels = _relabelled(labels, good)
        tried = stage(tried.unionByName(links), "tried", narrow=True)

    # 3. all that is left
    rows = stage(_unresolved(member, labels), "unresolved", narrow=True)
    own = _only(texts, rows.select(F.col("rep").alias("id")).distinct())
    sets = own.select(F.col("id").alias("rep"), F.arrow_udf(_sets, "binary")("text").alias("set"))
    sets = stage(sets, "sets")
    links = _grouped(rows, classes.join(sets, "rep"), "bands", "set").mapInArrow(_linker(True, how), "a bigint, b bigint").distinct()
    good = stage(links, "verified", narrow=True)
    return _relabelled(labels, good) if good.limit(1).count() else labels


def _unresolved(member: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (bucket, members, rep, component) of buckets that hold several components."""
    named = member.select("bucket", "members", "rep").join(labels, member["rep"] == labels["node"], "left")
    named = named.select("bucket", "members", "rep", F.coalesce("component", "rep").alias("component"))
    split = named.groupBy("bucket").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 != c2").select("bucket")
    return named.join(split, "bucket")


def _grouped(rows: DataFrame, classes: DataFrame, *more: str) -> DataFrame:
    """Rows with what classes know of them, together by bucket and, in large buckets, by pair of blocks."""
    blocks = F.ceil(F.col("members") / F.lit(BLOCK)).cast("int")
    mixed = rows.join(classes.select("rep", "n", "sig", *more), "rep")
    mixed = mixed.withColumn("block", F.pmod(F.hash("rep"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    mixed = mixed.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "rep", "component", "n", "sig", *more)
    return mixed.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")


def _few(ids: DataFrame) -> DataFrame:
    """Staged ids, broadcast in joins while they are few."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


@scoped
def near_duplicates(documents: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of ``documents`` (doc_id, text).

    Shingles are five words between white space of ASCII, A-Z lowered; fewer words are one shingle as a whole; a null
    or wordless text has none and is linked with nothing. component_id is the smallest doc_id reached over links of
    ``similarity`` hundredths or more; kept says that it is the row's own. doc_id identifies a document: of rows that repeat it
    the one with the least text, in the order of its bytes and null as empty, is compared, and all of them are answered as that one. A row with
    a null doc_id is compared with nothing, has a null component and is kept. An empty table gives an empty result. Other
    columns are not read.
    """
    prepare_workers(documents.sparkSession)
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    repeated = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    repeated = stage(repeated, "repeated-ids", narrow=True)
    if not repeated.limit(1).count():
        return _answers(rows, scheme(similarity))
    again = rows.join(_few(repeated), "doc_id", "left_semi")
    one = stage(again.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "one-per-id")
    out = _answers(rows.join(_few(repeated), "doc_id", "left_anti").unionByName(one), scheme(similarity))
    out = stage(out, "answers")
    answer = stage(out.join(_few(repeated), "doc_id", "left_semi"), "repeated-answers", narrow=True)
    return out.join(_few(repeated), "doc_id", "left_anti").unionByName(again.select("doc_id").join(_few(answer), "doc_id"))


def _answers(documents: DataFrame, how: Scheme) -> DataFrame:
    """What near_duplicates says of (doc_id, text), where an id is null or stands once."""
    sketch = F.arrow_udf(_sketch(how), SKETCH)
    rows = documents.select("doc_id", sketch(F.coalesce("text", F.lit(""))).alias("s")).select("doc_id", "s.*")
    rows = stage(rows, "sketches")
    keyed = ["n", "f1", "f2"]
    known = rows.filter("n > 0 AND doc_id IS NOT NULL")
    owner = stage(known.groupBy(*keyed).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    classes = known.withColumnRenamed("doc_id", "rep").join(owner.select("rep"), "rep", "left_semi").select("rep", "n", "sig", "bands")
    texts = documents.select(F.col("doc_id").alias("id"), "text").filter("text IS NOT NULL")
    labels = links_between(stage(classes, "representatives"), texts, how)
    named = owner.join(labels, owner["rep"] == labels["node"], "left").select(*keyed, "rows", F.coalesce("component", "rep").alias("component"))
    # hot classes are few: those of more than a thousandth of the rows
    total = rows.count()
    hot = stage(named.filter(F.col("rows") * 1000 > total).select(*keyed, "component"), "hot-classes", narrow=True)
    narrow = rows.select("doc_id", *keyed)
    few = narrow.join(F.broadcast(hot), keyed)
    rest = narrow.join(F.broadcast(hot), keyed, "left_anti").join(named.select(*keyed, "component"), keyed, "left")
    out = few.unionByName(rest).withColumn("component", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    kept: Column = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"), F.when(F.col("doc_id").isNull(), True).otherwise(kept).alias("kept"))


@scoped
def keep_one(documents: DataFrame, similarity: int = STAGE_SIMILARITY) -> DataFrame:
    """The documents that stand for their component over links of ``similarity`` hundredths or more, with their own columns.

    One row of each component stays, that with the smallest doc_id. Rows whose doc_id is null or stands in several rows are
    numbered after the largest id, so that each is compared as a document of its own, and stay only where no row before them is a near copy.
    Texts are not shuffled where the dropped ids are few.
    """
    key = "weftline__id"
    rows = documents.withColumn(key, F.col("doc_id").cast("bigint"))
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(f"n > 1 AND {key} IS NOT NULL").select(F.col(key).alias("weftline__again"))
    repeated = stage(repeated, "repeated-ids", narrow=True)
    if repeated.limit(1).count() or rows.filter(f"{key} IS NULL").limit(1).count():
        last = rows.agg(F.max(key)).first()[0] or 0
        again = rows[key].isNull() | F.col("weftline__again").isNotNull()
        marked = rows.join(_few(repeated), F.col(key) == F.col("weftline__again"), "left").withColumn("weftline__again", again)
        unclear = marked.filter("weftline__again").drop("weftline__again").withColumn(key, F.monotonically_increasing_id() + F.lit(max(0, last + 1)))
        rows = marked.filter("NOT weftline__again").drop("weftline__again").unionByName(stage(unclear, "unclear-ids"))
    gone = stage(near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), similarity).filter("NOT kept").select(F.col("doc_id").alias("weftline__gone")).distinct(), "dropped", narrow=True)
    return rows.join(_few(gone), F.col(key) == F.col("weftline__gone"), "left_anti").drop(key)

"""Exact deduplication against a persistent digest index.

The index is Parquet tables bucketed and sorted by digest. A batch is reduced to one row per digest, anti-joined with
the index (sort-merge joins whose index side needs neither exchange nor sort) and what is new is appended.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.staging import new_path, scoped, stage

#: The characters of [\x20\x09-\x0D].
WHITE_SPACE = " \t\n\x0b\x0c\r"

INDEX_COLUMNS = "digest BINARY, keep_id BIGINT, keep_chars BIGINT, group_size BIGINT"

#: Runs of an index beyond which they are merged.
MOST_RUNS = 4
SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"

#: A digest held by more than one row in this many is a hot group. There are fewer such groups than this number, whatever the input.
HOT_SHARE = 1000


def normalised(text: Column) -> Column:
    """The text without white space of ASCII; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


class DigestIndex:
    """Digests seen so far, with the document that stands for each.

    ``path`` outlives the session: opening the same path again finds the same index. It holds runs, each a table in the same
    buckets with one file a bucket, sorted by digest, so that joins with a run move and sort nothing of it. An append writes
    a run of what no run has; more than MOST_RUNS are merged into one. A run counts once it is whole, so that an append that fails leaves the index as it
    was. ``buckets`` is fixed when the index is made; see ``buckets_for``. ``close`` takes the runs' tables out of the session's catalog.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path = spark, path
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        made = [int(n.split("=")[1]) for n in names if n.startswith("_buckets=")]
        if not made:
            made = [buckets or spark.sparkContext.defaultParallelism]
            self._fs.create(self._path(f"{path}/_buckets={made[0]}")).close()
        if buckets not in (None, made[0]):
            raise ValueError(f"the index at {path} has {made[0]} buckets, not {buckets}")
        self.buckets = made[0]
        self.runs: dict[str, str] = {}  # the table of each run
        for name in sorted(n for n in names if n.startswith("run-")):
            if self._fs.exists(self._path(f"{path}/{name}/_SUCCESS")):
                self._open(name)

    def _open(self, name: str) -> str:
        self.runs[name] = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {self.runs[name]} ({INDEX_COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
        )
        return self.runs[name]

    def close(self) -> None:
        """Takes the runs out of the catalog; their files, and results that read them, stay."""
        for name in list(self.runs):
            self.spark.sql(f"DROP TABLE {self.runs.pop(name)}")

    def read(self) -> DataFrame:
        empty = self.spark.createDataFrame([], INDEX_COLUMNS)
        return reduce(DataFrame.unionByName, [self.spark.table(t) for t in self.runs.values()], empty)

    def dealt(self, rows: DataFrame) -> DataFrame:
        """Rows in the tasks of their digests' buckets, the one exchange that a join with the runs needs."""
        return rows.repartition(self.buckets, "digest")

    def fresh(self, groups: DataFrame) -> DataFrame:
        """The groups whose digests no run has, by sort-merge joins that read each run bucket by bucket, as it is sorted."""
        out = self.dealt(groups)
        for t in self.runs.values():
            out = out.join(self.spark.table(t).select("digest").hint("merge"), "digest", "left_anti")
        return out

    def known(self, rows: DataFrame) -> DataFrame:
        """The rows with keep_id and group_size of the run that has their digest; rows of no run go."""
        dealt = self.dealt(rows)
        found = [dealt.join(self.spark.table(t).select("digest", "keep_id", "group_size").hint("merge"), "digest") for t in self.runs.values()]
        return reduce(DataFrame.unionByName, found)

    @contextmanager
    def sorted_scans(self) -> Iterator[None]:
        """Within it, plans rely on the order of bucket files. Spark does not by default, as listing them to see that there is one a bucket has a price."""
        before = self.spark.conf.get(SORTED_SCANS)
        self.spark.conf.set(SORTED_SCANS, "true")
        try:
            yield
        finally:
            self.spark.conf.set(SORTED_SCANS, before)

    def append(self, groups: DataFrame) -> None:
        """Adds the groups whose digests are not in the index, as a run; then merges runs if there are many."""
        with self.sorted_scans():
            self._write(self.fresh(groups))
        if len(self.runs) > MOST_RUNS:
            self.merge()

    def _write(self, rows: DataFrame) -> None:
        last = max([int(n.split("-")[1]) for n in self.runs], default=0)
        while True:
            last += 1
            name = f"run-{last:08d}"
            if not self._fs.exists(self._path(f"{self.path}/{name}")):
                break
        table = self._open(name)
        rows.sortWithinPartitions("digest").select(self.spark.table(table).columns).write.insertInto(table)
        self.spark.catalog.refreshTable(table)

    def merge(self) -> None:
        """Puts all runs into one; bucket by bucket, without an exchange between machines of what lies in a bucket already."""
        old = dict(self.runs)
        self._write(self.dealt(self.read()))
        for name, table in old.items():
            self.spark.sql(f"DROP TABLE {table}")
            del self.runs[name]
            self._fs.delete(self._path(f"{self.path}/{name}"), True)


def buckets_for(spark: SparkSession, rows: int) -> int:
    """Buckets of a million digests at most, a power of two, and enough for all cores."""
    return 1 << max(spark.sparkContext.defaultParallelism, rows // 1_000_000).bit_length()


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_chars) of each row; the texts themselves are never shuffled."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return documents.select(
        F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
        F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
        F.char_length(text).cast("bigint").alias("n_chars"),
    )


def groups_of(rows: DataFrame) -> DataFrame:
    """One row per digest: the longest original text stays, then the smallest doc_id. Partial sums make hot groups small before the shuffle."""
    best = F.max(F.struct(F.col("n_chars"), F.bitwise_not("doc_id").alias("not_id"))).alias("best")  # falls where the id rises, for all ids
    return (
        rows.groupBy("digest")
        .agg(best, F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.bitwise_not("best.not_id").alias("keep_id"), F.col("best.n_chars").alias("keep_chars"), "group_size")
    )


@scoped
def exact_dedup(documents: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds a batch to the index and says of each of its rows which document stands for its text.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. Null texts and texts of white space
    alone are one group, that of the empty text. A row whose digest was in the index before has the keep_id and the
    group_size of then, and is not kept. Rows that repeat the winner's doc_id are all kept: doc_id identifies a document.
    A row with a null doc_id stands for its group only if no other row does; then keep_id is null and kept is false. An
    empty table gives an empty result. Columns besides the two named are not read.

    The digests are staged once. Groups of more than a thousandth of the rows, under a thousand by count, are joined by
    broadcast; for the rest no key has more than a thousandth of the rows.
    """
    rows = stage(digests(documents, id_col, text_col), "digests")
    groups = stage(groups_of(rows), "groups")
    index.append(groups)
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = stage(groups.filter(F.col("group_size") * HOT_SHARE > total).select("digest"), "hot-digests", narrow=True)
    few = index.read().select("digest", "keep_id", "group_size").join(F.broadcast(hot), "digest", "left_semi")
    is_hot = rows.join(F.broadcast(few), "digest", "inner")
    others = index.known(rows.join(F.broadcast(hot), "digest", "left_anti"))
    columns = ["doc_id", "keep_id", "group_size", "digest"]
    return (
        is_hot.select(columns)
        .unionByName(others.select(columns))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def fresh_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """An empty index in the shared folder, deleted with what is staged there."""
    return DigestIndex(spark, new_path(spark, "digest-index"), buckets)

"""Encoding and decoding with a sentencepiece model, by a table of distinct chunks.

Where no piece of a model holds a marker of white space behind another character, no piece crosses from a word to the marker after
it. A text then falls into chunks, each of markers and a word, whose pieces do not depend on what stands around them.
Each distinct chunk is segmented once; texts are put together from the ids of their chunks by position.

The texts are read once. A unit of them, whole texts of UNIT_BYTES together, leaves its texts as numbers of
distinct chunks, the most frequent ones first, and these chunks, packed, in buckets by their hash. A bucket holds the chunks of all
units that hash to it and segments them; the answers go back to the unit that asked. As a unit asks for a chunk once,
a chunk is at most one of a unit's distinct chunks in all requests, however frequent it is in the texts. Units are
staged by unit, so that only the packed requests and answers are shuffled, not the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.staging import new_path, prepare_workers, scoped
from weftline.llm.textvec import chunks, mix, release

#: Fixed value: the marker that stands for a space.
MARKER = "▁"
#: Bytes of text of which the distinct chunks are listed together; a longer text is a unit alone.
UNIT_BYTES = 1 << 25
#: Bytes of text that are split into chunks at a time, but for a longer text, and ids that are put together at a time.
SPLIT_BYTES, JOINED_IDS = 1 << 22, 1 << 20
#: Most units of a task.
UNITS = 1 << 20

#: Texts on which a model must show that chunks are independent of each other.
_PROBES = ["a", " a", "  a  b ", "a   b", "one two  three", " \n\n x\ty ", "ａ b 　c", "é ﬁ ½", "<s> a</s> <unk>", f"a{MARKER}b {MARKER} c", "\u0000 \U0001f642  \U0001f642"]


@lru_cache(maxsize=2)
def processor(model: bytes) -> Any:
    """The model, once per worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def split(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(chunks, first): the chunks of all texts without their first marker, and the number of chunks before each text and at the end.

    A chunk begins where a marker follows another character, and where a text begins: there the library puts a marker.
    """
    n = len(data)
    marks = data == 0x20
    behind = np.zeros(n + 3, bool)
    behind[1 : n + 1] = marks
    wide = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if n > 2 else np.zeros(0, np.int64)
    marks[wide] = True
    behind[wide + 3] = True
    begins = np.zeros(n, bool)
    begins[offs[:-1][offs[:-1] < offs[1:]]] = True
    bound = marks & ~behind[:n] & ~begins
    starts = np.flatnonzero(bound | begins)
    kept = ~bound
    wide = wide[bound[wide]]
    kept[wide + 1] = kept[wide + 2] = False
    cut = np.concatenate([[0], np.cumsum(kept)])
    ends = cut[np.append(starts, n)].astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[kept])]), np.searchsorted(starts, offs)


def segment(words: list[bytes], model: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, sizes) of chunks given without their first marker, which the library puts before them again."""
    p = processor(model)
    alone = p.encode("a ")[len(p.encode("a")) :]  # a marker and nothing behind it
    each = p.encode([w.decode() for w in words], num_threads=1) if words else []
    each = [ids if w else alone for ids, w in zip(each, words, strict=True)]
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    return np.fromiter((i for ids in each for i in ids), np.uint32, int(sizes.sum())), sizes


def check(model: bytes) -> None:
    """ValueError unless chunks of a text are independent under the model."""
    p = processor(model)
    pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
    crossing = [x for x in pieces if MARKER in x.lstrip(MARKER)]
    for text in _PROBES:
        raw = np.frombuffer(text.encode(), np.uint8)
        ids, _ = segment(split(raw, np.array([0, len(raw)]))[0].to_pylist(), model)
        if crossing or ids.tolist() != p.encode(text):
            raise ValueError(f"pieces of this model cross markers of white space, or it does not put one before a text: {crossing[:3] or text!r}")


def pack(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32, byte by byte of the same place, compressed."""
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpack(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def gather(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``first`` and have ``sizes``, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)]


def before(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])[:-1]


def _bucket(words: pa.Array, n: int) -> np.ndarray:
    """The bucket of each chunk, by its length and its bytes."""
    offs = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offs)
    place = (np.arange(offs[0], offs[-1]) - np.repeat(offs[:-1], sizes)).astype(np.uint64)
    each = np.zeros(offs[-1] - offs[0] + 1, np.uint64)
    np.cumsum(mix(data[offs[0] : offs[-1]].astype(np.uint64) + (place << np.uint64(8)) + np.uint64(1)), out=each[1:])
    return (mix(each[offs[1:] - offs[0]] - each[offs[:-1] - offs[0]] + sizes.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


TABLE = "unit BIGINT, bucket INT, doc_id BIGINT, ranks BINARY, words BINARY"
_TABLE = pa.schema([("unit", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("ranks", pa.binary()), ("words", pa.binary())])


def _tables(n_buckets: int, unit_bytes: int):
    """Batches of (doc_id, text) to rows of TABLE: a text's chunk numbers, and the requests of each unit and bucket."""

    def told(unit: int, parts: list[tuple[list, pa.Array, np.ndarray]]) -> pa.RecordBatch:
        coded = pa.concat_arrays([array for _, array, _ in parts]).dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        order = np.argsort(-np.bincount(code, minlength=len(words)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        rows, at = [], 0
        for ids, array, first in parts:
            rows += [(unit, None, i, pack(rank[code[at + a : at + b]]), None) for i, a, b in zip(ids, first[:-1], first[1:], strict=True)]
            at += len(array)
        words = words.take(pa.array(order))
        bucket = _bucket(words, n_buckets)
        by = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            own = by[cuts[k] : cuts[k + 1]]
            mine = words.take(pa.array(own)).to_pylist()
            sizes = pack(np.fromiter(map(len, mine), np.uint32, len(mine)))
            rows.append((unit, int(k), None, pack(np.diff(own, prepend=0)), len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(1).compress(b"".join(mine))))
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), _TABLE, strict=True)], schema=_TABLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, parts = TaskContext.get().partitionId() * UNITS, 0, []
        for given in batches:
            at = 0
            for data, offs in chunks(given.column(1), min(SPLIT_BYTES, unit_bytes)):
                if parts and held + len(data) > unit_bytes:
                    yield told(unit, parts)
                    unit, held, parts = unit + 1, 0, []
                    release()
                ids = given.column(0).slice(at, len(offs) - 1).to_pylist()
                at += len(ids)
                parts.append((ids, *split(data, offs)))
                held += len(data)
        if parts:
            yield told(unit, parts)
        release()

    return run


def _unpacked(words: bytes) -> tuple[np.ndarray, bytes]:
    n = int.from_bytes(words[:4], "little")
    return unpack(words[4 : 4 + n]), zstandard.ZstdDecompressor().decompress(words[4 + n :])


ANSWERS = "unit bigint, ranks binary, sizes binary, ids binary"


def _answers(model: bytes):
    """The requests of a bucket to the ids of their chunks; chunks that several units ask for are segmented once."""

    def run(table: pa.Table) -> pa.Table:
        asked = [_unpacked(w) for w in table.column("words").to_pylist()]
        sizes = [a.astype(np.int64) for a, _ in asked]
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(t for _, t in asked))])
        coded = array.dictionary_encode()
        code, at = coded.indices.to_numpy(zero_copy_only=False), 0
        ids, n = segment(coded.dictionary.to_pylist(), model)
        first, out = before(n), []
        for s in sizes:
            own = code[at : at + len(s)]
            at += len(s)
            out.append((pack(n[own]), pack(gather(ids, first[own], n[own]))))
        columns = [table.column("unit"), table.column("ranks"), pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())]
        return pa.Table.from_arrays(columns, names=["unit", "ranks", "sizes", "ids"])

    return run


ENCODED = "doc_id bigint, ids array<int>"


def _joined(end: list[int]):
    """The texts of a unit and the answers to its batches, to the ids of each text."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        told = [(np.cumsum(unpack(a).astype(np.int32)), unpack(n).astype(np.int64), unpack(i)) for a, n, i in zip(*[answers.column(c).to_pylist() for c in ("ranks", "sizes", "ids")], strict=True)]
        rank, sizes, ids = (np.concatenate([t[k] for t in told]) if told else np.zeros(0, np.int64) for k in range(3))
        n, first = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        n[rank], first[rank] = sizes, before(sizes)
        widths, parts = [np.zeros(1, np.int64)], []
        numbers = [unpack(x) for x in texts.column("ranks").to_pylist()]
        for own in _runs(numbers, JOINED_IDS):
            count = np.fromiter(map(len, own), np.int64, len(own))
            code = np.concatenate(own)
            width = np.diff(np.concatenate([[0], np.cumsum(n[code])])[np.concatenate([[0], np.cumsum(count)])]) + len(end)
            tail = np.cumsum(width)
            flat = np.empty(int(tail[-1]), np.int32)
            is_end = np.zeros(len(flat), bool)
            for k, i in enumerate(end):
                is_end[tail - len(end) + k] = True
                flat[tail - len(end) + k] = i
            flat[~is_end] = gather(ids, first[code], n[code])
            parts.append(flat)
            widths.append(width)
        offs = np.cumsum(np.concatenate(widths)).astype(np.int32)
        joined = pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))
        return pa.Table.from_arrays([texts.column("doc_id").combine_chunks(), joined], names=["doc_id", "ids"])

    return run


def _runs(arrays: list[np.ndarray], most: int) -> Iterator[list[np.ndarray]]:
    """Arrays in runs of so many values together; a longer one is a run alone."""
    held: list[np.ndarray] = []
    size = 0
    for x in arrays:
        if held and size + len(x) > most:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


def _staged(rows: DataFrame, buckets: int) -> DataFrame:
    """A table in the shared folder in buckets by unit, so that units are read where they are joined, and not moved."""
    spark: SparkSession = rows.sparkSession
    name = f"piece_units_{uuid.uuid4().hex}"
    rows.write.option("path", new_path(spark, "piece-units")).bucketBy(buckets, "unit").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return out


@scoped
def encode(
    documents: DataFrame,
    model: bytes,
    end: bool = True,
    buckets: int | None = None,
    unit_bytes: int = UNIT_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, ids) of each row: what the library's ``encode`` gives for the whole text, with the end id if wanted.

    ``model`` is the model file's content; it travels to the workers with the code. Models whose pieces can cross from a word to a
    marker of white space are refused. Null and empty texts have no ids but the end id; a text without white space is one chunk. Repeated
    rows and null ids are rows of their own. An empty table gives an empty result. Columns other than the two are not read.
    ``buckets``: into how many parts the distinct chunks fall, by default the session's shuffle partitions; one part is held by a task. The result
    depends neither on it nor on ``unit_bytes``.
    """
    check(model)
    spark = documents.sparkSession
    prepare_workers(spark)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(_tables(n, unit_bytes), TABLE)
    table = _staged(rows, n)
    answers = table.filter("bucket IS NOT NULL").select("unit", "bucket", "ranks", "words").groupBy("bucket").applyInArrow(_answers(model), ANSWERS)
    texts = table.filter("bucket IS NULL").select("unit", "doc_id", "ranks")
    return texts.groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_joined([processor(model).eos_id()] if end else []), ENCODED)


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """``encoded`` (doc_id, ids) with column text: what the library's ``decode`` gives for all ids of a row. Null ids give a null text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = processor(model)
        for batch in batches:
            texts = [None if ids is None else p.decode(ids.tolist()) for ids in batch.column(1).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], schema=schema)
        release()

    prepare_workers(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, f"{ENCODED}, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """The number of ids, and digests of the ids and of the decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )

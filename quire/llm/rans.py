"""Operator 3, token output: a static range asymmetric numeral system in independent interleaved blocks.

A written set is two tables in one folder. `symbols` holds the shared frequency table (id, freq); `blocks` holds a row for each
block: part, block, start (tokens of the part before it), n_tokens and `data`, the block itself. A block stands alone:

    magic "QRB1", u32 crc of the frequency table, u32 documents, u32 tokens, u32 lanes, u32 segments, u32 words,
    u32 crc of the decoded ids (little-endian u32), u32 crc of all that follows,
    documents x i64 doc_id, documents x u32 length, a null mask byte for each document,
    segments x (u32 first word, lanes x u64 state), words x u32

Token t belongs to lane t mod lanes. Each segment of SEGMENT tokens has a checkpoint (where its words begin and the lanes'
states), so segments decode in parallel; the last segment's lanes end in the state they were started with, which is checked too.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.tokens import tokenizer, vocabulary_path

MAGIC, HEAD = b"QRB1", struct.Struct("<4s8I")
BITS, LOW, LANES, SEGMENT, BLOCK = 20, 1 << 31, 512, 1 << 16, 1 << 18
BLOCKS = "part long, block long, start long, n_tokens long, data binary"


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**BITS, at least 1 where the count is not 0."""
    total, freq = counts.sum(), np.zeros(len(counts), dtype=np.int64)
    if not total:
        return freq
    seen = counts > 0
    freq[seen] = np.maximum(1, np.floor(counts[seen] * ((1 << BITS) / total)).astype(np.int64))
    off, order = (1 << BITS) - int(freq.sum()), np.argsort(-counts, kind="stable")
    if off > 0:
        freq[order[0]] += off
    for i in order:
        if off >= 0:
            break
        take = min(-off, int(freq[i]) - 1, max(1, int(freq[i]) // 8))
        freq[i] -= take
        off += take
    if off < 0:
        for i in order:
            take = min(-off, int(freq[i]) - 1)
            freq[i] -= take
            off += take
    return freq


class Coder:
    """Encodes and decodes blocks under one frequency table."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.crc = zlib.crc32(np.trim_zeros(freq, "b").astype("<u4").tobytes())
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = min(LANES, max(1, n))
        segments = -(-n // SEGMENT)
        state = np.full(lanes, LOW, dtype=np.uint64)
        words, marks = [], []  # both backwards
        count, bits, low32 = 0, np.uint64(BITS), np.uint64(32)
        for segment in range(segments - 1, -1, -1):
            part = ids[segment * SEGMENT : (segment + 1) * SEGMENT]
            for at in range((len(part) - 1) // lanes * lanes, -1, -lanes):
                row = part[at : at + lanes]
                f, x = self.freq[row], state[: len(row)]
                if not f.all():
                    raise ValueError("an id is not in the frequency table")
                full = x >= f << np.uint64(63 - BITS)
                if full.any():
                    out = x[full].astype(np.uint32)
                    words.append(out)
                    count += len(out)
                    x = np.where(full, x >> low32, x)
                q = x // f
                state[: len(row)] = (q << bits) + (x - q * f) + self.start[row]
            marks.append((count, state.copy()))
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        points = b"".join(struct.pack("<I", count - c) + s.astype("<u8").tobytes() for c, s in reversed(marks))
        nulls = bytes(d is None for d in doc_ids)
        body = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes() + nulls + points + stream.astype("<u4").tobytes()
        return HEAD.pack(MAGIC, self.crc, len(doc_ids), n, lanes, segments, count, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body

    def segment(self, n: int, lanes: int, state: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n ids from a checkpoint, and the states that it ends in."""
        out, at, state = np.empty(n, np.uint32), 0, state.copy()
        mask, bits, low32, low = np.uint64((1 << BITS) - 1), np.uint64(BITS), np.uint64(32), np.uint64(LOW)
        for i in range(0, n, lanes):
            x = state[: min(lanes, n - i)]
            slot = x & mask
            row = self.symbol[slot]
            out[i : i + len(row)] = row
            x = self.freq[row] * (x >> bits) + slot - self.start[row]
            need = x < low
            if k := int(np.count_nonzero(need)):
                x[need] = (x[need] << low32) | words[at : at + k]
                at += k
            state[: len(row)] = x
        return out, state

    def decode(self, data: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
        magic, table, docs, n, lanes, segments, count, ids_crc, crc = HEAD.unpack_from(data)
        body = memoryview(data)[HEAD.size :]
        if magic != MAGIC or table != self.crc or zlib.crc32(body) != crc:
            raise ValueError("a block is damaged or belongs to another frequency table")
        doc_ids = np.frombuffer(body, "<i8", docs).tolist()
        lengths = np.frombuffer(body, "<u4", docs, 8 * docs).tolist()
        doc_ids = [None if gone else d for d, gone in zip(doc_ids, body[12 * docs : 13 * docs], strict=True)]
        at = 13 * docs
        points = []
        for _ in range(segments):
            points.append((struct.unpack_from("<I", body, at)[0], np.frombuffer(body, "<u8", lanes, at + 4)))
            at += 4 + 8 * lanes
        words = np.frombuffer(body, "<u4", count, at)
        parts = []
        for k, (first, state) in enumerate(points):
            ids, last = self.segment(min(SEGMENT, n - k * SEGMENT), lanes, state, words[first:])
            if not (last == (points[k + 1][1] if k + 1 < segments else LOW)).all():
                raise ValueError("a segment does not end in the next checkpoint")
            parts.append(ids)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if zlib.crc32(ids.astype("<u4", copy=False)) != ids_crc:
            raise ValueError("decoded ids do not have their checksum")
        return doc_ids, lengths, ids


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.BinaryArray:
    """Runs of numbers, one after another, as a value each."""
    offsets = pa.array(data.itemsize * bounds).cast(pa.int32())  # an error beyond 2 GB
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(data))])


def _numbers(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers of all values (no nulls) in a row."""
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], "<i8")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]].view(kind)


def _tokenise(path: str, end_id: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for batch in common.large_batches(batches):
            ids, bounds = encoder.arrays(batch.column("text"))
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4" if wide else "<u2")
            data = _binary(ids, bounds + np.arange(len(bounds)))
            yield from common.small_batches([pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), data], ["doc_id", "ids"])], 1024)

    return run


def _count(size: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                n += np.bincount(_numbers(batch.column("ids"), "<u4" if wide else "<u2"), minlength=size)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["id", "n"])

    return run


def _write(freq: np.ndarray, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = Coder(freq), TaskContext.get().partitionId()
        held: list[tuple[int | None, np.ndarray]] = []
        block = start = size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, block, start, size
            ids = np.concatenate([x for _, x in held]).astype(np.uint32)
            data = coder.encode([d for d, _ in held], [len(x) for _, x in held], ids)
            row = [[part], [block], [start], [size]]
            held, block, start, size = [], block + 1, start + size, 0
            return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in row], pa.array([data], pa.binary())], ["part", "block", "start", "n_tokens", "data"])

        for batch in batches:
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(x, "<u4" if wide else "<u2")
                held.append((doc_id, ids))
                size += len(ids)
                if size >= BLOCK:
                    yield flush()
        if held:
            yield flush()

    return run


def _read(freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in common.small_batches(batches, 1):
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data").to_pylist(), strict=True):
                doc_ids, lengths, ids = coder.decode(data)
                bounds = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                ids = ids.astype("<u4", copy=False)
                crcs = [zlib.crc32(ids[a:b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + bounds[:-1], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), _binary(ids, bounds)],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return run


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 1) -> None:
    """Tokenise docs(doc_id, text), append end_id to each, and write ids in ascending doc_id order as a set in `folder`.

    Null texts are empty; a null doc_id comes first; equal doc_ids lie side by side in the order of their ids. An empty table
    writes an empty set. Texts are tokenised once; the ids are dealt by range of doc_id, so a part of the set is a range.
    """
    spark = docs.sparkSession
    size = max(tokenizer(path).tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    wide = size > 1 << 16
    ids = common.save(docs.select("doc_id", "text").mapInArrow(_tokenise(path, end_id, wide), "doc_id long, ids binary"), "rans-ids")
    counts = np.zeros(size, np.int64)
    for i, n in ids.mapInArrow(_count(size, wide), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row for each id of the vocabulary at most
        counts[i] = n
    freq = quantise(counts)
    spark.createDataFrame([(i, int(freq[i])) for i in np.flatnonzero(freq).tolist()], "id long, freq long").coalesce(1).write.parquet(f"{folder}/symbols")
    dealt = ids.repartitionByRange(common.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    dealt.mapInArrow(_write(freq, wide), BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each document of a set: doc_id, start, n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit), all checksums held."""
    table = spark.read.parquet(f"{folder}/symbols").collect()  # bounded by the vocabulary
    freq = np.zeros(max((r.id for r in table), default=-1) + 1, np.int64)
    for r in table:
        freq[r.id] = r.freq
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    # tokens before each part: a row for each part of the set
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return blocks.join(parts, "part").select((F.col("start") + F.col("before")).alias("start"), "data").mapInArrow(_read(freq), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op3_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.scratch(spark)}/quire/rans-{uuid.uuid4().hex}"
    write_tokens(common.documents(spark, sf_dir), vocabulary_path(), folder)
    return read_tokens(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")

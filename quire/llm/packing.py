"""Operator 1, best-fit packing: hierarchical residual packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common
from quire.llm.tokens import tokenizer, vocabulary_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, bin_offset long, bin_used long"
MERGED = "bin long, parent long, parent_offset long, parent_used long"
#: Bits of a bin's number that count within a task; above them the task, above that the round.
COUNTER, ROUND = 31, 56


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: bin and offset of each item, and what each bin holds in the end.

    Open bins are kept by free space, and a bit mask finds the tightest that still fits, so an item takes constant time.
    """
    bins, offsets, used = [0] * len(sizes), [0] * len(sizes), []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        if fits := mask >> size:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
        else:
            free, bin_ = capacity, len(used)
            used.append(0)
        bins[i], offsets[i] = bin_, used[bin_]
        used[bin_] += size
        if left := free - size:
            by_free[left].append(bin_)
            mask |= 1 << left
    return bins, offsets, used


def _first_bin(round_: int) -> int:
    return (round_ << ROUND) + (TaskContext.get().partitionId() << COUNTER)


def _local(path: str, capacity: int, end_id: int, items: int, words: int):
    """Tokenise a partition, cut what is longer than a bin, and pack chunks of at most `items` pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, base, held = tokenizer(path, words).encode, end_id.to_bytes(4, "little"), _first_bin(0), []

        def flush() -> pa.RecordBatch:
            nonlocal base, held
            bins, offsets, used = best_fit([x[3] for x in held], capacity)
            columns = [*zip(*held, strict=True), [base + b for b in bins], offsets, [used[b] for b in bins]]
            base, held = base + len(used), []
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 6]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "bin_offset", "bin_used"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in common.small_batches(batches, 1024):
            ids = encode(common.text_bytes(batch.column("text")))
            for doc_id, code in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                code += end
                for piece, at in enumerate(range(0, len(code), 4 * capacity)):
                    part = code[at : at + 4 * capacity]
                    held.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            del ids
            common.trim()  # what a batch took would add up in a worker that other stages left large
            if len(held) >= items:
                yield flush()
        if held:
            yield flush()

    return run


def _merge(capacity: int, round_: int, items: int):
    """One round: the underfull bins that reach a task are items, packed anew by best fit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held = _first_bin(round_), []

        def flush() -> pa.RecordBatch:
            nonlocal base, held
            bins, offsets, used = best_fit([x[1] for x in held], capacity)
            columns = [[x[0] for x in held], [base + b for b in bins], offsets, [used[b] for b in bins]]
            base, held = base + len(used), []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["bin", "parent", "parent_offset", "parent_used"])

        for batch in batches:
            held += zip(batch.column("bin").to_pylist(), batch.column("bin_used").to_pylist(), strict=True)
            if len(held) >= items:
                yield flush()
        if held:
            yield flush()

    return run


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, slack: int | None = None, fan_in: int = 8, items: int = 200_000, words: int = 1_000_000) -> DataFrame:
    """Pack every document of docs(doc_id, text) into sequences of at most `capacity` tokens.

    Each input partition packs its own pieces best-fit. Bins with at most `slack` tokens free (capacity / 128) are emitted; the
    others become items of the next round, in which `fan_in` partitions' bins meet in one, until they all met or a round no
    longer saves any. A task holds `items` items at once, so memory is bounded however many bins stay underfull; a worker remembers
    the tokens of up to `words` words.

    Returns a row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null text is empty; an empty text
    has one piece, its end id. Repeated rows are packed once each; a null doc_id stays null. An empty table gives no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    slack = capacity // 128 if slack is None else slack
    local = common.save(docs.select("doc_id", "text").mapInArrow(_local(path, capacity, end_id, items, words), PIECES), "pack")
    groups = local.agg(F.max(F.shiftright("bin", COUNTER))).first()[0]
    underfull = F.col("bin_used") < capacity - slack
    left = local.where(underfull & (F.col("bin_offset") == 0)).select("bin", "bin_used")
    groups, count, place, round_ = (groups or 0) + 1, left.count(), None, 0
    while count > 1:
        round_, groups = round_ + 1, max(-(-groups // fan_in), -(-count // items))
        group = F.pmod(F.shiftright("bin", COUNTER), F.lit(groups)) if round_ == 1 else F.pmod(F.xxhash64("bin"), F.lit(groups))
        dealt = left.repartition(groups, group).select("bin", "bin_used")
        merged = common.save(dealt.mapInArrow(_merge(capacity, round_, items), MERGED), "pack-merge")
        step = merged.select("bin", "parent", "parent_offset")
        if place is None:
            place = step
        else:
            up = step.select(F.col("bin").alias("parent"), F.col("parent").alias("top"), F.col("parent_offset").alias("more"))
            place = place.join(up, "parent", "left").select("bin", F.coalesce("top", "parent").alias("parent"), (F.col("parent_offset") + F.coalesce("more", F.lit(0))).alias("parent_offset"))
            place = common.save(place, "pack-place")
        left = merged.where(f"parent_offset = 0 AND parent_used < {capacity - slack}").select(F.col("parent").alias("bin"), F.col("parent_used").alias("bin_used"))
        before, count = count, merged.where("parent_offset = 0").count()
        alone = groups == 1 or count >= before * 0.999 and groups == -(-before // items)
        count = left.count()
        if alone:
            break
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if place is None:
        return local.select(*out, F.col("bin").alias("sequence_id"), F.col("bin_offset").alias("offset"))
    full = local.where(~underfull).select(*out, F.col("bin").alias("sequence_id"), F.col("bin_offset").alias("offset"))
    moved = local.where(underfull).join(place, "bin", "left")
    moved = moved.select(*out, F.coalesce("parent", "bin").alias("sequence_id"), (F.col("bin_offset") + F.coalesce("parent_offset", F.lit(0))).alias("offset"))
    return full.unionByName(moved)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir), vocabulary_path())

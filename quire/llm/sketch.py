"""Operator 6, document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm import common

#: Hashes that a sketch keeps, words of a shingle, bytes of a kept hash.
K, WIDTH, BYTES = 128, 5, 5
EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class Sketcher:
    """Sketches are ascending arrays of the k smallest different shingle hashes, cut to BYTES bytes.

    A sketch of fewer than k hashes holds all shingles of its text, so what it tells is exact.
    """

    def __init__(self, k: int = K, width: int = WIDTH):
        self.k, self.width, self.hashes = k, width, common.WordHashes()

    def sketch(self, text: bytes) -> np.ndarray:
        """Of a text: shingles of `width` words, or all words as one if it has fewer; none without words."""
        words = self.hashes.of(text.split())
        shingles = common.runs(words, min(self.width, max(1, len(words))))
        return np.unique(shingles >> np.uint64(64 - 8 * BYTES))[: self.k]

    def merge(self, *sketches: np.ndarray) -> np.ndarray:
        """The sketch of the union of the shingle sets."""
        return np.unique(np.concatenate(sketches))[: self.k]

    def distinct(self, sketch: np.ndarray) -> float:
        """Different shingles: exact below k, then estimated by the largest hash kept."""
        return float(len(sketch)) if len(sketch) < self.k else (self.k - 1) / ((int(sketch[-1]) + 1) / 2.0 ** (8 * BYTES))

    def resemblance(self, a: np.ndarray, b: np.ndarray) -> float:
        """Jaccard similarity of the shingle sets: of the k smallest hashes of the union, the share found in both. Two empty sets are alike."""
        both = np.sort(np.concatenate([a, b]), kind="stable")
        again = both[1:] == both[:-1]
        union = both[np.concatenate([[True], ~again])] if len(both) else both
        if not len(union):
            return 1.0
        n = min(self.k, len(union))
        return float(np.count_nonzero(both[1:][again] <= union[n - 1])) / n

    def containment(self, a: np.ndarray, b: np.ndarray) -> float:
        """The share of a's shingles found in b, from the resemblance and both counts; 1 if a is empty."""
        if not len(a):
            return 1.0
        r, na, nb = self.resemblance(a, b), self.distinct(a), self.distinct(b)
        return min(1.0, r * (na + nb) / (1 + r) / na)


def text_of(sketch: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(sketch.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 8 - BYTES :].tobytes()).decode()


def sketch_of(text: str) -> np.ndarray:
    rows = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, BYTES)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, 8 - BYTES :] = rows
    return out.reshape(-1).view(">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint and n_shingles (different ones, estimated above k) of docs(doc_id, text); null texts are empty. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(k, width)
        for batch in common.small_batches(batches):
            found = [sketcher.sketch(t) for t in common.text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(map(text_of, found), pa.string()), pa.array(map(sketcher.distinct, found), pa.float64())], ["doc_id", "fingerprint", "n_shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def merged(prints: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """The sketch of each group's union: keys, fingerprint, n_shingles, of prints(keys, fingerprint).

    The hashes are ranked among a group's different ones and the k smallest kept, so a group is aggregated by Spark's own partial
    steps and never stands in one task whole. A group without hashes has an empty fingerprint; null fingerprints count as empty.
    """
    blob = F.unbase64(F.coalesce("fingerprint", F.lit("")))
    each = F.explode_outer(F.expr(f"transform(sequence(1, greatest(1, length(__b) div {BYTES})), i -> substring(__b, (i - 1) * {BYTES} + 1, {BYTES}))"))
    hashes = prints.select(*keys, blob.alias("__b")).select(*keys, each.alias("__h")).groupBy(*keys, "__h").agg(F.lit(1).alias("__one"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(k)
        for batch in batches:
            found = [np.concatenate([sketch_of(base64.b64encode(x).decode()) for x in row if x] or [np.zeros(0, np.uint64)]) for row in batch.column("__all").to_pylist()]
            found = [np.unique(x)[:k] for x in found]
            rest = [batch.column(c) for c in keys]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(map(text_of, found), pa.string()), pa.array(map(sketcher.distinct, found), pa.float64())], [*keys, "fingerprint", "n_shingles"])

    lowest = hashes.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__h"))).where(F.col("__r") <= k + 1)  # one may be the empty hash
    gathered = lowest.groupBy(*keys).agg(F.collect_list("__h").alias("__all"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in prints.schema.fields if f.name in keys] + ["fingerprint string", "n_shingles double"])
    return gathered.select(*keys, "__all").mapInArrow(run, schema)


def chained(docs: DataFrame, parts: int) -> DataFrame:
    """docs(doc_id, text) cut into about `parts` ranges of doc_id, each with a copy of the text that follows its last row.

    Returns part, copy, doc_id, text, a part's rows lying together in order. Null ids come first, equal ids in order of text; after
    the last row follows the first. A range's cuts come from approximate quantiles, and the driver holds two numbers for each.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted(set(rows.where("doc_id IS NOT NULL").select("doc_id").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    part = F.lit(0)
    if cuts:
        rows = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="__id", outputCol="__part", handleInvalid="keep").transform(rows.withColumn("__id", F.col("doc_id").cast("double")))
        part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("__part").cast("int"))
    rows = rows.select(part.alias("part"), "doc_id", "text")
    heads = sorted(rows.groupBy("part").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("none")).collect())  # a row for each part
    before = [heads[i - 1].part for i in range(len(heads))]
    names = spark.createDataFrame([(None if h.none else h.least, p) for h, p in zip(heads, before, strict=True)], "head long, part int")
    copies = rows.select("doc_id", "text").join(F.broadcast(names), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("part").agg(F.min("text").alias("text"))
    both = rows.select("part", F.lit(0).alias("copy"), "doc_id", "text").unionByName(copies.select("part", F.lit(1).alias("copy"), F.lit(None).cast("long").alias("doc_id"), "text"))
    return both.repartitionById(max(1, len(cuts) + 1), F.col("part")).sortWithinPartitions("part", "copy", F.asc_nulls_first("doc_id"), "text")


def edits(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Each text of docs(doc_id, text) against its edited text and the next text, in ascending doc_id order (see chained()).

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next document. Null texts are
    empty: no hashes, an empty fingerprint, and a resemblance of 1 to another empty one and 0 to all others. A single row is its own
    next. An empty table gives no rows. Other columns are not read. Two texts are in memory at a time, besides a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, out = Sketcher(k, width), []

        def close() -> pa.RecordBatch:
            nonlocal out
            columns = [*zip(*out, strict=True)]
            out = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [x.split()[0] for x in EDITED.split(", ")]
        held = None  # part, doc_id, text, its sketch
        for batch in common.small_batches(batches):
            for part, copy, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("part", "copy", "doc_id", "text")], strict=True):
                own = sketcher.sketch(text.encode())
                if held is not None and held[0] == part:
                    _, before, old, sketch = held
                    n = len(old)
                    edited = (old[: n - n // 4] + text[: n // 4]).encode()
                    other = sketcher.sketch(edited)
                    out.append((before, n, hashlib.sha256(edited).hexdigest(), text_of(sketch), text_of(other), sketcher.resemblance(sketch, other), sketcher.resemblance(sketch, own)))
                held = None if copy else (part, doc_id, text, own)
                if len(out) >= 512:
                    yield close()
        if out:
            yield close()

    return chained(docs, common.partitions(docs.sparkSession)).mapInArrow(run, EDITED)


def op6_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(common.documents(spark, sf_dir))

"""What the operators share: the shared scratch folder, cutting of lineage, Arrow batches, graph components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: [\x20\x09-\x0D], which is also what bytes.split() splits at.
SPACE = r"[\x20\x09-\x0D]+"


#: Rows and bytes of a batch that goes to a Python worker, at most: texts may be long, and both sides hold a batch.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2048, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}
#: This process's folder in the shared one, and the tables it has there.
_OWN, _saved = uuid.uuid4().hex, []


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; a temporary one of our own only where that is unset, on one machine. What is left of our tables is deleted when the driver's process ends."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))  # workers import this package, from wherever the driver runs
    for name, most in ARROW.items():
        now = spark.conf.get(name).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: executors need a folder that all of them share")
        root = "file://" + tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and return its reader: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/quire/{_OWN}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _saved:
        atexit.register(sweep, spark)
    _saved.append(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, but: DataFrame | None = None) -> None:
    """Delete the tables saved so far, but those that `but` reads: only where no other DataFrame made of them is still wanted."""
    kept = {f.rsplit("/", 2)[-2] for f in but.inputFiles()} if but is not None else set()
    for path in [p for p in _saved if p.rsplit("/", 1)[-1] not in kept]:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # noqa: BLE001  at the process's end the JVM may be gone already
            return
        _saved.remove(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps; it acts on what the JVM's collector finds unreachable."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def large_batches(batches: Iterator[pa.RecordBatch], size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined up to `size` bytes, for what costs less a row the more rows there are; a larger one stays alone."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and sum(x.nbytes for x in held) + batch.nbytes > size:
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


#: What worker processes keep from task to task, as a memory of words.
CACHES: list[dict] = []


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function of mapInArrow that first drops what tasks of other stages kept, and gives the memory of its own batches and tables back when its task ends: workers are used again."""

    def leanly(batches: Iterator) -> Iterator:
        if any(CACHES):
            for cache in CACHES:
                cache.clear()
            trim()
        try:
            yield from run(batches)
        finally:
            trim()

    return leanly


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


class WordHashes(dict):
    """XXH64 of each word, with a memory of the first `words` short ones that were met (under 25 MB)."""

    def __init__(self, words: int = 150_000, seed: int = 42):
        from xxhash import xxh64_intdigest

        super().__init__()
        self.words, self.seed, self.digest = words, seed, xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        value = self.digest(word, self.seed)
        if len(self) < self.words and len(word) <= 48:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(words: np.ndarray, width: int, salt: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hashes of all runs of `width` word hashes: a sum with an odd multiplier for each place, which `salt` gives, mixed."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += words[j : j + n] * np.uint64((salt * (2 * j + 1) ^ j << 7) & (1 << 64) - 1 | 1)
    return mixed(out)


def min_labels(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of undirected (a, b) long pairs: rows (node, root) with root the smallest node of the component.

    Alternating large-star and small-star steps; each is a partially aggregated minimum and an equi-join, so a hub never meets
    in one task. Nulls and loops are dropped; the result has no row for a node without an edge to another.
    """
    spark = edges.sparkSession
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = save(both, name)
    while True:
        undirected = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = undirected.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = undirected.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = save(large.where("u <> v").distinct(), name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        after = save(small.select("x.u", "x.v").where("u <> v").distinct(), name)
        # a star forest: every node has one parent, and no parent has one
        odd = after.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u").union(after.join(after.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi").select("v"))
        now = after
        if odd.isEmpty():
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Rows of one or two longs that may be broadcast: 16 MB at most.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame) -> DataFrame:
    """df, to be broadcast where its counted rows (a few longs each) stay under BROADCAST_ROWS; else joins shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Groups of rows that may be sent to all tasks, however many rows there are: a few longs or a hash each, 16 MB at most.
HOT_GROUPS = 100_000


def looked_up(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows with the columns of groups (a row for each group of rows by `keys`, `size` the number of its rows), null where there is none.

    Of N rows in groups, at most HOT_GROUPS groups have N / HOT_GROUPS rows or more, so the large groups are sent and their rows
    stay where they are; what is left is joined by a shuffle in which no key has more rows than that. Rows with a null key go past both.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) >= max(1, -(-total // HOT_GROUPS))
    found = rows.join(F.broadcast(groups.where(hot)), keys, "left")
    if groups.where(~hot).isEmpty():
        return found
    alone = F.col(size).isNull()
    for key in keys:
        alone &= F.col(key).isNotNull()
    rest = found.where(alone).select(rows.columns).join(groups.where(~hot), keys, "left").select(found.columns)
    return found.where(~alone).unionByName(rest)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in ids(doc_id), all columns; rows with a null doc_id stay."""
    return docs.join(bounded(save(ids.select("doc_id"), "dropped")), "doc_id", "left_anti").select(docs.columns)

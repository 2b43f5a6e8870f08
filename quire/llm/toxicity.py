"""Operator 9, toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

#: Labelled rows of each class that are examples (the bound of what is fitted), neighbours that vote, examples of a block.
SAMPLE, NEIGHBOURS, BLOCK = 4000, 15, 64
#: A term of over one SHORT-th of the examples (and of over SHORT) is frequent.
SHORT = 32
#: Axes along which frequent terms are bounded, and what rounding to single precision can take away at most.
AXES, SLACK = 128, 1e-5
#: Queries that are bounded at once, and the places of a block's examples.
TURN, INSIDE = 64, np.arange(BLOCK)
#: Weight of the prior beside the neighbours' similarities.
PRIOR = 1.0
#: Standard errors by which a term's rates in the two classes may differ before it weighs more.
CHANCE = 2.0
#: To blank all ASCII that is no letter or digit; texts are lower-cased before.
TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SCORED = "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,toxic:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().translate(TABLE).split()


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from; those without an id as well."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def examples_of(labels: DataFrame, docs: DataFrame, size: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of at most `size` labelled rows a class that may be learnt from, lowest by a hash of doc_id, and how many there are of each."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    usable = common.save(usable, "toxic-usable")
    totals = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    lowest = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size) for y in (0, 1)]
    sample = common.save(lowest[0].unionByName(lowest[1]), "toxic-sample")
    texts = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))  # 2 * SAMPLE ids are sent
    return common.save(texts, "toxic-examples"), totals


class Examples:
    """The examples' vectors: example i has the terms `term[begin[i] : begin[i + 1]]`, `tf` times each. Terms number the different words."""

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, begin: np.ndarray, term: np.ndarray, tf: np.ndarray, words: list[bytes]):
        self.ids, self.toxic, self.begin, self.term, self.tf, self.words = ids, toxic, begin, term, tf, words

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.begin[i], self.begin[i + 1])
        return self.term[part], self.tf[part]


def vectors(texts: DataFrame) -> Examples:
    """The vectors of (doc_id, toxic, text); as much as the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            found = [Counter(words_of(t)) for t in common.text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([[*c] for c in found], pa.list_(pa.binary())), pa.array([[*c.values()] for c in found], pa.list_(pa.int32()))], ["doc_id", "toxic", "words", "tf"])

    rows = texts.mapInArrow(common.lean(run), "doc_id long, toxic int, words array<binary>, tf array<int>").toArrow().sort_by("doc_id").combine_chunks()
    if not rows.num_rows:
        return Examples(np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), [])
    words, tf = (rows.column(c).combine_chunks() for c in ("words", "tf"))
    words, tf = (x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in (words, tf))
    sizes = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    return Examples(rows.column("doc_id").to_numpy(), rows.column("toxic").to_numpy().astype(np.int8), np.concatenate([[0], np.cumsum(sizes)]), coded.indices.to_numpy(), tf.flatten().to_numpy(), coded.dictionary.to_pylist())


class Vocabulary:
    """The words of the examples, sent as one text and numbered in each worker."""

    def __init__(self, words: list[bytes]):
        self.text, self.n = b" ".join(words), len(words)

    def numbers(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.text.split())}


def frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """How many texts there are, and in how many each word of the vocabulary stands: one narrow pass, summed by word."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, counts, texts = sent.value.numbers(), np.zeros(sent.value.n + 1, np.int64), 0
        for batch in common.small_batches(batches):
            found = chain.from_iterable(map(number.get, set(words_of(text)), repeat(-1)) for text in common.text_bytes(batch.column("text")))
            counts += np.bincount(np.fromiter(found, np.int64) + 1, minlength=len(counts))
            texts += batch.num_rows
        counts = np.append(counts[1:], texts)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen])], ["word", "n"])

    found = docs.select("text").mapInArrow(common.lean(run), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()  # a row for each word of the examples
    out = np.zeros(vocabulary.n + 1, np.int64)
    out[found.column("word").to_numpy()] = found.column("n").to_numpy()
    sent.destroy()
    return int(out[-1]), out[:-1]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Index:
    """A block-max inverted index of unit vectors, examples in blocks of BLOCK. Weights are kept in single precision.

    Terms of few examples have postings, which a query reads. Terms of over a SHORT-th of the examples have low idf and long lists, so
    they are kept as rows of a matrix that is read for examples that can still be among the nearest only: what an example's frequent
    part can add is bounded by its product along the AXES main axes of that matrix and, by Cauchy-Schwarz, by the lengths of what lies
    across them. Blocks are read from the largest bound on, until none reaches the least of the best scores found, so the nearest are
    exact. The size of all is that of the examples' texts.
    """

    def __init__(self, examples: Examples, weights: np.ndarray, other: float = 0.0):
        self.weights, self.other = weights, other
        n, sizes = len(examples.ids), np.diff(examples.begin)
        row = np.repeat(np.arange(n), sizes)
        weight = (1 + np.log(examples.tf)) * weights[examples.term]
        weight /= np.maximum(np.sqrt(np.bincount(row, weight**2, n)), 1e-300)[row]
        # examples that share their heaviest term lie together, so a block's bounds are tight
        heaviest = np.full(n, -1)
        sort = np.lexsort((weight, row))
        last = np.cumsum(sizes)[sizes > 0] - 1
        heaviest[sizes > 0] = examples.term[sort[last]]
        order = np.lexsort((examples.ids, heaviest))
        self.ids, self.toxic = examples.ids[order], examples.toxic[order]
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        at, count = place[row], np.bincount(examples.term, minlength=len(weights))
        frequent = np.flatnonzero(count > max(SHORT, n // SHORT))
        self.column = np.full(len(weights), -1, np.int32)
        self.column[frequent] = np.arange(len(frequent))
        dense = self.column[examples.term] >= 0
        self.matrix = np.zeros((n, len(frequent)), np.float32)
        self.matrix[at[dense], self.column[examples.term[dense]]] = weight[dense]
        self.axes = np.linalg.eigh((self.matrix.T @ self.matrix).astype(float))[1][:, -AXES:].astype(np.float32) if len(frequent) else np.zeros((0, 0), np.float32)
        self.along = self.matrix @ self.axes
        self.across = np.sqrt(np.maximum(0, np.square(self.matrix).sum(1) - np.square(self.along).sum(1)) + SLACK).astype(np.float32)
        at, term, weight = at[~dense], examples.term[~dense], weight[~dense]
        sort = np.lexsort((at, term))
        self.at, self.weight = at[sort].astype(np.int32), weight[sort].astype(np.float32)
        self.begin = np.searchsorted(term[sort], np.arange(len(weights) + 1)).astype(np.int32)
        self.starts = np.arange(0, n, BLOCK)

    def unit(self, terms: np.ndarray, tf: np.ndarray, others: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Terms and weights of a vector of length 1; `others` is the sum of (1 + log tf)^2 of its words that no example has."""
        t = np.asarray(terms, np.int64)
        w = (1 + np.log(np.asarray(tf, float))) * self.weights[t]
        return t, w / max(math.sqrt(float(w @ w) + others * self.other**2), 1e-300)

    def nearest(self, queries: list[tuple], k: int = NEIGHBOURS, but: list[int | None] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and cosines of the k nearest of positive cosine of each (terms, tf, others), ties by doc_id; `but` leaves out the example of that id.

        Queries are bounded TURN at a time, by one product of matrices.
        """
        for start in range(0, len(queries), TURN):
            units = [self.unit(*q) for q in queries[start : start + TURN]]
            dense = np.zeros((len(units), self.matrix.shape[1]), np.float32)
            columns = [self.column[t] for t, _ in units]
            for i, (column, (_, w)) in enumerate(zip(columns, units, strict=True)):
                dense[i, column[column >= 0]] = w[column >= 0]
            along = dense @ self.axes
            across = np.sqrt(np.maximum(0, np.square(dense).sum(1) - np.square(along).sum(1)) + SLACK)
            bounds = along @ self.along.T
            for i, (t, w) in enumerate(units):
                rare = columns[i] < 0
                yield self._nearest(t[rare], w[rare], dense[i], bounds[i], float(across[i]), k, but[start + i] if but else None) if len(t) and len(self.ids) else (np.zeros(0, np.int64), np.zeros(0))

    def _nearest(self, t: np.ndarray, w: np.ndarray, dense: np.ndarray, bound: np.ndarray, across: float, k: int, but: int | None) -> tuple[np.ndarray, np.ndarray]:
        n = self.begin[t + 1] - self.begin[t]
        some = _ranges(self.begin[t], n)
        out = np.bincount(self.at[some], self.weight[some] * np.repeat(w.astype(np.float32), n), len(self.ids)).astype(np.float32)
        bound += out
        bound += self.across * np.float32(across) + np.float32(SLACK)
        best = np.maximum.reduceat(bound, self.starts)
        order = np.argsort(-best, kind="stable")
        read, least, step, hits = 0, 0.0, 4, []
        while read < len(order) and best[order[read]] >= least:
            inside = (self.starts[order[read : read + step], None] + INSIDE).reshape(-1)
            inside = inside[inside < len(bound)]
            now = inside[bound[inside] >= least]
            out[now] += self.matrix[now] @ dense
            hits.append(now)
            read, step = read + step, 2 * step
            found = np.concatenate(hits)
            if len(found) > k:
                least = max(0.0, float(np.partition(out[found], -k - 1)[-k - 1]))  # one more, for the example left out
        hits = np.concatenate(hits)
        hits = hits[out[hits] >= max(least - 1e-6, 1e-7)]
        if but is not None:
            hits = hits[self.ids[hits] != but]
        hits = hits[np.lexsort((self.ids[hits], -np.round(out[hits], 6)))][:k]
        return hits, np.minimum(out[hits], 1.0).astype(float)


class Scorer:
    """Votes of the nearest, weighted by cosine and by how many labelled rows an example stands for, then calibrated."""

    def __init__(self, index: Index, stands: dict[int, float], calibration: tuple[float, float] = (1.0, 0.0)):
        self.index, self.calibration = index, calibration
        self.stands = np.array([stands.get(0, 0.0), stands.get(1, 0.0)])
        n = np.bincount(index.toxic.astype(int), minlength=2) * self.stands
        self.prior = float(n[1] / n.sum()) if n.sum() else 0.0

    def votes(self, queries: list[tuple], but: list[int | None] | None = None) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """For each (terms, tf, others): the share of toxic among its neighbours, their positions and cosines."""
        for hits, cosines in self.index.nearest(queries, but=but):
            y = self.index.toxic[hits]
            if not len(y):
                yield self.prior, hits, cosines
                continue
            weight = cosines * self.stands[y] / max(1.0, self.stands[y].max())
            weight = np.where(y == 1, np.maximum(weight, 1e-9), weight)
            mean = weight.mean()
            yield float((weight @ y + PRIOR * self.prior * mean) / (weight.sum() + PRIOR * mean)), hits, cosines

    def calibrate(self, votes: list[tuple[int, float]]) -> None:
        """Platt's two numbers, fitted on (toxic, its votes without itself) of the examples."""
        if not 0 < self.prior < 1:
            return
        x = np.array([self._logit(p) for _, p in votes])
        y = np.array([y for y, _ in votes], float)
        weight = self.stands[y.astype(int)]
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * x + b)))
            r, h = weight * (y - p), weight * p * (1 - p)
            g = np.array([r @ x - 1e-3 * (a - 1), r.sum() - 1e-3 * b])
            m = np.array([[h @ (x * x) + 1e-3, h @ x], [h @ x, h.sum() + 1e-3]])
            step = np.linalg.solve(m, g)
            step *= min(1.0, 2 / max(np.abs(step).max(), 1e-300))
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-9:
                break
        if a > 0:  # else the neighbours tell nothing, and their order is kept
            self.calibration = (float(a), float(b))

    @staticmethod
    def _logit(p: float) -> float:
        p = min(max(p, 1e-6), 1 - 1e-6)
        return math.log(p / (1 - p))

    def score(self, queries: list[tuple]) -> Iterator[tuple[float, list[dict]]]:
        a, b = self.calibration
        for raw, hits, cosines in self.votes(queries):
            evidence = [{"doc_id": int(self.index.ids[i]), "similarity": float(c), "toxic": int(self.index.toxic[i])} for i, c in zip(hits[:3], cosines[:3], strict=True)]
            yield 1 / (1 + math.exp(-(a * self._logit(raw) + b))), evidence


def emphasis(examples: Examples) -> np.ndarray:
    """A factor for each term: 1, and (1 + z - CHANCE)^2 for one whose rate in toxic examples is z > CHANCE standard errors above that in others."""
    n, size = len(examples.words), np.bincount(examples.toxic, minlength=2)
    if not size.all():
        return np.ones(n)
    y = np.repeat(examples.toxic, np.diff(examples.begin))
    counts = np.stack([np.bincount(examples.term[y == k], minlength=n) for k in (0, 1)])
    rate = (counts + 0.5) / (size[:, None] + 1)
    z = (rate[1] - rate[0]) / np.sqrt((rate * (1 - rate) / size[:, None]).sum(0))
    return (1 + np.maximum(0, z - CHANCE)) ** 2


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[Scorer, Vocabulary]:
    """A calibrated scorer from the examples, and their words."""
    spark = docs.sparkSession
    texts, totals = examples_of(labels.select("doc_id", "toxic"), docs)
    examples = vectors(texts)
    vocabulary = Vocabulary(examples.words)
    n, df = frequencies(docs, vocabulary)
    weights = (np.log((n + 1) / (df + 1)) + 1) * emphasis(examples)
    stands = {y: totals.get(y, 0) / max(1, int((examples.toxic == y).sum())) for y in (0, 1)}
    scorer = Scorer(Index(examples, weights, math.log(n + 1) + 1), stands)
    examples.words = []
    sent = spark.sparkContext.broadcast((scorer, examples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, examples = sent.value
        for batch in batches:
            some = batch.column("id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(examples.toxic[some], pa.int32()), pa.array([x[0] for x in scorer.votes([(*examples[i], 0.0) for i in some], [int(examples.ids[i]) for i in some])], pa.float64())], ["toxic", "raw"])

    asked = spark.range(0, len(examples.ids), 1, common.partitions(spark)).mapInArrow(common.lean(run), "toxic int, raw double").toArrow()  # two numbers an example
    scorer.calibrate(sorted(zip(asked.column("toxic").to_pylist(), asked.column("raw").to_pylist(), strict=True)))
    sent.destroy()
    return scorer, vocabulary


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence of docs(doc_id, text), learnt from labels(doc_id, toxic).

    At most SAMPLE labelled rows a class are examples. The space is that of all their words: a term weighs (1 + log tf) * idf, idf
    over all documents, times its emphasis, which the examples' labels give. No word is left out: one that no example has counts
    in a text's length, with the idf of a word in no document. The index and the words are sent to all tasks; their size is that of
    the examples' texts, however many documents there are. Whole texts are read twice: for idf, and for scores.

    Empty and null texts, and those that share no word with an example, get the prior rate of toxic rows. Without labels of both
    classes all scores are the rate of toxic ones, 0 if there are none. Repeated rows score alike; a null doc_id is held out. Of
    several labels of a doc_id the largest counts, of several texts of an example the least. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "text")
    return _scores(rows, docs.sparkSession.sparkContext.broadcast(fitted(rows, labels)))


def _scores(rows: DataFrame, sent: Broadcast) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, vocabulary = sent.value
        number = vocabulary.numbers()
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        for batch in common.small_batches(batches):
            asked = []
            for text in common.text_bytes(batch.column("text")):
                counts = Counter(words_of(text))
                terms, tf, others = [*map(number.get, counts)], [*counts.values()], 0.0
                if None in terms:
                    others = sum((1 + math.log(n)) ** 2 for t, n in zip(terms, tf, strict=True) if t is None)
                    tf = [n for t, n in zip(terms, tf, strict=True) if t is not None]
                    terms = [t for t in terms if t is not None]
                asked.append((terms, tf, others))
            out = [*scorer.score(asked)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([x for x, _ in out], pa.float64()), pa.array([e for _, e in out], kind)], ["doc_id", "score", "evidence"])

    scored = rows.mapInArrow(common.lean(run), SCORED)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic, all columns. Rows of a doc_id go together if one is toxic; a null doc_id stays."""
    rows = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(fitted(rows, labels))
    bad = common.save(_scores(rows, sent).where("predicted = 1 AND doc_id IS NOT NULL").select("doc_id").distinct(), "toxic")
    sent.destroy()
    return common.without(docs, bad)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.documents(spark, sf_dir), labels(spark, sf_dir))

"""Operator 10, substring dedup by seed and extend: winnowed anchors, extended both ways to maximal repeats across documents.

A window is LENGTH consecutive words; its anchor is the least hash of its runs of ANCHOR words (winnowing), so equal windows have
equal anchors. Anchors of all documents are joined first: only those of two documents or more are seeds. Around each place of a
seed, the match is then extended one word at a time to both sides, by the windows that hold the seed at each offset; a window that
starts in a document with a smaller doc_id is a match, and matches that overlap or touch form one maximal repeat.

Documents are dealt to groups of about GROUP bytes by a hash of doc_id. A group speaks for its documents: it sends each different
anchor, then each different window, once, with the smallest doc_id it has there, to the bucket of its hash; the bucket answers with
a bit. So a passage that a third of all documents share reaches its bucket once for each group, and no pairs are made. A group writes
only to buckets it has keys for, so what is sent follows the keys, however many groups and buckets there are. A group's memory
follows GROUP (and its longest document), a bucket's follows BUCKET.

Two windows are taken for equal if 128 bits agree: two independent sums over their words' 64-bit hashes. That is an identity for any
corpus (the chance that 10**13 different windows hold such a pair is about 10**-13); a test makes the first 64 bits clash.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

#: Words of a window and of an anchor; bytes of text dealt to a group and to a bucket.
LENGTH, ANCHOR, GROUP, BUCKET = 13, 5, 4 << 20, 16 << 20
#: Groups and buckets that a task handles in turn, and what the second half of a window's hash multiplies by.
TURNS, SECOND = 8, 0xD6E8FEB86659FD93
SENT = "bucket long, g long, keys binary, least binary, base long"
ANSWER = "g long, step int, bucket long, bits binary"
KEPT = "doc_id long, n_words long, n_removed long, kept string, repeats array<struct<first:long,words:long>>"

_hashes = common.WordHashes()


class Group:
    """The windows of a group's documents: their doc_ids, anchors and hashes."""

    def __init__(self, table: pa.Table, length: int, anchor: int):
        self.ids, self.length = table.column("doc_id").to_pylist(), length
        self.words = [t.split() for t in common.text_bytes(table.column("text"))]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        flat = _hashes.of([*chain.from_iterable(self.words)])
        n = max(0, len(flat) - length + 1)
        runs, least = common.runs(flat, anchor), None
        for j in range(length - anchor + 1):
            part = runs[j : j + n]
            least = part.copy() if least is None else np.minimum(least, part, out=least)
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        known = np.array([i is not None for i in self.ids], bool)
        # windows that lie in one document, of a known doc_id
        left = np.repeat(ends, self.sizes)[:n] - np.arange(n)
        here = np.flatnonzero((left >= length) & np.repeat(known, self.sizes)[:n])
        self.at, self.anchors = here, least[here] if n else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(len(self.ids)), self.sizes)[here] if n else np.zeros(0, np.int64)
        self.doc = np.array([i or 0 for i in self.ids], np.int64)[doc] if n else np.zeros(0, np.int64)
        self.flat = flat

    def windows(self, some: np.ndarray, bits: int) -> np.ndarray:
        """128 bits of each window, as two rows; `bits` of the first are used (fewer in tests)."""
        cut = np.uint64((1 << bits) - 1)
        return np.stack([common.runs(self.flat, self.length)[self.at[some]] & cut, common.runs(self.flat, self.length, SECOND)[self.at[some]]])


def _least(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different keys ascending, the smallest and largest doc of each, and the place of each row's key among them. Keys have one or two rows."""
    two = keys if keys.ndim == 2 else keys[None]
    order = np.argsort(two[0], kind="stable")
    if len(two) > 1 and len(order):
        sorted_ = two[:, order]
        if ((sorted_[0, 1:] == sorted_[0, :-1]) & (sorted_[1, 1:] != sorted_[1, :-1])).any():
            order = np.lexsort(two[::-1])
    two = two[:, order]
    first = np.concatenate([[True], (two[:, 1:] != two[:, :-1]).any(0)]) if len(order) else np.zeros(0, bool)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(first) - 1
    begin = np.flatnonzero(first)
    doc, keys = doc[order], two[:, begin] if keys.ndim == 2 else two[0, begin]
    if not len(begin):
        return keys, doc, doc, place
    return keys, np.minimum.reduceat(doc, begin), np.maximum.reduceat(doc, begin), place


def _seeds(group: Group) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different anchors of a group, whether two of its documents have it, and each window's place among them."""
    keys, low, high, place = _least(group.anchors, group.doc)
    return keys, low < high, place


class Dealt:
    """Positions of keys by bucket, keys ascending in each; only buckets that have keys are kept: their numbers and where each begins."""

    def __init__(self, keys: np.ndarray, buckets: int):
        bucket = (keys % np.uint64(buckets)).astype(np.int64)
        self.order = np.argsort(bucket, kind="stable")
        self.bucket, begin = np.unique(bucket[self.order], return_index=True)
        self.begin = np.append(begin, len(keys))

    def __iter__(self):
        for i, b in enumerate(self.bucket.tolist()):
            yield b, self.order[self.begin[i] : self.begin[i + 1]]

    def bits(self, answers: pa.Table, step: int) -> np.ndarray:
        """The answers to one step, put back in order of the keys."""
        out = np.zeros(len(self.order), bool)
        own = np.flatnonzero(answers.column("step").to_numpy() == step)
        if len(own):
            at = np.searchsorted(self.bucket, answers.column("bucket").to_numpy()[own])
            for i, bits in zip(at.tolist(), answers.column("bits").take(pa.array(own)).to_pylist(), strict=True):
                some = self.order[self.begin[i] : self.begin[i + 1]]
                out[some] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(some)).astype(bool)
        return out


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = [*zip(*rows, strict=True)] or [[]] * len(fields)
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def _extend(group: Group, answers: pa.Table, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows around seeds (positions in group.at), at every offset of the seed in a window, and their hashes."""
    keys, _, place = _seeds(group)
    some = np.flatnonzero(Dealt(keys, buckets).bits(answers, 1)[place]) if len(keys) else np.zeros(0, np.int64)
    return some, group.windows(some, bits)


def _send_anchors(buckets: int, length: int, anchor: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, again, _ = _seeds(Group(table, length, anchor))
        high = (keys >> np.uint64(32)).astype("<u4")  # with the bucket: a seed taken for another's only costs its windows' extension
        return _rows([(b, key[0].as_py(), high[part].tobytes(), np.packbits(again[part]).tobytes(), 0) for b, part in Dealt(keys, buckets)], SENT)

    return run


def _answer_anchors(key: tuple, table: pa.Table) -> pa.Table:
    """Which anchors came from two groups, or from two documents of a group."""
    sent = [np.frombuffer(x, "<u4") for x in table.column("keys").to_pylist()]
    ends = np.cumsum([len(x) for x in sent])
    _, place, count = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
    again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table.column("least").to_pylist(), sent, strict=True)]).astype(bool)
    shared = (count[place] > 1) | again
    return _rows([(g, 1, key[0].as_py(), np.packbits(shared[e - len(k) : e]).tobytes()) for g, e, k in zip(table.column("g").to_pylist(), ends.tolist(), sent, strict=True)], ANSWER)


def _send_windows(buckets: int, length: int, anchor: int, bits: int) -> Callable:
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows([], SENT)
        group = Group(docs, length, anchor)
        some, hashes = _extend(group, answers, buckets, bits)
        keys, low, _, _ = _least(hashes, group.doc[some])
        base = int(low.min()) if len(low) else 0
        kind = "<u4" if not len(low) or int(low.max()) - base < 1 << 32 else "<u8"
        least = (low - base).astype(kind)
        return _rows([(b, key[0].as_py(), keys[:, part].astype("<u8").tobytes(), least[part].tobytes(), base) for b, part in Dealt(keys[0], buckets)], SENT)

    return run


def _answer_windows(key: tuple, table: pa.Table) -> pa.Table:
    """Which windows start in a document before the group's first that has them."""
    sent = [np.frombuffer(x, "<u8").reshape(2, -1) for x in table.column("keys").to_pylist()]
    least = [np.frombuffer(x, "<u4" if 2 * len(x) < 8 * k.size else "<u8").astype(np.int64) + base for x, k, base in zip(table.column("least").to_pylist(), sent, table.column("base").to_pylist(), strict=True)]
    ends, own = np.cumsum([k.shape[1] for k in sent]), np.concatenate(least)
    _, low, _, place = _least(np.concatenate(sent, axis=1), own)
    before = low[place] < own
    return _rows([(g, 2, key[0].as_py(), np.packbits(before[e - k.shape[1] : e]).tobytes()) for g, e, k in zip(table.column("g").to_pylist(), ends.tolist(), sent, strict=True)], ANSWER)


def _cut(buckets: int, length: int, anchor: int, bits: int) -> Callable:
    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        group = Group(docs, length, anchor)
        some, hashes = _extend(group, answers, buckets, bits)
        keys, low, _, place = _least(hashes, group.doc[some])
        found = group.at[some[(group.doc[some] > low[place]) | Dealt(keys[0], buckets).bits(answers, 2)[place]]] if len(some) else some
        edges = np.zeros(len(group.flat) + 1, np.int32)
        np.add.at(edges, found, 1)
        np.add.at(edges, found + length, -1)
        covered = np.cumsum(edges[:-1]) > 0
        kept, removed, spans = [], [], []
        for words, at, n in zip(group.words, group.starts.tolist(), group.sizes.tolist(), strict=True):
            gone = covered[at : at + n]
            removed.append(int(np.count_nonzero(gone)))
            turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).tolist() if removed[-1] else []
            spans.append([{"first": a, "words": b - a} for a, b in zip(turns[::2], turns[1::2], strict=True)])
            kept.append((b" ".join(compress(words, (~gone).tolist())) if removed[-1] else b" ".join(words)).decode())
        return pa.table({
            "doc_id": pa.array(group.ids, pa.int64()), "n_words": pa.array(group.sizes), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()),
            "repeats": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64())]))),
        })

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group: int = GROUP, bucket: int = BUCKET, bits: int = 64) -> DataFrame:
    """Each text of docs(doc_id, text) without the words of windows that also start in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept (the other words, joined by one space) and repeats (first word and words of each
    maximal repeat). Windows are judged on the input. A null or empty text has no words; rows of the same doc_id don't count as
    earlier for one another; a null doc_id neither loses words nor makes others lose them. An empty table gives no rows, other
    columns are not read. Tasks follow the input's size: each has TURNS groups or buckets, one at a time.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = max(1, -(-size // group)), max(common.partitions(spark), -(-size // bucket))
    tasks = lambda n: max(common.partitions(spark), -(-n // TURNS))
    by_group = lambda df: df.repartition(tasks(groups), "g").groupBy("g")
    by_bucket = lambda df: df.repartition(tasks(buckets), "bucket").groupBy("bucket")
    dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("g"), "doc_id", "text")
    asked = by_group(dealt).applyInArrow(_send_anchors(buckets, length, anchor), SENT)
    seeds = common.save(by_bucket(asked).applyInArrow(_answer_anchors, ANSWER), "repeat-seeds")
    common.release(spark)
    asked = by_group(dealt).cogroup(by_group(seeds)).applyInArrow(_send_windows(buckets, length, anchor, bits), SENT)
    earlier = common.save(by_bucket(asked).applyInArrow(_answer_windows, ANSWER), "repeat-windows")
    common.release(spark)
    return by_group(dealt).cogroup(by_group(seeds.unionByName(earlier))).applyInArrow(_cut(buckets, length, anchor, bits), KEPT)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(common.documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH split AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
gone AS (SELECT DISTINCT doc_id, i + j AS place FROM (SELECT doc_id, i, unnest(range(0, 13)) AS j FROM windows JOIN firsts USING (w) WHERE first < doc_id)),
places AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split),
cut AS (SELECT p.doc_id, count(g.place) AS n_removed, string_agg(word, ' ' ORDER BY p.place) FILTER (g.place IS NULL) AS kept FROM places p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.place = p.place GROUP BY p.doc_id)
SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM split s LEFT JOIN cut ON cut.doc_id = s.doc_id
"""

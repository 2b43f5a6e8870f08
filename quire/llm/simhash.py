"""Operator 2, SimHash near-dedup: exact pairs within a Hamming radius by vantage-point trees, and their components.

near_duplicates() links fingerprints. deduplicate(), the pipeline's stage, takes its candidates from fingerprints in the same trees
and links what an exact comparison of shingle sets confirms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

EDGES = "a long, b long"
#: The tree over shards is fitted on at most so many fingerprints (25 MB), and has at most SAMPLE / 32 leaves.
SAMPLE = 1 << 20
#: Similar texts (0.8 over five-word shingles) have 15 % of fingerprint bits apart: 39 of 256, deviation 6; sets of under SMALL shingles up to 48.
WORDS, RADIUS, SMALL, SMALL_RADIUS = 4, 64, 16, 80
#: Keys of a text by which similar ones meet, and least hashes that make one: a pair of 0.8 shares none with a chance of (1 - 0.8^4)^24, 3 in a million.
KEYS, ROWS = 24, 4
#: Points of a shard that are compared without a tree, and of one that is cut.
LEAF, CUT = 64, 1 << 15
#: Compared pairs of the first round from which on a text is a hub.
HUB = 64


def hashes(text: bytes, width: int) -> list[int]:
    """XXH64 (seed 42) of each run of `width` words of an ASCII-lower-cased text, or of the whole if it has fewer; none without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if len(words) <= width:
        return [xxh64_intdigest(b" ".join(words), 42)] if words else []
    joined, ends, at = b" ".join(words), [], -1
    for n in map(len, words):
        at += n + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-width]]]
    return [xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends[width - 1 :], strict=True)]


def fingerprint(h: np.ndarray, words: int) -> np.ndarray:
    """`words` x 64 bits: a bit is 1 if it is set in over half of h; further words take remixed hashes."""
    out = np.zeros(words, np.uint64)
    for k in range(words):
        x, ones = h, np.zeros(64, np.int64)
        if k:
            x = (x ^ np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(29)
        for at in range(0, len(x), 8192):
            ones += np.unpackbits(x[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(x), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, width: int, words: int, distinct: bool) -> DataFrame:
    """doc_id, size (shingles; different ones if `distinct`), f0, f1, ... of docs(doc_id, text). A null text is empty: size 0 and all bits 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            sizes, prints = [], np.zeros((batch.num_rows, words), np.uint64)
            for i, text in enumerate(common.text_bytes(batch.column("text"))):
                h = np.array(hashes(text, width), np.uint64)
                h = np.unique(h) if distinct else h
                sizes.append(len(h))
                prints[i] = fingerprint(h, words)
            columns = [pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), *columns], ["doc_id", "size", *names(words)])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(["doc_id long", "size long", *[f"{x} long" for x in names(words)]]))


def names(words: int) -> list[str]:
    return [f"f{k}" for k in range(words)]


class Tree:
    """A vantage-point tree over fingerprints x (n, words) and log sizes.

    A node splits at the median distance from a vantage point. By the triangle inequality, what lies within `radius` of a point at
    distance d is on the near side only if d <= median + radius, and on the far side only if d > median - radius. Where sizes must
    agree to within `ratio`, |log size| is a second metric with radius log(1 / ratio); each node takes, of some vantage points and
    the size, what leaves the fewest points in its boundary. Where next to none are pruned, a node stays a leaf.
    """

    def __init__(self, x: np.ndarray, logs: np.ndarray, leaf: int, radius: int, ratio: float | None, seed: int = 42):
        self.radius, self.slack = radius, None if ratio is None else float(-np.log(ratio)) + 1e-9
        self.nodes: list[tuple] = []  # ("leaf", number) or (vantage or None, median, near, far, leaves up to here)
        self.members: list[np.ndarray] = []
        self.random = np.random.default_rng(seed)
        self._build(x, logs, np.arange(len(x)), leaf)

    def _distance(self, vantage: np.ndarray | None, x: np.ndarray, logs: np.ndarray) -> np.ndarray:
        return logs if vantage is None else np.bitwise_count(x ^ vantage).sum(1, dtype=np.int32)

    def _bound(self, vantage: np.ndarray | None) -> float:
        return self.slack if vantage is None else self.radius

    def _build(self, x: np.ndarray, logs: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        best = None
        if len(rows) > leaf:
            some = self.random.choice(rows, min(len(rows), 1024), replace=False)
            for vantage in [*x[self.random.choice(some, 8)], *([None] if self.slack is not None else [])]:
                d = self._distance(vantage, x[some], logs[some])
                median, bound = float(np.median(d)), self._bound(vantage)
                near = np.mean(d <= median)
                shared = np.mean((d <= median + bound) & (d > median - bound))
                if 0.1 < near < 0.9 and shared < 0.95 and (best is None or shared < best[0]):
                    best = (shared, vantage, median)
        if best is None:
            self.nodes[at] = ("leaf", len(self.members))
            self.members.append(rows[np.argsort(logs[rows], kind="stable")] if self.slack is not None else rows)
            return at
        _, vantage, median = best
        near = self._distance(vantage, x[rows], logs[rows]) <= median
        left = self._build(x, logs, rows[near], leaf)
        right = self._build(x, logs, rows[~near], leaf)
        self.nodes[at] = (vantage, median, left, right, len(self.members))
        return at

    def home(self, x: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(x), np.int64)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if self.nodes[node][0] is not None and isinstance(self.nodes[node][0], str):
                out[rows] = self.nodes[node][1]
            elif len(rows):
                vantage, median, left, right, _ = self.nodes[node]
                near = self._distance(vantage, x[rows], logs[rows]) <= median
                stack += [(left, rows[near]), (right, rows[~near])]
        return out

    def reach(self, x: np.ndarray, logs: np.ndarray, home: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, points that may have neighbours there), for leaves after a point's home only: every pair is met from one side."""
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if isinstance(self.nodes[node][0], str):
                leaf = self.nodes[node][1]
                if len(rows := rows[home[rows] < leaf]):
                    yield leaf, rows
                continue
            vantage, median, left, right, leaves = self.nodes[node]
            if len(rows := rows[home[rows] < leaves - 1]):
                d, bound = self._distance(vantage, x[rows], logs[rows]), self._bound(vantage)
                stack += [(left, rows[d <= median + bound]), (right, rows[d > median - bound])]


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        for x in (a, b):
            while True:
                up = parent[x]
                if (up == x).all():
                    break
                x[:] = up
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


class Shard:
    """The fingerprints of one shard, a tree over them, and a union-find forest of what is linked."""

    def __init__(self, nodes: np.ndarray, x: np.ndarray, logs: np.ndarray, radius: int, ratio: float | None, leaf: int = 128, link: bool = True):
        order = np.argsort(nodes, kind="stable")
        self.nodes, self.x, self.logs, self.radius = nodes[order], x[order], logs[order], radius
        self.tree = Tree(self.x, self.logs, leaf, radius, ratio)
        self.parent = np.arange(len(nodes))
        for a, b in self.own() if link else ():
            _unite(self.parent, a, b)

    def own(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of all linked pairs of its points: in each leaf, and of points with the later leaves that the bounds leave open."""
        home = np.zeros(len(self.nodes), np.int64)
        for leaf, rows in enumerate(self.tree.members):
            home[rows] = leaf
            for a, b in self._pairs(self.x[rows], self.logs[rows], leaf):
                yield rows[a], rows[b]
        for leaf, rows in self.tree.reach(self.x, self.logs, home):
            members = self.tree.members[leaf]
            for a, b in self._pairs(self.x[rows], self.logs[rows], leaf):
                yield rows[a], members[b]

    def near(self, x: np.ndarray, logs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (in x, in the shard) of all linked pairs with other points."""
        for leaf, rows in self.tree.reach(x, logs, np.full(len(x), -1)):
            members = self.tree.members[leaf]
            for a, b in self._pairs(x[rows], logs[rows], leaf):
                yield rows[a], members[b]

    def _pairs(self, x: np.ndarray, logs: np.ndarray, leaf: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (in x, in the leaf) of all linked pairs, in blocks."""
        members, slack = self.tree.members[leaf], self.tree.slack
        there, sizes = self.x[members], self.logs[members]
        order = np.arange(len(x)) if slack is None else np.argsort(logs, kind="stable")
        step = max(1, (1 << 20) // max(1, len(members)))
        for at in range(0, len(x), step):
            part = order[at : at + step]
            low, high = 0, len(members)
            if slack is not None:
                low, high = np.searchsorted(sizes, logs[part[0]] - slack), np.searchsorted(sizes, logs[part[-1]] + slack, "right")
            d = np.zeros((len(part), high - low), np.uint16)
            for k in range(x.shape[1]):
                d += np.bitwise_count(x[part, k][:, None] ^ there[None, low:high, k])
            a, b = np.nonzero(d <= self.radius)
            if slack is not None and len(a):
                near = np.abs(logs[part[a]] - sizes[low + b]) <= slack
                a, b = a[near], b[near]
            if len(a):
                yield part[a], low + b

    def ask(self, nodes: np.ndarray, x: np.ndarray, logs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of points of other shards: (node, a member linked to it), one for each point and leaf; all its members are united."""
        for leaf, rows in self.tree.reach(x, logs, np.full(len(x), -1)):
            members = self.tree.members[leaf]
            for a, b in self._pairs(x[rows], logs[rows], leaf):
                q, first = np.unique(rows[a], return_index=True)
                one = np.zeros(len(x), np.int64)
                one[q] = members[b[first]]
                _unite(self.parent, one[rows[a]], members[b])
                yield nodes[q], self.nodes[one[q]]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        root = self.parent.copy()
        while (root[root] != root).any():
            root = root[root]
        child = np.flatnonzero(root != np.arange(len(root)))
        return self.nodes[child], self.nodes[root[child]]


def _columns(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    get = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
    x = np.stack([get(f) for f in names(words)], 1).view(np.uint64) if batch.num_rows else np.zeros((0, words), np.uint64)
    return get("node"), np.ascontiguousarray(x), np.log(np.maximum(get("size"), 0.5))


def _route(tree: Tree, words: int):
    """A row for a point's own shard (asks = 0), and one for each later shard whose boundary it is near (asks = 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, x, logs = _columns(batch, words)
            home = tree.home(x, logs)
            for leaf, rows, asks in [(None, None, 0), *[(leaf, rows, 1) for leaf, rows in tree.reach(x, logs, home)]]:
                part = batch if rows is None else batch.take(pa.array(rows))
                shard = home if rows is None else np.full(len(rows), leaf)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(np.full(len(shard), asks, np.int32)), *part.columns], ["shard", "asks", *part.schema.names])

    return run


def _link(words: int, radius: int, ratio: float | None):
    """Rows come sorted by shard, a shard's own points before those that ask it; the latter stream by."""

    def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, shard = None, [], None

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal shard, own
            if shard is None and own:
                shard = Shard(*[np.concatenate(c) for c in zip(*own, strict=True)], radius, ratio)
            if shard is not None:
                yield edges(*shard.forest())
            shard, own = None, []

        for batch in batches:
            key = batch.column("shard").to_numpy() * 2 + batch.column("asks").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else [0]
            for start, end in zip(cuts, cuts[1:], strict=False):
                number, asks = divmod(int(key[start]), 2)
                if number != now:
                    yield from close()
                    now = number
                points = _columns(batch.slice(start, end - start), words)
                if not asks:
                    own.append(points)
                    continue
                if shard is None and own:
                    shard = Shard(*[np.concatenate(c) for c in zip(*own, strict=True)], radius, ratio)
                for a, b in shard.ask(*points) if shard else ():
                    yield edges(a, b)
        yield from close()

    return run


def near_duplicates(docs: DataFrame, width: int = 5, words: int = 4, radius: int = 48, ratio: float | None = 0.8, distinct: bool = True, shard: int = 1 << 15) -> DataFrame:
    """Groups of docs(doc_id, text) whose fingerprints (words x 64 bits over shingles of `width` words) differ in at most `radius` bits.

    With a `ratio`, the shingle counts of a pair must agree to within it. Returns doc_id, size, f0, f1, ... and component_id, the
    smallest doc_id that links reach.

    Equal fingerprints are first folded into the smallest doc_id among them, so a group of copies is one point, however large. A
    tree fitted on a bounded sample cuts the points into shards; each point is sent to its own shard and asks the later shards that
    the triangle bounds leave open. A shard answers from its own tree with a spanning forest of its links, not the pairs, and the
    forests' components are found by distributed steps. A shard that holds a dense ball of k points compares k * k of them, in
    blocks of bounded memory.

    A radius decides on bits, not on similarity: at 0.8 Jaccard similarity, shingle sets have a cosine of 0.889, hence 15 % of bits
    differ (39 of 256, deviation 6, more for short texts), so the defaults miss some such pairs and take some below.

    Null texts are empty, and texts without words are all linked. A null doc_id links nothing and gets
    its group's component; repeated rows are answered alike; an empty table gives no rows; other columns are not read.
    """
    spark, f = docs.sparkSession, names(words)
    prints = common.save(fingerprints(docs, width, words, distinct), "simhash")
    key = [*f, *(["size"] if ratio is not None else [])]
    points = prints.groupBy(*key).agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), *([] if ratio is not None else [F.lit(0).cast("long").alias("size")]))
    points = common.save(points.select("node", "size", *f, "copies"), "simhash-points")
    alone = points.where("node IS NOT NULL").drop("copies")
    n = alone.count()
    sample = _columns(_batch(alone.orderBy(F.xxhash64("node")).limit(min(SAMPLE, max(8192, 32 * -(-n // shard)))), words), words)
    tree = Tree(sample[1], sample[2], max(32, -(-len(sample[0]) * shard // max(n, 1))), radius, ratio)
    tree.members = [()] * len(tree.members)  # the sample itself isn't sent
    dealt = alone.mapInArrow(_route(tree, words), "shard long, asks int, node long, size long, " + ", ".join(f"{x} long" for x in f))
    dealt = dealt.repartition(max(common.partitions(spark), len(tree.members)), "shard").sortWithinPartitions("shard", "asks", "node")
    roots = common.min_labels(dealt.mapInArrow(_link(words, radius, ratio), EDGES), "simhash-links")
    labels = points.join(roots, "node", "left").select(*key, "copies", F.coalesce("root", "node").alias("component_id"))
    return common.looked_up(prints, common.save(labels, "simhash-labels"), key, "copies").select("doc_id", "size", *f, "component_id")


_ODD = np.random.default_rng(42).integers(0, 1 << 63, KEYS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def keys_of(h: np.ndarray) -> np.ndarray:
    """KEYS hashes of a set h, each of its least values under ROWS orders: two sets share one with the ROWS-th power of their similarity."""
    least = np.full(KEYS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(h), 1024):
        np.minimum(least, (h[None, at : at + 1024] * _ODD[:, None]).min(1), out=least)
    mixed = common.mixed(least + np.arange(KEYS * ROWS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return common.mixed(mixed.reshape(KEYS, ROWS).sum(1, dtype=np.uint64))


def described(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, pid (a hash of the shingle set), n, fingerprint and keys of docs(doc_id, text), whole texts. Sets of under four can only be similar if equal, so they have no keys."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            pids, sizes, keys, prints = [], [], [], np.zeros((batch.num_rows, WORDS), np.uint64)
            for i, text in enumerate(common.text_bytes(batch.column("text"))):
                h = np.unique(np.array(hashes(text, width), np.uint64))
                pids.append(xxh64_intdigest(h.tobytes(), 42))
                sizes.append(len(h))
                prints[i] = fingerprint(h, WORDS)
                keys.append(keys_of(h).view(np.int64) if len(h) > 3 else [])
            columns = [pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(WORDS)]
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array(np.array(pids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), *columns, pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "pid", "n", *names(WORDS), "keys"])

    return docs.select("doc_id", "text").mapInArrow(common.lean(run), "doc_id long, pid long, n int, " + ", ".join(f"{x} long" for x in names(WORDS)) + ", keys array<long>")


class Points:
    """Rows of a batch: shard, whether they ask, pid, root, n, hub and shingles shared with it, and fingerprint."""

    def __init__(self, columns: list[np.ndarray]):
        self.columns = columns
        self.key, self.block, self.asks, self.pid, self.root, self.n, self.hub, self.shared, self.x = columns

    def __getitem__(self, some) -> Points:
        return Points([c[some] for c in self.columns])

    def __len__(self) -> int:
        return len(self.pid)

    def __add__(self, other: Points) -> Points:
        return Points([np.concatenate(c) for c in zip(self.columns, other.columns, strict=True)])


def _close(p: Points, a: np.ndarray, q: Points, b: np.ndarray, apart: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of places (a in p, b in q), those of near fingerprints and sizes, and if `apart` of different roots.

    Of two texts with one hub that share too little with it, beyond() has the pairs, so they are left out.
    """
    low, high = np.minimum(p.n[a], q.n[b]), np.maximum(p.n[a], q.n[b])
    some = (p.pid[a] != q.pid[b]) & (5 * low >= 4 * high)
    if apart:
        some &= p.root[a] != q.root[b]
        some &= (p.hub[a] != q.hub[b]) | (p.shared[a] < 0) | (9 * np.minimum(p.shared[a], q.shared[b]) >= 4 * (low + high))
    a, b, low = a[some], b[some], low[some]
    near = np.bitwise_count(p.x[a] ^ q.x[b]).sum(1, dtype=np.int32) <= np.where(low < SMALL, SMALL_RADIUS, RADIUS)
    return p.pid[a[near]], q.pid[b[near]]


def _small(p: Points, first: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of shards of at most LEAF points: neighbours by size, and each with its shard's first; or all whose roots differ."""
    shard = np.cumsum(np.concatenate([[0], (p.key[1:] != p.key[:-1]) | (p.block[1:] != p.block[:-1])])) if len(p) else np.zeros(0, np.int64)
    at = np.arange(len(p))
    for step in range(1, 2 if first else LEAF):
        some = at[:-step][shard[step:] == shard[:-step]]
        if not len(some):
            break
        yield _close(p, some, p, some + step, not first)
    if first:
        start = np.searchsorted(shard, shard)
        yield _close(p, start, p, at, False)


def _large(own: Points, asks: Points, first: bool, cut: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a large shard: neighbours by size, and all with one in the middle; or, by a vantage-point tree, all near ones whose roots differ.

    Where a shard is a part of a larger one (`cut`), pairs of roots that differ are those of its points with the points that ask it.
    """
    if first:  # near all of a group of near copies lie around one text: that nearest to what most bits say
        bits = np.unpackbits(own.x.view(np.uint8), axis=1)
        middle = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(own)).view(np.uint64)
        hub = np.full(1, int(np.bitwise_count(own.x ^ middle).sum(1).argmin()))
        yield _close(own, np.arange(len(own) - 1), own, np.arange(1, len(own)), False)
        yield _close(own, np.repeat(hub, len(own)), own, np.arange(len(own)), False)
        if len(asks):
            yield _close(asks, np.repeat(np.arange(len(asks)), len(own)), own, np.tile(np.arange(len(own)), len(asks)), False)
        return
    least = min(own.n.min(), asks.n.min() if len(asks) else own.n.min())
    if len(np.unique(np.concatenate([own.hub, asks.hub]))) == 1 and own.shared[0] >= 0:  # whoever shares too little with the one hub has no pair here
        own, asks = (p[9 * p.shared >= 4 * (p.n + least)] for p in (own, asks))
    if not len(own):
        return
    shard = Shard(np.arange(len(own)), own.x, np.log(own.n), SMALL_RADIUS if least < SMALL else RADIUS, 0.8, link=False)
    if not cut:
        yield from (_close(own, a, own, b, True) for a, b in shard.own())
    yield from (_close(asks, a, own, b, True) for a, b in shard.near(asks.x, np.log(asks.n)))


def _pairs(first: bool):
    """Candidate pairs of rows sorted by shard, a shard's own points before those that ask it; a shard is held until it is whole."""

    def emit(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        low, high = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(np.stack([low, high], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["a", "b"])

    def large(p: Points) -> Iterator[pa.RecordBatch]:
        asks = p.asks == 1
        if not asks.all():
            for a, b in _large(p[~asks], p[asks], first, bool(p.block[0] >= 0)):
                if len(a):
                    yield emit(a, b)

    def done(p: Points) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero((p.key[1:] != p.key[:-1]) | (p.block[1:] != p.block[:-1])) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(p)]])
        big = (ends - starts > LEAF) | (p.block[starts] >= 0)
        for at, end in zip(starts[big].tolist(), ends[big].tolist(), strict=True):
            yield from large(p[at:end])
        for a, b in _small(p[np.repeat(~big, ends - starts)], first):
            if len(a):
                yield emit(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda name, batch=batch: batch.column(name).to_numpy(zero_copy_only=False)
            now = Points([*[get(c) for c in ("key", "block", "asks", "pid", "root", "n", "hub", "shared")], np.ascontiguousarray(np.stack([get(f) for f in names(WORDS)], 1)).view(np.uint64)])
            held = now if held is None else held + now
            last = np.flatnonzero((held.key[1:] != held.key[:-1]) | (held.block[1:] != held.block[:-1]))
            if len(last):
                yield from done(held[: last[-1] + 1])
                held = held[last[-1] + 1 :]
        if held is not None:
            yield from done(held)

    return run


def candidates(heads: DataFrame, points: DataFrame, first: bool) -> DataFrame:
    """(a, b) of pids that share a key of heads(key, pid) and have near fingerprints; points(pid, root, n, hub, shared, f0, ...).

    A first round takes a few pairs of each shard that are likely to unite it, a second one all pairs whose roots differ. A key that
    more than CUT points have is cut into shards of about that size: in the first round all get the least point, in the second
    the points that don't belong to the key's most frequent root ask all shards, and each of its points lies in one.
    """
    rows = heads.join(points, "pid")
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("m"), F.min(F.struct("n", "pid")).alias("least"))
    counts = counts.groupBy("key").agg(F.sum("m").alias("k"), F.count("*").alias("roots"), F.max_by("root", F.struct("m", "root")).alias("main"), F.min("least").alias("least"))
    some = common.save(counts.where("roots > 1" if not first else "k > 1").where(f"k > {CUT}" if first else "true"), "near-keys")
    kept = ["key", "block", "asks", "pid", "root", "n", "hub", "shared", *names(WORDS)]
    if not first:  # few keys are still open
        rows = rows.join(common.bounded(some.select("key")), "key", "left_semi")
    cut = some.where(f"k > {CUT}")
    whole = rows.withColumns({"block": F.lit(-1), "asks": F.lit(0)})
    if not cut.isEmpty():
        cut = cut.withColumn("blocks", F.ceil(F.col("k") / CUT).cast("int"))
        both = rows.join(F.broadcast(cut), "key")  # each has over CUT rows
        whole = rows.join(F.broadcast(cut.select("key")), "key", "left_anti").withColumns({"block": F.lit(-1), "asks": F.lit(0)})
        own = both.withColumns({"block": F.pmod(F.xxhash64("pid"), F.col("blocks")).cast("int"), "asks": F.lit(0)})
        asking = both.where(F.col("pid") == F.col("least.pid")) if first else both.where("root <> main")
        asking = asking.withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "asks": F.lit(1)})
        whole = whole.select(kept).unionByName(own.select(kept)).unionByName(asking.select(kept))
    dealt = whole.select(kept).repartition(common.partitions(heads.sparkSession), "key", "block").sortWithinPartitions("key", "block", "asks", "n", "pid")
    return dealt.mapInArrow(common.lean(_pairs(first)), EDGES).distinct()


def compared(pairs: DataFrame, points: DataFrame, docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(pairs(a, b) of pids with `both`, the shingles they share, and `close`, whether that is a Jaccard similarity of 0.8 or more: 9 * both >= 4 * (sum of sizes); the sets).

    Only texts that stand for a pid of a pair are read again, and pids of points(pid, node) name them by doc_id.
    """
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.small_batches(batches):
            sets = [np.unique(np.array(hashes(t, width), np.uint64)) for t in common.text_bytes(batch.column("text"))]
            pids = np.array([xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pids), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["pid", "items"])

    asked = common.save(pairs.select(F.explode(F.array("a", "b")).alias("pid")).distinct().join(points.select("pid", "node"), "pid"), "near-asked")
    texts = docs.join(common.bounded(asked.select(F.col("node").alias("doc_id")).distinct()), "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(common.lean(run), "pid long, items array<long>").join(common.bounded(asked.select("pid")), "pid", "left_semi").dropDuplicates(["pid"])
    sets = common.save(sets, "near-sets")
    left, right = (sets.select(F.col("pid").alias(x), F.col("items").alias(f"{x}s")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("as", "bs")).alias("both"), (F.size("as") + F.size("bs")).alias("sum"))
    return common.save(both.select("a", "b", "both", (9 * F.col("both") >= 4 * F.col("sum")).alias("close")), "near-compared"), sets


def hubs(pairs: DataFrame) -> DataFrame:
    """pid, hub and shared of compared pairs: the text with the most pairs that a text was compared with (itself included), if it has HUB or more."""
    ends = pairs.select("a", "b", "both").union(pairs.select("b", "a", "both")).toDF("pid", "hub", "shared")
    often = common.save(ends.groupBy("hub").agg(F.count("*").alias("m")).where(f"m >= {HUB}"), "near-hubs")
    found = ends.union(often.select("hub", "hub", F.lit(None).cast("int"))).join(common.bounded(often), "hub")
    return found.groupBy("pid").agg(F.max_by(F.struct("hub", "shared"), F.struct("m", "hub")).alias("x")).select("pid", "x.hub", "x.shared")


def beyond(points: DataFrame, sets: DataFrame, salts: int = 16) -> DataFrame:
    """(a, b) of texts of one hub and different roots that share shingles which the hub hasn't, where what they share with it isn't enough by itself.

    Two texts share at most the lesser of what each shares with the hub, and shingles that the hub hasn't. So of the many texts that
    were made from one, but changed too much to be similar to it, only those are compared that were changed alike. points(pid, root,
    n, hub, shared) and sets(pid, items) of texts that have a hub.
    """
    rows = points.where("shared >= 0").select("pid", "root", "n", "hub", "shared").join(sets, "pid").withColumn("salt", F.pmod(F.xxhash64("pid"), F.lit(salts)))
    of = points.where("shared >= 0").select(F.col("hub").alias("pid")).distinct().join(sets, "pid").select(F.col("pid").alias("hub"), F.col("items").alias("has"))
    of = of.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    rows = rows.join(of, ["hub", "salt"]).select("hub", "pid", "root", "n", "shared", F.array_except("items", "has").alias("own"))
    rows = common.save(rows.select("hub", "pid", "root", "n", "shared", F.size("own").alias("m"), F.explode("own").alias("item")), "near-own")
    several = rows.groupBy("hub", "item").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("hub", "item")
    rows = common.save(rows.join(common.bounded(common.save(several, "near-own-shared")), ["hub", "item"], "left_semi"), "near-own-rows")
    other = rows.select("hub", "item", *[F.col(x).alias(f"{x}_") for x in ("pid", "root", "n", "shared", "m")])
    able = "pid < pid_ AND root <> root_ AND 5 * least(n, n_) >= 4 * greatest(n, n_) AND 9 * least(shared, shared_) < 4 * (n + n_) AND 9 * (least(shared, shared_) + least(m, m_)) >= 4 * (n + n_)"
    return rows.join(other, ["hub", "item"]).where(able).select(F.col("pid").alias("a"), F.col("pid_").alias("b")).distinct()


def similar_documents(docs: DataFrame, width: int = 5) -> DataFrame:
    """(node, root) of docs(doc_id, text): each doc_id that links of 0.8 Jaccard similarity or more over its shingles reach, and the smallest such.

    Equal shingle sets are one point. At this similarity no vantage point prunes anything (distances of different texts are 128 +- 8
    of 256 bits, the radius is 64), so points are dealt to shards by keys that similar texts nearly surely share, and a tree has one
    shard's points. Fingerprints give candidates; a pair is taken if its sets, compared exactly, are similar, so none is taken below
    0.8, but for clashes of 64-bit hashes. Of pairs of 0.8, about 3 in a million share no key, and fewer than 1 in 10,000 lie outside
    the radius. A first round unites most of each shard by few pairs, a second takes all pairs that it left open, but of texts compared with
    one hub only those that can still be similar by what they share with it. So a large group of near copies makes few pairs. Texts without words are equal. Rows of one doc_id are one document; those without one are left out.
    """
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    each = common.save(described(rows, width), "near-points")
    f = names(WORDS)
    points = each.groupBy("pid").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), *[F.first(x).alias(x) for x in f], F.first("keys").alias("keys"), F.count("*").alias("copies"))
    points = common.save(points, "near-sets-once")
    copies = common.save(points.where("copies > 1").select("pid", "node", "copies"), "near-copies")
    heads = points.select("pid", F.explode("keys").alias("key"))
    shared = common.save(heads.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "near-shared")
    heads = common.save(common.looked_up(heads, shared, ["key"], "k").where("k IS NOT NULL").select("key", "pid"), "near-heads")
    points = points.drop("keys", "copies")
    pairs, sets = compared(common.save(candidates(heads, points.withColumns({"root": F.col("pid"), "hub": F.lit(0).cast("long"), "shared": F.lit(-1)}), True), "near-pairs"), points, rows, width)
    first = pairs.where("close").select("a", "b")
    roots = common.save(common.min_labels(first, "near-first"), "near-roots").select(F.col("node").alias("pid"), "root")
    united = points.join(common.bounded(roots), "pid", "left").withColumn("root", F.coalesce("root", "pid")).join(common.bounded(common.save(hubs(pairs), "near-hub")), "pid", "left")
    own = F.when(F.col("hub") == F.col("pid"), F.col("n")).otherwise(F.coalesce("shared", F.lit(-1)))
    united = common.save(united.withColumns({"shared": own, "hub": F.coalesce("hub", F.lit(0))}), "near-united")
    open_ = candidates(heads, united, False).union(beyond(united, sets)).distinct()
    second = compared(common.save(open_, "near-pairs"), points, rows, width)[0].where("close").select("a", "b")
    left, right = (points.select(F.col("pid").alias(x), F.col("node").alias(f"{x}_")) for x in "ab")
    links = first.union(second).join(left, "a").join(right, "b").select(F.col("a_").alias("a"), F.col("b_").alias("b"))
    equal = common.looked_up(each.select("doc_id", "pid"), copies, ["pid"], "copies").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    return common.min_labels(links.union(equal), "near-labels")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of similar ones, that of the smallest doc_id; all columns. A null doc_id stays."""
    return common.without(docs, similar_documents(docs).where("node <> root").select(F.col("node").alias("doc_id")).distinct())


def _batch(df: DataFrame, words: int) -> pa.RecordBatch:
    table = df.toArrow().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def hex16(f: Column) -> Column:
    return F.lower(F.lpad(F.hex(f), 16, "0"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.documents(spark, sf_dir), width=3, words=1, radius=3, ratio=None, distinct=False)
    return found.select("doc_id", hex16(F.col("f0")).alias("fingerprint"), "component_id")

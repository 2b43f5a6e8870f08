"""Operator 8, licence scans: matching statistics of a generalised suffix automaton, chained into covered template spans."""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.llm import common

#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def _templates() -> list[tuple[str, str]]:
    """(label, text) of the templates, which lie beside this module as data."""
    parts = resources.files("quire.llm").joinpath("licence_templates.txt").read_text(encoding="utf-8").split("\n== ")[1:]
    return [(label.strip(), body.strip()) for label, body in (part.split("\n", 1) for part in parts)]


TEMPLATES = _templates()
#: Words of a match that counts, words that two matches of a chain may lie apart, what a chain must cover, and words that always suffice.
LEAST, GAP, COVER, ENOUGH = 4, 12, 0.8, 20
#: To lower-case A-Z and blank all ASCII that is no letter or digit.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
FOUND = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,words:long,covered:double>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class Automaton:
    """A generalised suffix automaton of number sequences. Each state knows where its strings end: (sequence, position) pairs."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for i, c in enumerate(sequence):
                last = self._extend(last, c)
                self.ends[last].add((k, i))
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):  # shorter strings end where the longer ones do
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]

    def _state(self, length: int, next_: dict[int, int], link: int) -> int:
        self.next.append(next_)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of what p reads with c, cut from longer strings if need be."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        new = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(length, state) of the longest string that ends at each place of ids and occurs in a sequence."""
        state = length = 0
        for c in ids:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            yield length, state


class Scanner:
    """Finds phrases and template spans in texts. What it holds depends on the templates alone."""

    def __init__(self):
        sequences = [words_of(t.encode()) for _, t in TEMPLATES]
        self.labels = [label for label, _ in TEMPLATES]
        self.sizes = [len(s) for s in sequences]
        self.phrases = [(tuple(p.encode().split()), label) for p, label in PHRASES.items()]
        self.number = {w: i for i, w in enumerate(sorted({w for s in sequences for w in s} | {w for p, _ in self.phrases for w in p}))}
        self.automaton = Automaton([[self.number[w] for w in s] for s in sequences])
        self.lasts = {}
        for phrase, label in self.phrases:
            self.lasts.setdefault(self.number[phrase[-1]], []).append(([self.number[w] for w in phrase], label))

    def matches(self, ids: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(place, words, template, its place) of all maximal matches of LEAST words or more: where the matching statistic stops growing."""
        edges = np.flatnonzero(np.diff(np.concatenate([[False], ids >= 0, [False]]).astype(np.int8)))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start < LEAST:
                continue
            before = (0, 0)
            for i, (length, state) in enumerate([*self.automaton.statistics(ids[start:end].tolist()), (0, 0)]):
                if before[0] >= LEAST and length <= before[0]:
                    for template, at in self.automaton.ends[before[1]]:
                        yield start + i - before[0], before[0], template, at - before[0] + 1
                before = (length, state)

    def chains(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """(label, first word, words, share of the template) of chains of matches, in the template's order, that cover enough of it."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for place, n, template, at in self.matches(ids):
            by.setdefault(template, []).append((place, n, at))
        out = []
        for template, found in by.items():
            found.sort()
            best, chain = [], []  # words covered and start of the best chain that ends in each match
            for i, (place, n, at) in enumerate(found):
                best.append(n)
                chain.append(place)
                j = i - 1
                while j >= 0 and found[j][0] + self.sizes[template] + GAP >= place:
                    p, m, q = found[j]
                    # an overlap counts once, on both sides
                    apart = min(place - p, at - q)
                    if apart > 0 and place - (p + m) <= GAP and at - (q + m) <= GAP and best[j] + n - max(0, p + m - place, q + m - at) > best[i]:
                        best[i], chain[i] = best[j] + n - max(0, p + m - place, q + m - at), chain[j]
                    j -= 1
            need = min(ENOUGH, COVER * self.sizes[template])
            ends: dict[int, tuple[int, int]] = {}
            for (place, n, _), covered, first in zip(found, best, chain, strict=True):
                if covered >= need and covered > ends.get(first, (0, 0))[0]:
                    ends[first] = (covered, place + n - first)
            out += [(self.labels[template], first, n, min(1.0, covered / self.sizes[template])) for first, (covered, n) in ends.items()]
        return sorted(out, key=lambda x: (x[1], x[0], -x[2]))

    def scan(self, text: bytes) -> tuple:
        words = words_of(text)
        ids = np.fromiter((self.number.get(w, -1) for w in words), np.int32, len(words))
        places, labels = [], set()
        for number, phrases in self.lasts.items():
            for end in np.flatnonzero(ids == number).tolist():
                for phrase, label in phrases:
                    start = end - len(phrase) + 1
                    if start >= 0 and ids[start : end + 1].tolist() == phrase:
                        places.append(start)
                        labels.add(label)
        chains = self.chains(ids)
        score = max([0.75 if places else 0.0, *[c[3] for c in chains]])
        spans = [{"label": a, "first": b, "words": c, "covered": d} for a, b, c, d in chains]
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {c[0] for c in chains})), float(score), spans


def scan(docs: DataFrame) -> DataFrame:
    """Licence phrases and covered template spans of each row of docs(doc_id, text). One narrow pass: no shuffle, one text at a time.

    n_base counts all places of the phrases, first_word and last_word are null without any; labels joins the phrases' with those of
    chains that cover COVER of a template or ENOUGH words; score is the largest share covered, and at least 0.75 with a phrase. A
    null or empty text has no words, labels "" and score 0. Rows are scanned one by one, so repeated rows and null doc_ids stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("covered", pa.float64())]))]
        for batch in common.small_batches(batches):
            rows = [*zip(*[scanner.scan(t) for t in common.text_bytes(batch.column("text"))], strict=True)]
            columns = [batch.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(rows, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir)).drop("spans")

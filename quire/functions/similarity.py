"""Similarity of titles: the Indel ratio, 2 LCS / (m + n), and the match rule on top of it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quire import importable


_OTHER = re.compile("[^一-鿿]+")


def _arrow(kind: str, call, *columns: Column) -> Column:
    """call() of strings, row by row in Python workers; a pair that comes again in a batch is looked up. Null where a string is."""
    if spark := SparkSession.getActiveSession():
        importable(spark)

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple, float] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair not in known:
                known[pair] = None if pair[0] is None or pair[1] is None else call(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype=object)

    return run(*columns)


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence."""
    return _arrow("int", lcs_length, a, b)


def ratio(a: Column, b: Column) -> Column:
    return _arrow("double", near, a, b)


def title_score(heading: Column, title: Column, threshold: float = 0.8, cjk_only: bool = False) -> Column:
    """1 for equal titles or equal ideographs, else the ratio from `threshold` on, else 0.9 if the heading holds the title, else 0.

    Without `cjk_only`, a pair in which either has no ideographs is compared by whole text; with it, such pairs score 1.
    """
    return F.coalesce(_arrow("double", lambda h, t: score(h, t, threshold, cjk_only), heading, title), F.lit(0.0))


def near(a: str, b: str) -> float:
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def masks(a: str) -> dict[str, int]:
    """Where each character stands, a bit a place."""
    out: dict[str, int] = {}
    for i, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << i
    return out


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel form for Python workers: a machine word holds a row of the table."""
    return lcs_masked(b, masks(a), len(a))


def lcs_masked(b: str, of: dict[str, int], size: int, least: float = 0.0) -> int:
    """lcs_length() by masks() of the other text, `size` long. It stops with 0 once `least` can't be reached: what of b is lost stays lost."""
    full = state = (1 << size) - 1
    for i, c in enumerate(b):
        if c in of:
            hit = state & of[c]
            state = (state + hit | state - hit) & full
        if least and not i & 31 and len(b) - i - 1 + size - state.bit_count() < least:
            return 0
    return size - state.bit_count()


def ideographs(x: str) -> str:
    return _OTHER.sub("", x)


def forms(heading: str, title: str, cjk_only: bool = False) -> tuple[str, str]:
    """What is compared of two titles: their ideographs, or the whole of both where one has none."""
    a, b = ideographs(heading), ideographs(title)
    return (a, b) if cjk_only or (a and b) else (heading, title)


def score(heading: str, title: str, threshold: float = 0.8, cjk_only: bool = False) -> float:
    """title_score() on strings."""
    a, b = forms(heading, title, cjk_only)
    return 1.0 if heading == title or a == b else unequal(a, b, threshold, cjk_only)


def unequal(a: str, b: str, threshold: float = 0.8, cjk_only: bool = False) -> float:
    """The score of two different forms. Lengths that can't reach the threshold are told by themselves."""
    total = len(a) + len(b)
    if 2 * min(len(a), len(b)) >= threshold * total and (found := 2 * lcs_length(a, b) / total) >= threshold:
        return found
    return 0.9 if b in a and (cjk_only or b) else 0.0

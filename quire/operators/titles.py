"""Title trees to flat rows, their neighbours, and alignment with a document's headings."""

from __future__ import annotations

import bisect
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import importable
from quire.functions import similarity, text

#: Levels of a tree that are planned unseen; each deeper one is asked for first, which runs a job.
DEPTH = 4


def flatten(trees: DataFrame, rule: str = "levels", strings: bool = True) -> DataFrame:
    """Titles of trees(doc_id, tree), tree a JSON array of strings and {title, subtitles} objects.

    rule "levels": top is 1; a child of a level-2 title is 3; any other string is 3 below a top title, else 4; any other object is 2 if
    its first subtitle is a string or has subtitles itself or if it is below a top title, else 4. rule "depth": the depth is the level.
    Without `strings` only objects count. An empty title is skipped with all below it. Returns doc_id, ord, title, level, top_idx,
    parent; a tree that doesn't parse gives no rows.
    """
    rows = trees.select("doc_id", F.try_parse_json("tree").alias("node"))
    rows = rows.select("doc_id", F.expr("cast(null as string)").alias("parent"), F.lit(0).alias("above"), F.array().cast("array<int>").alias("path"), "node")
    found = None
    for depth in itertools.count(1):
        if depth > DEPTH and rows.isEmpty():
            break
        rows = rows.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("node").outer())).select("doc_id", "parent", "above", F.array_append("path", F.col("pos")).alias("path"), F.col("value").alias("node"))
        is_object = F.schema_of_variant("node").startswith("OBJECT")
        title = F.when(is_object, F.try_variant_get("node", "$.title", "string")).otherwise(F.try_variant_get("node", "$", "string"))
        below = F.expr("try_variant_get(node, '$.subtitles', 'variant')")
        if rule == "depth":
            level = F.lit(depth)
        elif depth == 1:
            level = F.lit(1)
        else:
            first = F.expr("try_variant_get(node, '$.subtitles[0]', 'variant')")
            upper = F.schema_of_variant(first) == "STRING"
            upper |= F.expr("try_variant_get(node, '$.subtitles[0].subtitles', 'variant')").isNotNull()
            level = F.when(F.col("above") == 2, 3).when(~is_object, F.when(F.col("above") == 1, 3).otherwise(4)).when(F.coalesce(upper, F.lit(False)) | (F.col("above") == 1), 2).otherwise(4)
        rows = rows.select("doc_id", "parent", "path", is_object.alias("is_object"), text.strip(title).alias("title"), level.alias("level"), below.alias("below")).where("title <> ''" + ("" if strings else " AND is_object"))
        part = rows.select("doc_id", "path", "title", "level", "parent")
        found = part if found is None else found.unionByName(part)
        rows = rows.where("below IS NOT NULL").select("doc_id", F.col("title").alias("parent"), F.col("level").alias("above"), "path", F.col("below").alias("node"))
    # paths compare by their numbers in turn, so they sort as the tree is read
    ord_ = F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1
    return found.select("doc_id", ord_.alias("ord"), "title", "level", F.col("path")[0].alias("top_idx"), "parent")


def neighbours(titles: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("ord")
    return titles.withColumns({"prev_title": F.lag("title").over(order), "next_title": F.lead("title").over(order)})


def headings(lines: DataFrame) -> DataFrame:
    """Heading lines of a document, which start with a sign and have a text: doc_id, line_no, title, level."""
    rows = lines.where(text.is_heading(F.col("line")))
    return rows.select("doc_id", "line_no", text.heading_text(F.col("line")).alias("title"), text.heading_level(F.col("line")).alias("level"))


def gathered(titles: DataFrame, heads: DataFrame, unmatched: DataFrame | None = None) -> DataFrame:
    """Of each document with titles: t (ord, title, level), h (line_no, title) and u, the ord of unmatched(doc_id, ord), each in order.

    Bounded by a document's headings. All come in one union, so that none is shuffled where they are of the same lines.
    """
    known = [c for c in ("ord", "title", "level") if c in titles.columns]
    rows = titles.select("doc_id", F.struct(*known).alias("t"))
    rows = rows.unionByName(heads.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.struct("line_no", "title")).alias("h")), allowMissingColumns=True)
    if unmatched is not None:
        rows = rows.unionByName(unmatched.select("doc_id", F.col("ord").alias("u")), allowMissingColumns=True)
    else:
        rows = rows.withColumn("u", F.lit(None).cast("int"))
    return rows.groupBy("doc_id").agg(*[F.array_sort(F.collect_list(c)).alias(c) for c in ("t", "h", "u")]).where(F.size("t") > 0)


def align(titles: DataFrame, heads: DataFrame, threshold: float = 0.8, cjk_only: bool = False, fuzzy: bool = True) -> DataFrame:
    """Ordered greedy alignment: titles in turn take the first equal heading behind the last one taken, else the best fuzzy one.

    titles(doc_id, ord, title, level), heads(doc_id, line_no, title). Returns doc_id, ord, line_no (null if unmatched), score. Both
    sides are gathered by document (bounded by its headings) and matched in an Arrow function: the state of the walk makes it
    sequential within a document, and a bit-parallel subsequence costs a machine word a character.
    """
    importable(titles.sparkSession)

    @F.pandas_udf("array<struct<ord:int,line_no:int,score:double>>")
    def matched(ts: pd.Series, hs: pd.Series) -> pd.Series:
        return pd.Series([walk(t, h, threshold, cjk_only, fuzzy) for t, h in zip(ts, hs, strict=True)])

    return gathered(titles, heads).select("doc_id", F.inline(matched("t", "h")))


def aligned(titles: DataFrame, heads: DataFrame, threshold: float = 0.8, cjk_only: bool = False, fuzzy: bool = True) -> DataFrame:
    """align() and anchors() of each title in one pass: doc_id, ord, title, level, line_no, score, prev_line, next_line."""
    importable(titles.sparkSession)

    @F.pandas_udf("array<struct<line_no:int,score:double,prev_line:int,next_line:int>>")
    def matched(ts: pd.Series, hs: pd.Series) -> pd.Series:
        return pd.Series([[{**m, **n} for m, n in zip(walk(t, h, threshold, cjk_only, fuzzy), between(t, h), strict=True)] for t, h in zip(ts, hs, strict=True)])

    rows = gathered(titles, heads).select("doc_id", "t", matched("t", "h").alias("m"))
    return rows.select("doc_id", F.inline(F.arrays_zip("t", "m"))).select("doc_id", "t.*", "m.*")


def matched_counts(titles: DataFrame, heads: DataFrame, rules: list[tuple[float, bool, bool]]) -> DataFrame:
    """One row: titles, and an array of how many each of rules (threshold, cjk_only, fuzzy) matches. Documents are gathered once."""
    importable(titles.sparkSession)

    @F.pandas_udf("array<bigint>")
    def counts(ts: pd.Series, hs: pd.Series) -> pd.Series:
        return pd.Series([[sum(m["line_no"] is not None for m in walk(t, h, *rule)) for rule in rules] for t, h in zip(ts, hs, strict=True)])

    rows = gathered(titles, heads).select(F.size("t").alias("n"), counts("t", "h").alias("c"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return rows.agg(total("n").alias("titles"), F.array(*[total(F.col("c")[i]) for i in range(len(rules))]).alias("matched"))


def walk(titles: list[dict], heads: list[dict], threshold: float = 0.8, cjk_only: bool = False, fuzzy: bool = True) -> list[dict]:
    out, at = [], 0
    texts = [h["title"] for h in heads]
    bare = [similarity.ideographs(x) for x in texts]
    whole, own = positions(texts), positions(bare)
    for t in titles:
        title, mine = t["title"], similarity.ideographs(t["title"])
        # equal texts, or equal ideographs where there are any
        place = min(following(whole.get(title), at, len(heads)), following(own.get(mine), at, len(heads)) if mine or cjk_only else len(heads))
        best = 1.0
        if place == len(heads):
            best, place = nearest(title, mine, texts, bare, at, threshold, cjk_only) if fuzzy else (0.0, -1)
        found = place >= 0
        out.append({"ord": int(t["ord"]), "line_no": int(heads[place]["line_no"]) if found else None, "score": best if found else None})
        at = place + 1 if found else at
    return out


def positions(keys: list[str]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, key in enumerate(keys):
        out.setdefault(key, []).append(i)
    return out


def following(places: list[int] | None, at: int, none: int) -> int:
    """The first of ascending places from `at` on."""
    i = bisect.bisect_left(places, at) if places else 0
    return places[i] if places and i < len(places) else none


def nearest(title: str, mine: str, texts: list[str], bare: list[str], at: int, threshold: float, cjk_only: bool) -> tuple[float, int]:
    """The best score of headings from `at` on, none of which equals the title, and the first place that has it; (0, -1) without one."""
    best, place = 0.0, -1
    masks: dict[bool, dict[str, int]] = {}
    seen = set()
    for m in range(at, len(texts)):
        by_own = cjk_only or bool(bare[m] and mine)
        a, b = (bare[m], mine) if by_own else (texts[m], title)
        if (by_own, a) in seen:
            continue
        seen.add((by_own, a))
        total = len(a) + len(b)
        most = 2 * min(len(a), len(b)) / total
        if most >= threshold:
            # a heading that holds the title has just this ratio, so nothing else can be better
            if most > best:
                if by_own not in masks:
                    masks[by_own] = similarity.masks(b)
                near = 2 * similarity.lcs_masked(a, masks[by_own], len(b), max(threshold, best) * total / 2 - 1e-6) / total
                if near >= threshold and near > best:
                    best, place = near, m
        elif best < 0.9 and b in a and (cjk_only or b):
            best, place = 0.9, m
    return best, place


def between(titles: list[dict], heads: list[dict]) -> list[dict]:
    """prev_line and next_line of each title: see anchors()."""
    first: dict[str, int] = {}
    for h in heads:
        first.setdefault(similarity.ideographs(h["title"]) or h["title"], int(h["line_no"]))
    last = int(heads[-1]["line_no"]) if len(heads) else 0
    at = [first.get(similarity.ideographs(t["title"]) or t["title"]) for t in titles]
    before, after = [None, *at[:-1]], [*at[1:], None]
    return [{"prev_line": p if p is not None else 0, "next_line": n if n is not None else last} for p, n in zip(before, after, strict=True)]


def best_matches(titles: DataFrame, heads: DataFrame, threshold: float = 0.8, cjk_only: bool = False) -> DataFrame:
    """Each title's best heading of its document, the first of equals, in any order and many to one: doc_id, ord, line_no, score."""
    pairs = titles.select("doc_id", "ord", F.col("title").alias("t")).join(heads.select("doc_id", "line_no", F.col("title").alias("h")), "doc_id")
    importable(titles.sparkSession)

    @F.pandas_udf("double")
    def score(h: pd.Series, t: pd.Series) -> pd.Series:  # bit-parallel, and lengths that can't reach the threshold are told by themselves
        return pd.Series([similarity.score(x, y, threshold, cjk_only) for x, y in zip(h, t, strict=True)])

    pairs = pairs.withColumn("score", score("h", "t")).where("score > 0")
    best = pairs.groupBy("doc_id", "ord").agg(F.max(F.struct(F.col("score"), (-F.col("line_no")).alias("n"))).alias("b"))
    return titles.select("doc_id", "ord").join(best, ["doc_id", "ord"], "left").select("doc_id", "ord", (-F.col("b.n")).alias("line_no"), F.col("b.score").alias("score"))


def candidates(titles: DataFrame, heads: DataFrame, most: int = 3) -> DataFrame:
    """The `most` nearest headings of each title by ratio of whole texts, ties by line: doc_id, ord, rank, line_no, ratio."""
    pairs = titles.select("doc_id", "ord", F.col("title").alias("t")).join(heads.select("doc_id", "line_no", F.col("title").alias("h")), "doc_id")
    importable(titles.sparkSession)

    @F.pandas_udf("double")
    def near(h: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([2 * similarity.lcs_length(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(h, t, strict=True)])

    pairs = pairs.withColumn("ratio", near("h", "t"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "ord").orderBy(F.desc("ratio"), "line_no"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= most).select("doc_id", "ord", "rank", "line_no", "ratio")


def relevelled(lines: DataFrame, titles: DataFrame, matches: DataFrame, demote_unmatched: bool = True) -> DataFrame:
    """lines with matched headings at their title's level; other headings become ####, if asked for."""
    levels = matches.where("line_no IS NOT NULL").join(titles.select("doc_id", "ord", F.col("level").alias("new_level")), ["doc_id", "ord"]).select("doc_id", "line_no", "new_level")
    return levelled(lines, levels, demote_unmatched)


def levelled(lines: DataFrame, levels: DataFrame, demote_unmatched: bool = True) -> DataFrame:
    """relevelled() by levels(doc_id, line_no, new_level). A union instead of a join: lines that are dealt by document stay where they are."""
    rows = lines.withColumn("__own", F.lit(True)).unionByName(levels.select("doc_id", "line_no", "new_level").withColumn("__own", F.lit(False)), allowMissingColumns=True)
    rows = rows.withColumn("new_level", F.max("new_level").over(Window.partitionBy("doc_id", "line_no"))).where("__own")
    return rows.withColumn("line", _at_level(F.col("line"), F.col("new_level"), demote_unmatched)).select(lines.columns)


def _at_level(line: Column, level: Column, demote: bool) -> Column:
    level = F.coalesce(level, F.lit(4) if demote else F.lit(None).cast("int"))
    new = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text.heading_text(line))
    return F.when(text.is_heading(line) & level.isNotNull(), new).otherwise(line)


def restructured(lines: DataFrame, found: DataFrame, adjust: bool = True, demote_unmatched: bool = True) -> DataFrame:
    """levelled() by the matched and inserted() of the unmatched titles of found(doc_id, ord, title, level, line_no, at), in one pass over the lines."""
    matched = F.col("line_no").isNotNull()
    key = F.when(matched, F.col("line_no").cast("double")).otherwise(F.col("at") - 0.5)
    # a level comes right before its line; the key of a new heading is no line's
    new = found.select("doc_id", key.alias("key"), F.when(matched, 0).otherwise(1).alias("kind"), "ord", F.when(~matched, text.heading(F.col("title"), F.col("level"))).alias("line"), F.when(matched, F.col("level")).alias("new_level"), F.lit(False).alias("own"))
    rows = lines.select("doc_id", F.col("line_no").cast("double").alias("key"), F.lit(1).alias("kind"), F.lit(0).alias("ord"), "line", F.lit(None).cast("int").alias("new_level"), F.lit(True).alias("own")).unionByName(new)
    order = Window.partitionBy("doc_id").orderBy("key", "kind", "ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("line_no", (F.sum("kind").over(order) - 1).cast("int"))
    if adjust:
        rows = rows.withColumn("new_level", F.max("new_level").over(Window.partitionBy("doc_id", "key")))
        rows = rows.withColumn("line", F.when(F.col("own"), _at_level(F.col("line"), F.col("new_level"), demote_unmatched)).otherwise(F.col("line")))
    return rows.where("kind = 1").select("doc_id", "line_no", "line")


def anchors(titles: DataFrame, matches: DataFrame, heads: DataFrame) -> DataFrame:
    """For each unmatched title, the first headings equal to its neighbours by ideographs (or whole text): prev_line (else 0), next_line (else the last heading)."""
    importable(titles.sparkSession)

    @F.pandas_udf("array<struct<prev_line:int,next_line:int,asked:boolean>>")
    def told(ts: pd.Series, hs: pd.Series, us: pd.Series) -> pd.Series:
        return pd.Series([[{**n, "asked": x["ord"] in asked} for x, n in zip(t, between(t, h), strict=True)] for t, h, asked in zip(ts, hs, map(set, us), strict=True)])

    rows = gathered(titles, heads, matches.where("line_no IS NULL")).where(F.size("u") > 0).select("doc_id", "t", told("t", "h", "u").alias("m"))
    rows = rows.select("doc_id", F.inline(F.arrays_zip("t", "m"))).where("m.asked")
    return rows.select("doc_id", "t.ord", "t.title", "t.level", "m.prev_line", "m.next_line")


def page_windows(asked: DataFrame, paged: DataFrame, most: int = 5) -> DataFrame:
    """Pages that overlap each asked(doc_id, ord, prev_line, next_line), else the next `most` behind it: doc_id, ord, page_idx.

    paged(doc_id, page_idx, first_line, last_line). The range condition applies within a document's equi-join.
    """
    pairs = asked.join(paged, "doc_id").withColumn("hit", (F.col("last_line") >= F.col("prev_line")) & (F.col("first_line") <= F.col("next_line")))
    own = Window.partitionBy("doc_id", "ord")
    pairs = pairs.withColumns({"any": F.max("hit").over(own), "later": F.sum((F.col("first_line") > F.col("prev_line")).cast("int")).over(own.orderBy("page_idx"))})
    return pairs.where(F.col("hit") | (~F.col("any") & (F.col("first_line") > F.col("prev_line")) & (F.col("later") <= most))).select("doc_id", "ord", "page_idx")


def inserted(lines: DataFrame, places: DataFrame) -> DataFrame:
    """lines with a heading put before line `at` for each places(doc_id, ord, title, level, at), renumbered."""
    new = places.select("doc_id", (F.col("at") - 0.5).alias("key"), "ord", text.heading(F.col("title"), F.col("level")).alias("line"))
    both = lines.select("doc_id", F.col("line_no").cast("double").alias("key"), F.lit(0).alias("ord"), "line").unionByName(new)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("key", "ord")) - 1
    return both.select("doc_id", number.alias("line_no"), "line")


def page_bounds(lines: DataFrame) -> DataFrame:
    """First and last line of each page of marked lines."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("page_idx", F.last(text.page_index(F.col("line")), True).over(order)).where("page_idx IS NOT NULL")
    return rows.groupBy("doc_id", "page_idx").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def chosen(titles: DataFrame, heads: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """A candidate for each title: that of replies(doc_id, ord, line_no) if it is among the nearest three, else the nearest."""
    near = candidates(titles, heads)
    first = near.where("rank = 1").select("doc_id", "ord", F.col("line_no").alias("nearest"))
    if replies is None:
        return first.withColumnRenamed("nearest", "line_no")
    valid = replies.join(near.select("doc_id", "ord", "line_no"), ["doc_id", "ord", "line_no"], "left_semi")
    return first.join(valid, ["doc_id", "ord"], "left").select("doc_id", "ord", F.coalesce("line_no", "nearest").alias("line_no"))



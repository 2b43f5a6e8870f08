"""Steps that must grow no faster than their input: what meets in one task, how often a plan reads its input, and time on odd lines."""

from __future__ import annotations

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.functions import similarity, text
from quire.models import OfflineClient
from quire.operators import annotate, blocks, markdown, titles, toc
from quire.plans import catalog, rules


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def largest_share(spark, make) -> float:
    """The part of the rows that the largest of 8 tasks has."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "8", "-1"), strict=True):
            spark.conf.set(k, v)
        sizes = [r["count"] for r in make().groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    return max(sizes) / sum(sizes)


def many_lines(spark):
    """Lines of which most are blank or text, and some images."""
    return spark.range(8000).select((F.col("id") / 8).cast("int").alias("doc_id"), (F.col("id") % 8).cast("int").alias("line_no"), F.when(F.col("id") % 8 == 0, F.concat(F.lit("a_temp_images/p"), F.col("id").cast("string"), F.lit(".jpg"))).otherwise("").alias("line"))


def test_lines_without_image_are_spread_by_text_filter(spark):
    rows = markdown.link_images(many_lines(spark))
    found = rows.where(text.is_image_link(F.col("line"))).select(text.image_path(F.col("line")).alias("path"), (F.col("doc_id") % 5).alias("text_length"))
    assert largest_share(spark, lambda: markdown.keep_readable(rows, found)) < 0.3
    kept = {(r.doc_id, r.line_no) for r in markdown.keep_readable(rows, found).collect()}
    assert kept == {(d, n) for d in range(1000) for n in range(8) if n or d % 5 >= 3}


def test_lines_without_image_are_spread_by_existence(spark):
    rows = many_lines(spark)
    there = rows.where("line <> '' AND doc_id % 2 = 0").select(F.col("line").alias("path"))
    assert largest_share(spark, lambda: markdown.link_images(rows, there)) < 0.3
    assert markdown.link_images(rows, there).where(text.is_image_link(F.col("line"))).count() == 500


def test_image_report_spreads_lines_and_counts_all(spark, small):
    """Both sides of the report come from one reading of the lines' shuffle, and the filter's part is spread."""
    rows = markdown.link_images(many_lines(spark))
    found = spark.createDataFrame([("x", 1)], "path string, text_length int")
    assert largest_share(spark, lambda: markdown.keep_readable(rows.select("doc_id", "line"), found)) < 0.3
    total = catalog.image_filter_report(spark, small).agg(F.sum("found"), F.sum("kept"), F.sum("removed")).first()
    assert total[0] == total[1] + total[2] > 0


def test_strip_is_linear_and_takes_the_same_characters(spark):
    chars = spark.createDataFrame([(i, chr(i)) for i in range(1, 0x3100)], "i int, c string")
    odd = chars.where(text.strip(F.concat("c", F.lit("x"), "c")) != F.regexp_replace(F.concat("c", F.lit("x"), "c"), r"(?U)^\s+|\s+$", ""))
    assert odd.count() == 0
    long = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 200_000), F.lit("b")).alias("c"))
    began = time.time()
    assert long.select(F.length(text.strip(F.col("c"))).alias("n")).first().n == 200_002
    assert time.time() - began < 10


def test_blocks_compile(spark, small):
    """Methods of over 8000 bytes are never compiled by the JVM: every line would be rendered by its interpreter."""
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(catalog.typed_blocks(spark, small)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    sizes = [int(x.split(";")[0]) for x in code.split("maxMethodCodeSize:")[1:]]
    assert sizes and max(sizes) < 8000


@pytest.mark.parametrize("name, most", [("restore_pages", 7), ("cluster_order", 7), ("needs_model", 7)])
def test_page_queries_sort_objects_not_lines(spark, small, name, most):
    """One shuffle, and blanks are gone before a page's lines are sorted."""
    found = plan(rules.QUERIES.get(name, catalog.QUERIES.get(name))(spark, small))
    assert found.count("Exchange") == 1 and found.count("Sort [") <= most
    window = found.index("Window [last(mark")
    assert "Filter" in found[window:] and "ltrim" in found[window:]


def test_seen_blocks_reads_once(spark, small):
    assert plan(rules.seen_blocks(spark, small)).count("FileScan") == 1


def test_ablation_gathers_once(spark, small):
    found = plan(rules.structure_variations(spark, small))
    assert found.count("ArrowEvalPython") == 1 and found.count("FileScan") <= 2


def test_structure_walks_once(spark, small):
    """Lines, their levels and new titles: none is joined."""
    found = plan(catalog.structure_lines(spark, small))
    assert "Join" not in found and found.count("ArrowEvalPython") == 1


def test_restructured_is_levels_then_insertion(spark):
    lines = spark.createDataFrame([(d, i, x) for d in (1, 2, None) for i, x in enumerate(["# a", "t", "## b", "", "### c"])], "doc_id int, line_no int, line string")
    found = spark.createDataFrame([(1, 0, "a", 2, 0, 0), (1, 1, "n", 3, None, 2), (1, 2, "m", 1, None, 2), (1, 3, "c", 1, 4, 0), (2, 0, "z", 9, None, 0), (3, 0, "y", 1, None, 0)], "doc_id int, ord int, title string, level int, line_no int, at int")
    for adjust in (True, False):
        out = titles.levelled(lines, found.where("line_no IS NOT NULL").select("doc_id", "line_no", F.col("level").alias("new_level"))) if adjust else lines
        wanted = titles.inserted(out, found.where("line_no IS NULL").select("doc_id", "ord", "title", "level", "at"))
        got = titles.restructured(lines, found, adjust)
        assert got.schema.simpleString() == wanted.schema.simpleString() and sorted(map(repr, got.collect())) == sorted(map(repr, wanted.collect()))


def test_alignment_doesnt_join(spark, small):
    assert "Join" not in plan(catalog.align_ordered(spark, small))
    rows = spark.createDataFrame([(None, 0, "a", 1), (1, 0, "a", 1), (2, 0, "a", 1)], "doc_id int, ord int, title string, level int")
    heads = spark.createDataFrame([(None, 5, "a"), (1, 7, "a"), (3, 9, "a")], "doc_id int, line_no int, title string")
    assert {(r.doc_id, r.line_no) for r in titles.align(rows, heads).collect()} == {(None, None), (1, 7), (2, None)}


def test_anchors_dont_join(spark, small):
    assert "Join" not in plan(rules.title_anchors(spark, small))


def test_walk_of_many_equal_headings_is_fast():
    heads = [{"line_no": i, "title": f"{i} {'x' * 300}"} for i in range(3000)]
    asked = [{"ord": i, "title": f"none {i}"} for i in range(1500)]
    began = time.time()
    assert all(m["line_no"] is None for m in titles.walk(asked, heads, fuzzy=False))
    assert time.time() - began < 5


def test_title_scores_of_many_pairs(spark):
    """Each pair takes microseconds; as expressions over arrays, it took the better part of a millisecond."""
    rows = spark.range(60_000, numPartitions=4).select(F.concat(F.repeat(F.lit("甲"), (1 + F.col("id") % 37).cast("int")), F.repeat(F.lit("乙"), (F.col("id") % 41).cast("int"))).alias("h"), F.repeat(F.lit("甲"), (1 + F.col("id") % 37).cast("int")).alias("t"))
    began = time.time()
    found = rows.agg(F.sum(similarity.title_score(F.col("h"), F.col("t"))).alias("s"), F.min(similarity.ratio(F.col("h"), F.col("t"))).alias("r")).first()
    assert found.s > 0 and found.r > 0 and time.time() - began < 20
    nulls = spark.createDataFrame([("a", None), (None, "a"), (None, None)], "h string, t string")
    assert [tuple(r) for r in nulls.select(similarity.title_score(F.col("h"), F.col("t")), similarity.ratio(F.col("h"), F.col("t"))).collect()] == [(0.0, None)] * 3


def test_contents_scores_by_plain_search(spark, small):
    """Words are sought one by one, and the score is what patterns give."""
    found = plan(catalog.toc_score(spark, small))
    assert "chapter|section" not in found and "contents|index" not in found
    pieces = ["1. Alpha ... 12", "2 Beta", "3-4", "Chapter", "附录 …… x", "………", "12 Gamma 9", "part", " ", "...7", "5.", "v1.2"]
    rows = spark.range(4000).select(F.array(*[F.element_at(F.array(*map(F.lit, pieces)), (F.abs(F.xxhash64("id", F.lit(k))) % len(pieces) + 1).cast("int")) for k in range(2)]).alias("x")).select(F.trim(F.array_join("x", " ")).alias("line")).distinct()
    signs = [(2, r"^\d+\.?\s+[A-Za-z一-鿿]"), (2, r"\.{3,}\s*\d+\s*$"), (1, r"\.{3,}|…{3,}"), (1, r"\d+[\.-]\d+"), (2, r"^\d+\s+[A-Za-z一-鿿].*\s+\d+$"), (1, "(?i)" + toc.any_of(toc.CHAPTERS))]
    wanted = sum((w * F.col("line").rlike(p).cast("int") for w, p in signs), F.lit(0))
    assert rows.where(toc.line_score(F.col("line")) != wanted).count() == 0 < rows.count()


def test_contents_removal_by_plain_search(spark, small):
    assert "chapter|section" not in plan(catalog.toc_pages_removed(spark, small))


def test_annotation_makes_items_once(spark, small):
    found = plan(catalog.image_annotation(spark, small))
    assert found.count("FileScan") == 1


def test_annotation_in_place_is_that_by_join(spark, small):
    items = catalog.items(spark, small)
    members = annotate.runs(items)
    joined = annotate.annotated(members, annotate.described(annotate.contexts(members)))
    found = annotate.asked_in_place(members)
    assert found.columns == joined.columns and sorted(map(repr, found.collect())) == sorted(map(repr, joined.collect()))


def test_model_is_asked_once_a_run(spark, tmp_path):
    class Counting(OfflineClient):
        def describe(self, images, context):
            with open(f"{tmp_path}/calls", "a") as f:
                f.write("|".join(images) + "\n")
            return super().describe(images, context)

    lines = [(1, 0, i, line) for i, line in enumerate(["# A", "![](a.jpg)", "![](b.jpg)", "t", "![](c.jpg)"])] + [(2, 0, 0, "only text")]
    items = blocks.clusters(blocks.blocks(spark.createDataFrame(lines, "doc_id int, page_idx int, pos int, line string")))
    found = {r.pos: (r.data_type, r.group_id, r.description) for r in annotate.asked_in_place(annotate.runs(items), Counting()).collect()}
    assert Counter((tmp_path / "calls").read_text().split()) == {"![](a.jpg)|![](b.jpg)": 1, "![](c.jpg)": 1}
    assert found[0][1] == found[1][1] != found[3][1] and found[0][2] and found[1][2] is None and found[2][:2] == ("text", None)

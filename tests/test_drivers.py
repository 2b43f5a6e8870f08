"""Model drivers, call policy, files that can't be read, presets."""

from __future__ import annotations

import time

import pytest

import quire
from quire import models
from quire.operators import annotate, titles
from quire.plans import drivers, pipeline
from quire.sources import files


def test_broken_files_are_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"type":"text","page_idx":0,"text":"x"}]')
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text('{"not":"a list"}')
    good, failed = files.checked(spark, str(tmp_path))
    assert [r.doc_id for r in good.collect()] == ["a"] and {r.doc_id: r.error for r in failed.collect()} == {"b": "isn't JSON", "c": "isn't a list"}
    report = drivers.batch_report(good, failed).first()
    assert (report.total, report.ok, report.failed) == (3, 1, 2)
    with pytest.raises(Exception, match="isn't"):
        files.checked(spark, str(tmp_path), fail_fast=True)[0].collect()


def test_samples_are_few(spark, tmp_path):
    for i in range(7):
        (tmp_path / f"{i}.jpg").write_bytes(bytes([i]))
    assert files.samples(spark, str(tmp_path), 3) == [b"\x00", b"\x01", b"\x02"]


class Flaky:
    def __init__(self, errors):
        self.errors, self.calls = list(errors), []

    def outline(self, image, examples):
        self.calls.append(len(image))
        if self.errors:
            raise self.errors.pop(0)
        return "done"

    def place(self, title, lines):
        time.sleep(3)


def test_call_policy():
    client = Flaky([models.TooManyRequests(0.01), ValueError(), models.TooLarge()])
    shrink = lambda image, quality: image[: len(image) * quality // 100]
    assert models.Retrying(client, wait=0.01, encode=shrink).outline(b"x" * 1000, []) == "done" and client.calls[:3] == [1000] * 3 and client.calls[3] <= 500
    with pytest.raises(ValueError):
        models.Retrying(Flaky([ValueError()] * 3), wait=0.01).outline(b"", [])
    with pytest.raises(TimeoutError):
        models.Retrying(Flaky([]), attempts=1, timeout=0.1).place("", [])
    with pytest.raises(models.TooLarge):
        models.Retrying(Flaky([models.TooLarge()] * 9)).outline(b"x", [])
    assert models.shrunk(b"x" * 1000, shrink, 700) == b"x" * 700 and models.shrunk(b"x", shrink, 5) == b"x" and len(models.shrunk(b"x" * 1000, shrink, 0)) == 50


def test_settings():
    assert pipeline.loaded(pipeline.Structure, {"title_similarity_threshold": 0.5}).title_similarity_threshold == 0.5
    for bad in ({"nothing": 1}, {"title_similarity_threshold": 2}):
        with pytest.raises(ValueError):
            pipeline.loaded(pipeline.Structure, bad)
    assert not pipeline.preset("fast").text_detection and pipeline.preset("high_quality").min_text_length == 5
    with pytest.raises(ValueError):
        pipeline.preset("none")


def test_confidence_of_places_counts(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["# A", "a", "b", "# C"])], "doc_id int, line_no int, line string")
    found = spark.createDataFrame([(1, 0, "A", 1), (1, 1, "B", 2), (1, 2, "C", 1)], "doc_id int, ord int, title string, level int")
    places = spark.createDataFrame([(1, 1, 2, 0.75)], "doc_id int, ord int, at int, confidence double")
    at = {}
    for threshold in (0.7, 0.8):
        rows, _ = pipeline.structure(lines, found, pipeline.Structure(insert_confidence_threshold=threshold), places)
        at[threshold] = next(r.line_no for r in rows.collect() if r.line == "## B")
    assert at == {0.7: 2, 0.8: 0}


def test_structure_by_replies(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["# A", "text", "## C"])], "doc_id int, line_no int, line string")
    replies = drivers.outline_replies(spark.createDataFrame([(1, b"A\n    B\n    C"), (2, b"")], "doc_id int, image binary"))
    rows, matches = drivers.structure(lines, replies)
    assert [r.line for r in sorted(rows.collect(), key=lambda r: r.line_no)] == ["## B", "# A", "text", "## C"]
    assert {r.ord: r.line_no for r in matches.collect()} == {0: 0, 1: None, 2: 2}


def test_pages_are_rendered_by_the_provider(spark):
    pages = spark.createDataFrame([(1, 2, b"pdf")], "doc_id int, page_num int, content binary")
    assert bytes(drivers.page_images(pages, models.OfflineClient()).first().image) == b"3:2:3"


def test_levels_of_deep_trees(spark):
    tree = '[{"title":"A","subtitles":[{"title":"B","subtitles":[{"title":"C","subtitles":[{"title":"D","subtitles":[{"title":"E"}]}]}]}]}]'
    found = titles.flatten(spark.createDataFrame([(1, tree)], "doc_id int, tree string"))
    assert [(r.title, r.level) for r in sorted(found.collect(), key=lambda r: r.ord)] == [("A", 1), ("B", 2), ("C", 3), ("D", 4), ("E", 4)]


def test_headings_need_a_text_and_the_first_column(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["# A", "##", " # B", "##C", "### "])], "doc_id int, line_no int, line string")
    assert [r.title for r in titles.headings(lines).orderBy("line_no").collect()] == ["A", "C"]


def test_long_contexts_lose_their_middle(spark):
    df = spark.createDataFrame([([str(i) for i in range(9)],)], "x array<string>")
    assert df.select(annotate.shortened(df.x, 4), annotate.shortened(df.x, 9)).first() == (["0", "1", "7", "8"], [str(i) for i in range(9)])


def test_figures_in_a_row_are_one(spark):
    rows = [(1, 0, 0, i, k, f"t{i}") for i, k in enumerate(["组合图", "组合图", None, "组合图", "统计图"])]
    found = annotate.figure_tags(spark.createDataFrame(rows, "doc_id int, page_idx int, item int, pos int, kind string, data_type string"))
    assert sorted((r["first"], r.n, r.tag) for r in found.collect()) == [(0, 2, "t0+t1"), (3, 1, "t3")]


def test_files_tell_their_size(spark, tmp_path):
    (tmp_path / "300497.SZ-富祥药业-2024年度报告.json").write_text('{"pages":[1]}')
    row = files.metadata(spark, str(tmp_path)).first()
    assert row.form == "pages" and row.metadata["company_name"] == "富祥药业" and row.metadata["file_size_bytes"] == "13" and row.metadata["file_modified_time"]


def test_quick_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"type":"text","page_idx":0,"text":"A","text_level":1},{"type":"text","page_idx":0,"text":"x"}]')
    lines = quire.preprocess(spark, str(tmp_path), add_page_markers=False)
    assert "# A" in [r.line for r in lines.collect()]
    rows, _ = quire.structure(lines, spark.createDataFrame([("a", "### 最终输出结果\nA\n    B")], "doc_id string, reply string"))
    assert "## B" in [r.line for r in rows.collect()]


def test_images_and_pages_go_through_providers(spark):
    images = spark.createDataFrame([("p", b" abc "), ("q", b"")], "path string, content binary")
    assert {r.path: r.text_length for r in drivers.text_lengths(images, models.OfflineClient()).collect()} == {"p": 3, "q": 0}
    pdfs = spark.createDataFrame([(1, b"a"), (2, b"b")], "doc_id int, content binary")
    cut = drivers.without_pages(pdfs, spark.createDataFrame([(1, 3), (1, 2), (1, 3)], "doc_id int, page_num int"), models.OfflineClient())
    assert {r.doc_id: bytes(r.content) for r in cut.collect()} == {1: b"a without [2, 3]", 2: b"b"}

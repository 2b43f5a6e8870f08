"""Rules that the driver's tables don't reach, against hand-made cases and row-at-a-time versions."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import replies, similarity, text
from quire.models import Fallback, OfflineClient, Retrying
from quire.operators import annotate, blocks, files, markdown, reports, titles, toc
from quire.plans import pipeline
from quire.sources import files as scans
from quire.sources import sinks
from quire.streaming import inbox


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'int'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(expr.alias("x")).first().x


def lcs_plain(a, b):
    before = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(before[j] + 1 if x == y else max(before[j + 1], now[-1]))
        before = now
    return before[-1]


def test_lcs_forms_agree(spark):
    random.seed(7)
    pairs = [("".join(random.choices("ab治理", k=random.randint(0, 9))), "".join(random.choices("ab治理", k=random.randint(0, 9)))) for _ in range(60)]
    found = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string").select("a", "b", similarity.lcs(F.col("a"), F.col("b")).alias("n"), similarity.title_score(F.col("a"), F.col("b")).alias("s"), similarity.title_score(F.col("a"), F.col("b"), 0.8, True).alias("c")).collect()
    for r in found:
        assert r.n == similarity.lcs_length(r.a, r.b) == lcs_plain(r.a, r.b)
        assert r.s == pytest.approx(similarity.score(r.a, r.b)) and r.c == pytest.approx(similarity.score(r.a, r.b, 0.8, True))


def walk_plain(ts, hs):
    out, at, taken = [], 0, set()
    for t in ts:
        exact = [m for m in range(at, len(hs)) if m not in taken and similarity.score(hs[m], t) == 1.0]
        near = [(similarity.score(hs[m], t), -m) for m in range(at, len(hs)) if m not in taken]
        best = exact[0] if exact else -max(near)[1] if near and max(near)[0] > 0 else None
        out.append(best)
        if best is not None:
            taken.add(best)
            at = best + 1
    return out


def test_alignment(spark):
    random.seed(3)
    words = ["环境", "能源管理", "公司治理", "社会", "附录", "水", "Intro", "Intro x"]
    ts, hs = [], []
    for d in range(12):
        h = [random.choice(words) + random.choice(["", "体系", "x"]) for _ in range(random.randint(0, 8))]
        t = [random.choice(words) for _ in range(random.randint(1, 6))]
        hs += [(d, i * 2, x) for i, x in enumerate(h)]
        ts += [(d, i, x, 1) for i, x in enumerate(t)]
    t, h = spark.createDataFrame(ts, "doc_id int, ord int, title string, level int"), spark.createDataFrame(hs, "doc_id int, line_no int, title string")
    found = {(r.doc_id, r.ord): r.line_no for r in titles.align(t, h).collect()}
    for d in range(12):
        mine = walk_plain([x[2] for x in ts if x[0] == d], [x[2] for x in hs if x[0] == d])
        assert [found[d, i] for i in range(len(mine))] == [None if m is None else 2 * m for m in mine]
        lines = [x for x in (found[d, i] for i in range(len(mine))) if x is not None]
        assert lines == sorted(set(lines))
    best = {(r.doc_id, r.ord): r.line_no for r in titles.best_matches(t, h).collect()}
    for d, o, x, _ in ts:
        scored = [(similarity.score(y[2], x), -y[1]) for y in hs if y[0] == d]
        assert best[d, o] == (-max(scored)[1] if scored and max(scored)[0] > 0 else None)
    assert titles.candidates(t, h).where("rank > 3").count() == 0
    assert titles.chosen(t, h).count() == len({(x[0], x[1]) for x in ts if any(y[0] == x[0] for y in hs)})


def test_missing_titles_are_inserted(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["<page_idx:0>", "# 总则", "text", "## 附录", "end"])], "doc_id int, line_no int, line string")
    wanted = spark.createDataFrame([(1, 0, "总则", 1), (1, 1, "治理", 2), (1, 2, "附录", 1)], "doc_id int, ord int, title string, level int")
    out, matches = pipeline.structure(lines, wanted)
    assert [r.line for r in out.orderBy("line_no").collect()] == ["<page_idx:0>", "## 治理", "# 总则", "text", "# 附录", "end"]
    asked = titles.anchors(wanted, matches, titles.headings(lines))
    assert [(r.prev_line, r.next_line) for r in asked.collect()] == [(1, 3)]
    assert [r.page_idx for r in titles.page_windows(asked, titles.page_bounds(lines)).collect()] == [0]
    with pytest.raises(ValueError):
        pipeline.varied(pipeline.Structure(), "nothing", pipeline.STRUCTURE_ABLATIONS)
    assert pipeline.Structure(title_similarity_threshold=2).errors() and not pipeline.Preprocess().errors()


def grouped(spark, rows):
    return spark.createDataFrame([(1, p, i, x) for i, (p, x) in enumerate(rows)], "doc_id int, page_idx int, pos int, line string")


def test_blocks_bind_and_inherit(spark):
    table = "<html><body><table><tr><td>1</td></tr></table></body></html>"
    rows = [(0, "# A"), (0, "![](a.jpg)"), (0, "![](b.jpg)"), (0, table), (0, "##### five"), (1, "## B"), (1, "![](c.jpg)"), (1, "### C"), (1, table), (1, "#x"), (2, "# D"), (2, "t"), (2, '<div><html><body><table border="1"></table></body></html></div>')]
    found = {(r.page_idx, r.reading_order): r for r in blocks.blocks(grouped(spark, rows)).collect()}
    assert found[0, 0].data == "![](a.jpg)" and found[0, 1].table_path == "![](b.jpg)" and found[0, 2].data == "##### five"
    assert (found[1, 0].h1, found[1, 0].h2, found[1, 0].h3) == ("A", "B", None) and found[1, 1].table_path is None and found[1, 1].h3 == "C"
    assert (found[2, 0].h1, found[2, 0].h2) == ("D", None) and found[2, 1].data_type == "text"
    assert blocks.blocks(grouped(spark, rows), tolerant=True).where("page_idx = 2 AND data_type = 'table'").count() == 1
    items = blocks.clusters(blocks.blocks(grouped(spark, rows)))
    assert [r.data_type for r in items.where("page_idx = 0").orderBy("item").collect()] == ["cluster[image,table,text]"]
    assert blocks.to_json_form(blocks.blocks(grouped(spark, rows))).where("h4 = 'null'").count() == len(found)
    back = blocks.restored(items)
    assert back.count() == len(found) and back.where("ordinal IS NOT NULL").count() == 2
    assert one(spark, blocks.cluster_types(F.col("t")), t="cluster[image<image[1][a]>,text]") == ["image<image[1][a]>", "text"]


def test_annotation(spark):
    rows = [(0, "# A"), (0, "before"), (0, "![](a.jpg)"), (0, "![](b.jpg)"), (0, "after"), (0, "![](c.jpg)")]
    members = annotate.runs(blocks.clusters(blocks.blocks(grouped(spark, rows))))
    asked = {r.run: r for r in annotate.contexts(members).collect()}
    assert asked[1].images == ["![](a.jpg)", "![](b.jpg)"] and asked[1].context == "H1: A\n前文 1 (text): before\n后文 4 (text): after"
    assert asked[2].images == ["![](c.jpg)"] and asked[2].context == "H1: A\n前文 4 (text): after"
    done = annotate.annotated(members, annotate.described(annotate.contexts(members), slots=2)).orderBy("pos").collect()
    assert [r.description is not None for r in done] == [False, True, False, False, True] and done[1].group_id == done[2].group_id
    assert done[1].data_type.startswith("image<image[1][") and Fallback(None, OfflineClient()).choose("t", ["x"]) == "选择：x" and Retrying(OfflineClient()).place("t", []) == "位置：1"


def test_replies(spark):
    assert one(spark, replies.global_line(F.col("r"), F.lit(2), F.lit(9)), r="插入全局行号：15") == 2
    assert one(spark, replies.global_line(F.col("r"), F.lit(2), F.lit(9)), r="插入位置：无") is None
    assert one(spark, replies.choice(F.col("r"), F.array(F.lit("a"), F.lit("b"))), r="选择：b") == "b" and one(spark, replies.choice(F.col("r"), F.array(F.lit("a"))), r="选择：b") is None
    kind, said = replies.kind_and_text(F.col("r"))
    assert (one(spark, kind, r="统计图 up and up"), one(spark, said, r="统计图 up and up")) == ("统计图", "up and up") and one(spark, said, r="nothing") == "nothing"
    assert one(spark, replies.json_array(F.col("r")), r='so: [{"title": "a"}] ok') == '[{"title": "a"}]' and one(spark, replies.json_array(F.col("r")), r="no [") is None
    assert json.loads(one(spark, replies.repaired_json(F.col("r")), r="```json\n[{title: 'a', subtitles: [],}]\n```")) == [{"title": "a", "subtitles": []}]
    assert one(spark, replies.repaired_json(F.col("r")), r="{") == "[]"


def test_text(spark):
    assert one(spark, text.strip(F.col("s")), s="　 a b\t") == "a b" and one(spark, text.collapse(F.col("s")), s=" a \n b ") == "a b"
    assert one(spark, text.quote(F.col("s")), s="a b/ü*~+:") == "a%20b/%C3%BC%2A~%2B%3A" and one(spark, text.unquote(F.col("s")), s="a+%20b") == "a+ b"
    assert one(spark, text.unquote(F.col("s")), s="100%") == "100%" and one(spark, text.page_index(F.col("s"), True), s="<page_idx：[7>") == 7
    assert one(spark, text.image_path(F.col("s")), s="![](d/a.PNG)") == "d/a.PNG" and one(spark, text.stem(F.col("s")), s="/x/a.b.json") == "a.b" and one(spark, text.extension(F.col("s")), s="/x/a.JPG") == ".jpg"
    assert one(spark, text.heading(F.col("s"), F.lit(9)), s=" t ") == "###### t" and one(spark, text.megabytes(F.lit(1572864))) == 1.5
    assert one(spark, text.is_table_pattern(F.col("s")), s="## a|b") and not one(spark, text.is_table_line(F.col("s")), s="## a|b")
    assert one(spark, toc.has_keyword(F.col("s")), s="department") and not one(spark, toc.has_keyword(F.col("s"), True), s="department")
    assert one(spark, markdown.pipe_table(F.col("s")), s="<table><tr><td>a</td><td><b>b</b></td></tr></table>") == "a | b"


def test_files(spark, tmp_path):
    names = ["a/x_preprocessed.md", "a/page_1.jpg", "a/zz.jpg", "b/y_preprocessed.md", "b/k.JPG", "c/only.md", "a/r.json", "a/batch_log.json", "a/.h.json"]
    for n in names:
        (tmp_path / "in" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / n).write_text("[]")
    found = scans.listing(spark, str(tmp_path / "in"))
    assert {(r.folder, r.toc_image) for r in files.work_items(found).collect()} == {("a", "page_1.jpg"), ("b", "k.JPG")}
    assert [r.name for r in files.report_files(found).collect()] == ["r.json"] and scans.images(spark, str(tmp_path / "in")).count() == 3 and scans.pdfs(spark, str(tmp_path / "in")).count() == 0
    assert {r.folder for r in files.by_folder(found, ["c"]).collect()} == {"a", "b"}
    pairs = files.paired(spark.createDataFrame([("20240101_r",), ("q",)], "report string"), spark.createDataFrame([("r_without_toc",)], "images string"))
    assert [tuple(r) for r in pairs.collect()] == [("20240101_r", "r_without_toc")]
    jsons = spark.createDataFrame([("/r/1-b-2024年度c.json", '{"pages": [1]}'), ("/r/x.json", '{"metadata": {"own": "1", "report_type": "z"}, "pages": []}'), ("/r/y.json", '[{"data_type": "text"}]'), ("/r/z.json", "7")], "path string, json string")
    got = {r.path[3:4]: r for r in files.envelope(jsons).collect()}
    assert {k: r.form for k, r in got.items()} == {"1": "pages", "x": "existing", "y": "blocks", "z": "raw"} and got["x"].metadata["own"] == "1" and got["x"].metadata["report_type"] == "未知类型" and json.loads(got["1"].content) == [1]


def test_end_to_end_with_stream(spark, tmp_path):
    page = [{"type": "text", "page_idx": 0, "text": "Head", "text_level": 1}, {"type": "image", "page_idx": 0, "img_path": "r_temp_images/a.jpg"}, {"type": "equation", "page_idx": 0}, {"type": "table", "page_idx": 1, "img_path": "r_temp_images/t.jpg", "table_body": "<html><body><table><tr><td>1</td></tr></table></body></html>"}, {"type": "text", "page_idx": 1, "text": "body"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/600000.SH-X-2024年度报告.json").write_text(json.dumps(page))
    (tmp_path / "in/broken.json").write_text("{")
    objects = scans.layouts(spark, str(tmp_path / "in"))
    assert objects.count() == 5
    lines = pipeline.preprocess(objects)
    names = objects.select("doc_id", F.concat(F.lit("/x/"), "doc_id", F.lit(".json")).alias("path")).distinct()
    report = pipeline.final_reports(lines, names).first()
    assert report.metadata.report_year == 2024 and [len(p.content) for p in report.pages] == [1, 2] and report.pages[1].content[0].table_path == "![](r_temp_images/t.jpg)"
    sinks.write_report(pipeline.final_reports(lines, names), str(tmp_path / "report"))
    sinks.write_markdown(lines, str(tmp_path / "md"))
    sinks.write_pages(markdown.pages(lines), str(tmp_path / "pages"))
    sinks.write_records(pipeline.page_records(lines), str(tmp_path / "records"))
    again = scans.markdown(spark, str(tmp_path / "pages"), "*.txt")
    assert markdown.pages(scans.bracketed(again)).count() == markdown.pages(lines).count()
    good = sinks.split_failed(spark.createDataFrame([(1, None), (2, "bad")], "doc_id int, error string"), str(tmp_path / "q"))
    assert good.count() == 1 and spark.read.parquet(str(tmp_path / "q/failed")).count() == 1
    query = inbox.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), available_now=True)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    variants = pipeline.ablation(objects, pipeline.Inputs(image_text=spark.createDataFrame([("r_temp_images/a.jpg", 2, 50.0)], "path string, text_length int, confidence double")))
    kept = {r.experiment: r.n for r in variants.where(text.is_image_link(F.col("line"))).groupBy("experiment").agg(F.count("*").alias("n")).collect()}
    assert kept == {"no_text_detection": 2, "no_image_validation": 1, "high_confidence": 1, "low_confidence": 2}


def test_reports(spark):
    log = spark.createDataFrame([("a", 1, "s", True, 1.0, 2), ("a", 2, "s", False, 1.0, 1)], "experiment string, doc_id int, stage string, success boolean, duration double, operations int")
    assert tuple(reports.batch_summary(log).first()) == (2, 1, 1, 0.5) and tuple(reports.batch_summary(log.limit(0)).first()) == (0, 0, 0, 0.0)
    assert reports.statistics(log).first().success_rate == 0.5 and reports.succeeded(log, log.where("NOT success")).count() == 1
    assert tuple(reports.url_counts(spark.createDataFrame([("a", None), ("b", "b")], "u string, fixed string")).first()) == (2, 1)


def test_titles_of_any_depth(spark):
    tree = "deepest"
    for k in range(7, 0, -1):
        tree = {"title": f"t{k}", "subtitles": [tree, {"title": f"o{k}"}]}
    df = spark.createDataFrame([(1, json.dumps([tree])), (2, json.dumps(["flat"]))], "doc_id int, tree string")
    names = [f"t{k}" for k in range(1, 8)]
    last = [f"o{k}" for k in range(7, 0, -1)]
    by_depth = [(r.title, r.level) for r in titles.flatten(df, "depth").where("doc_id = 1").orderBy("ord").collect()]
    assert by_depth == [*zip(names, range(1, 8)), ("deepest", 8), *zip(last, range(8, 1, -1))]
    chain = {"title": "e"}
    for x in "dcba":  # a first subtitle that is an object without subtitles makes no title of level 2: d goes by its parent
        chain = {"title": x, "subtitles": [chain, f"s{x}"]}
    levels = {r.title: r.level for r in titles.flatten(spark.createDataFrame([(1, json.dumps([chain]))], "doc_id int, tree string")).collect()}
    assert levels == {"a": 1, "sa": 3, "b": 2, "sb": 3, "c": 3, "sc": 4, "d": 4, "sd": 4, "e": 4}

"""The queries over the reference's own operators, on the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import annotate, blocks, files, markdown, reports, titles, toc
from quire.plans import pipeline

# ---------------------------------------------------------------- inputs


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line_no", "line"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout objects made from the lines of documents: headings, images and tables at fixed places."""
    m, r = F.col("line_no") % 8, (F.col("doc_id") + F.col("line_no")) % 7
    kind = F.when(r == 5, "image").when(r == 6, "table").otherwise("text")
    path = F.when(kind != "text", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("_temp_images/p"), F.col("line_no").cast("string"), F.lit(".jpg")))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    body = F.concat(F.lit("<html><body><table><tr>"), cell(F.lit("page")), cell((F.col("line_no") / 8).cast("int").cast("string")), F.lit("</tr><tr>"), cell(F.lit("<b>row</b>")), cell(F.col("line_no").cast("string")), F.lit("</tr></table></body></html>"))
    level = F.when(m == 0, 1).when(m == 3, 2).when((m == 5) & (r < 2), 3)
    return lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("obj_no"), kind.alias("type"), (F.col("line_no") / 8).cast("int").alias("page_idx"), F.col("line").alias("text"), F.when(kind == "text", level).alias("text_level"), path.alias("img_path"), F.when(kind == "table", body).alias("table_body"))


_LINES = "lines AS (SELECT doc_id, CAST(u.ord - 1 AS INT) AS line_no, u.line FROM documents, unnest(string_split(coalesce(text, ''), chr(10))) WITH ORDINALITY AS u(line, ord))"
_OBJECTS = _LINES + """,
kinds AS (SELECT *, line_no // 8 AS page_idx, line_no % 8 AS m, (doc_id + line_no) % 7 AS r FROM lines),
objects AS (SELECT doc_id, line_no AS obj_no, CASE r WHEN 5 THEN 'image' WHEN 6 THEN 'table' ELSE 'text' END AS type, page_idx, line AS text,
    CASE WHEN r >= 5 THEN NULL WHEN m = 0 THEN 1 WHEN m = 3 THEN 2 WHEN m = 5 AND r < 2 THEN 3 END AS text_level,
    CASE WHEN r >= 5 THEN 'd' || doc_id || '_temp_images/p' || line_no || '.jpg' END AS img_path,
    CASE WHEN r = 6 THEN '<html><body><table><tr><td>page</td><td>' || page_idx || '</td></tr><tr><td><b>row</b></td><td>' || line_no || '</td></tr></table></body></html>' END AS table_body FROM kinds)"""
_STRIP = lambda c: rf"regexp_replace({c}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_MD = _OBJECTS + f""",
parts AS (SELECT doc_id, obj_no, CASE type
    WHEN 'image' THEN ['<page_idx:' || page_idx || '>', img_path, '', '']
    WHEN 'table' THEN ['<page_idx:' || page_idx || '>', img_path, '<page_idx:' || page_idx || '>', table_body, '', '']
    ELSE ['<page_idx:' || page_idx || '>', coalesce(repeat('#', text_level) || ' ', '') || {_STRIP("text")}, '', ''] END AS p FROM objects),
md AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY obj_no, u.ord) - 1 AS INT) AS line_no, u.line FROM parts, unnest(p) WITH ORDINALITY AS u(line, ord)),
linked AS (SELECT doc_id, line_no, CASE WHEN contains(l, '_temp_images/') AND regexp_matches(l, '\\.jpg$') THEN '![](' || l || ')' ELSE l END AS line FROM (SELECT *, {_STRIP("line")} AS l FROM md))"""
_PAGES = _MD + r""",
marked AS (SELECT *, TRY_CAST(nullif(regexp_extract(line, '^<page_idx:(\d+)>', 1), '') AS INT) AS mark FROM linked),
filled AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS page_idx FROM marked),
paged AS (SELECT doc_id, page_idx, CAST(row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY line_no) - 1 AS INT) AS pos, line FROM filled WHERE mark IS NULL AND page_idx IS NOT NULL AND line <> '')"""
_BLOCKS = _PAGES + r""",
kinded AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,4} ') THEN length(regexp_extract(line, '^(#{1,4}) ', 1))::VARCHAR
    WHEN regexp_matches(line, '^!\[\]\(.+\)$') THEN 'image' WHEN starts_with(line, '<html>') AND contains(line, '<table>') THEN 'table' ELSE 'text' END AS kind FROM paged),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_idx, pos) AS n FROM kinded),
heads AS (SELECT *, """ + ", ".join(f"last_value(CASE WHEN kind = '{k}' THEN n END IGNORE NULLS) OVER w AS n{k}, last_value(CASE WHEN kind = '{k}' THEN substr(line, {k + 2}) END IGNORE NULLS) OVER w AS t{k}" for k in (1, 2, 3, 4)) + r""",
    lead(kind) OVER (PARTITION BY doc_id, page_idx ORDER BY pos) AS after, lag(kind) OVER (PARTITION BY doc_id, page_idx ORDER BY pos) AS before, lag(line) OVER (PARTITION BY doc_id, page_idx ORDER BY pos) AS above
    FROM seq WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
blocks AS (SELECT doc_id, page_idx, CAST(row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY pos) - 1 AS INT) AS reading_order, t1 AS h1,
    CASE WHEN n2 > coalesce(n1, 0) THEN t2 END AS h2, CASE WHEN n3 > greatest(coalesce(n1, 0), coalesce(n2, 0)) THEN t3 END AS h3,
    CASE WHEN n4 > greatest(coalesce(n1, 0), coalesce(n2, 0), coalesce(n3, 0)) THEN t4 END AS h4,
    kind AS data_type, line AS data, CASE WHEN kind = 'table' AND before = 'image' THEN above END AS table_path
    FROM heads WHERE NOT regexp_matches(kind, '^[1-4]$') AND NOT (kind = 'image' AND coalesce(after, '') = 'table'))"""
_CLUSTERS = _BLOCKS + """,
groups AS (SELECT doc_id, page_idx, h1, h2, h3, h4, min(reading_order) AS first_order, count(*) AS n, count(*) FILTER (data LIKE '![%') AS images,
    string_agg(data_type, ',' ORDER BY reading_order) AS types, string_agg(reading_order::VARCHAR, ',' ORDER BY reading_order) AS orders FROM blocks GROUP BY ALL),
items AS (SELECT doc_id, page_idx, h1, h2, h3, h4, first_order, 'cluster[' || types || ']' AS data_type, orders, n FROM groups WHERE images > 0 AND images < n
    UNION ALL SELECT b.doc_id, b.page_idx, b.h1, b.h2, b.h3, b.h4, b.reading_order, b.data_type, b.reading_order::VARCHAR, 1 FROM blocks b JOIN groups g ON b.doc_id = g.doc_id AND b.page_idx = g.page_idx
        AND b.h1 IS NOT DISTINCT FROM g.h1 AND b.h2 IS NOT DISTINCT FROM g.h2 AND b.h3 IS NOT DISTINCT FROM g.h3 AND b.h4 IS NOT DISTINCT FROM g.h4 WHERE NOT (images > 0 AND images < n))"""
_LOG = "log AS (SELECT 'e' || (user_id % 4) AS experiment, user_id AS doc_id, event_type AS stage, event_id % 7 <> 0 AS success, value AS duration, event_id % 5 AS operations FROM events)"


def md(spark, d):
    return markdown.link_images(markdown.render(objects(spark, d)))


def paged(spark, d):
    return markdown.pages(md(spark, d))


def block_rows(spark, d):
    return blocks.blocks(paged(spark, d))


def items(spark, d):
    return blocks.clusters(block_rows(spark, d))


def pages_of(spark, d):
    """Eight lines of a document are a page."""
    rows = lines(spark, d).groupBy("doc_id", (F.col("line_no") / 8).cast("int").alias("page_num"))
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"))


_TEXTS = _LINES + ", pages_ AS (SELECT doc_id, line_no // 8 AS page_num, string_agg(line, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY ALL)"
_RE = lambda words: "|".join(w for w in words)
_TOC = _TEXTS + rf""",
scored_lines AS (SELECT doc_id, page_num, {_STRIP("u.line")} AS line FROM pages_, unnest(string_split(text, chr(10))) AS u(line)),
scores AS (SELECT doc_id, page_num, sum(CASE WHEN line = '' THEN 0 ELSE 2 * regexp_matches(line, '^\d+\.?\s+[A-Za-z\x{{4e00}}-\x{{9fff}}]')::INT + 2 * regexp_matches(line, '\.{{3,}}\s*\d+\s*$')::INT + regexp_matches(line, '\.{{3,}}|…{{3,}}')::INT
    + regexp_matches(lower(line), '{_RE(toc.CHAPTERS)}')::INT + regexp_matches(line, '\d+[\.-]\d+')::INT + 2 * regexp_matches(line, '^\d+\s+[A-Za-z\x{{4e00}}-\x{{9fff}}].*\s+\d+$')::INT END)::INT AS toc_score,
    count(*) FILTER (line <> '')::INT AS toc_lines FROM scored_lines GROUP BY ALL),
toc AS (SELECT p.doc_id, p.page_num, toc_score, toc_lines, regexp_matches(lower(text), '{_RE(toc.KEYWORDS)}') OR (NOT regexp_matches(lower(text), '{_RE(toc.REPORTS)}') AND toc_lines > 0
    AND ((toc_score > 0.5 * toc_lines AND toc_score >= 5) OR toc_score >= 8)) AS is_toc, text FROM pages_ p JOIN scores s ON p.doc_id = s.doc_id AND p.page_num = s.page_num)"""

# ---------------------------------------------------------------- queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


@query(f"WITH {_TOC} SELECT doc_id, page_num, toc_score, toc_lines, is_toc FROM toc")
def toc_score(spark, d):
    return toc.scored(pages_of(spark, d)).select("doc_id", "page_num", "toc_score", "toc_lines", "is_toc")


@query(f"WITH {_TOC} SELECT doc_id, coalesce(min(CASE WHEN is_toc THEN page_num END), -1)::INT AS toc_page FROM toc WHERE page_num < 5 GROUP BY doc_id")
def toc_first_page(spark, d):
    return toc.first_page(pages_of(spark, d)).na.fill(-1, ["toc_page"])


@query(f"WITH {_TOC}, first AS (SELECT doc_id, min(page_num) AS page_num FROM toc WHERE page_num < 5 AND is_toc GROUP BY doc_id) SELECT doc_id, page_num, length(text) AS n FROM pages_ p WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.doc_id = p.doc_id AND f.page_num = p.page_num)")
def toc_pages_removed(spark, d):
    return toc.without_toc(pages_of(spark, d)).select("doc_id", "page_num", F.length("text").cast("long").alias("n"))


@query(f"WITH {_MD} SELECT doc_id, line_no, line FROM md")
def md_render(spark, d):
    return markdown.render(objects(spark, d))


@query(f"WITH {_MD} SELECT doc_id, {_STRIP('string_agg(line, chr(10) ORDER BY line_no)')} || chr(10) AS markdown FROM md GROUP BY doc_id")
def md_documents(spark, d):
    return markdown.documents(markdown.render(objects(spark, d)))


@query(f"WITH {_OBJECTS} SELECT doc_id, obj_no, 'page | ' || page_idx || chr(10) || '--- | ---' || chr(10) || 'row | ' || obj_no AS pipe FROM objects WHERE type = 'table'")
def html_table_to_md(spark, d):
    return objects(spark, d).where("type = 'table'").select("doc_id", "obj_no", markdown.pipe_table(F.col("table_body")).alias("pipe"))


@query("SELECT page_id, md5(regexp_replace(html, '<.*?>', '', 'g')) AS bare FROM pages")
def strip_tags(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("bare"))


@query(f"WITH {_MD} SELECT doc_id, line_no, line FROM linked WHERE line LIKE '![%'")
def image_link_convert(spark, d):
    return md(spark, d).where(text.is_image_link(F.col("line")))


@query(f"WITH {_MD} SELECT l.doc_id, l.line_no, CASE WHEN line LIKE '![%' AND TRY_CAST(regexp_extract(line, '/p(\\d+)', 1) AS INT) % 2 = 1 THEN substr(line, 5, length(line) - 5) ELSE line END AS line FROM linked l")
def image_exists_semi(spark, d):
    there = objects(spark, d).where("img_path IS NOT NULL AND obj_no % 2 = 0").select(F.col("img_path").alias("path"))
    return markdown.link_images(markdown.render(objects(spark, d)), there)


@query(f"WITH {_MD} SELECT doc_id, line_no, line FROM linked WHERE NOT (line LIKE '![%' AND TRY_CAST(regexp_extract(line, '/p(\\d+)', 1) AS INT) % 5 < 3)")
def image_text_filter(spark, d):
    found = objects(spark, d).where("img_path IS NOT NULL").select(F.col("img_path").alias("path"), (F.col("obj_no") % 5).alias("text_length"))
    return markdown.keep_readable(md(spark, d), found)


@query(f"WITH {_PAGES} SELECT doc_id, page_idx, pos, line FROM paged")
def page_group(spark, d):
    return paged(spark, d)


@query(f"WITH {_PAGES}, pieces AS (SELECT *, lead(line) OVER (PARTITION BY doc_id, page_idx ORDER BY pos) AS after FROM paged) SELECT doc_id, page_idx, '<page_idx:' || page_idx || '>' || chr(10) || '[' || chr(10) || chr(10) || string_agg(line || CASE WHEN after IS NULL THEN '' WHEN line LIKE '![%' AND (after LIKE '<table%' OR after LIKE '|%' OR after LIKE '---%' OR (contains(after, '|') AND after NOT LIKE '#%')) THEN chr(10) ELSE chr(10) || chr(10) END, '' ORDER BY pos) || chr(10) || chr(10) || ']' || chr(10) AS page FROM pieces GROUP BY doc_id, page_idx")
def page_text(spark, d):
    return markdown.page_text(paged(spark, d))


@query(f"WITH {_BLOCKS} SELECT * FROM blocks")
def typed_blocks(spark, d):
    return block_rows(spark, d)


@query(f"WITH {_BLOCKS} SELECT doc_id, page_idx, reading_order, data, table_path FROM blocks WHERE table_path IS NOT NULL")
def image_table_bind(spark, d):
    return block_rows(spark, d).where("table_path IS NOT NULL").select("doc_id", "page_idx", "reading_order", "data", "table_path")


@query(f"WITH {_CLUSTERS} SELECT doc_id, page_idx, CAST(row_number() OVER (PARTITION BY doc_id, page_idx ORDER BY first_order) - 1 AS INT) AS item, first_order, h1, h2, h3, h4, data_type, orders FROM items")
def cluster_order(spark, d):
    rows = items(spark, d)
    return rows.select("doc_id", "page_idx", "item", "first_order", "h1", "h2", "h3", "h4", "data_type", F.array_join(F.transform("members", lambda m: m["reading_order"].cast("string")), ",").alias("orders"))


@query(f"WITH {_CLUSTERS} SELECT doc_id, count(*) FILTER (starts_with(data_type, 'cluster')) AS clusters, sum(n)::BIGINT AS blocks FROM items GROUP BY doc_id")
def cluster_members(spark, d):
    return items(spark, d).groupBy("doc_id").agg(F.count_if("is_cluster").alias("clusters"), F.sum(F.size("members")).alias("blocks"))


@query(f"WITH {_BLOCKS} SELECT doc_id, page_idx, count(*) AS n_blocks, md5(string_agg(reading_order || data_type || data, ';' ORDER BY reading_order)) AS content FROM blocks GROUP BY ALL")
def restore_pages(spark, d):
    rows = blocks.page_records(blocks.restored(items(spark, d)))
    return rows.select("doc_id", "page_idx", "n_blocks", F.md5(F.array_join(F.transform("content", lambda b: F.concat(b["reading_order"].cast("string"), b["data_type"], b["data"])), ";")).alias("content"))


@query(f"WITH {_LINES} SELECT doc_id, line_no, least(6, length(regexp_extract({_STRIP('line')}, '^(#+)', 1)))::INT AS level, contains(line, '|') AND NOT starts_with({_STRIP('line')}, '#') OR starts_with({_STRIP('line')}, '<table') OR starts_with({_STRIP('line')}, '|') OR starts_with({_STRIP('line')}, '---') AS is_table FROM lines")
def line_kinds(spark, d):
    return lines(spark, d).select("doc_id", "line_no", text.heading_level(F.col("line")).alias("level"), text.is_table_line(F.col("line")).alias("is_table"))


def _titles(spark, d):
    """Titles made from every second heading of a document, the third of them cut short."""
    heads = titles.headings(md(spark, d)).where("line_no % 2 = 1")
    rows = heads.withColumn("ord", (F.row_number().over(titles.Window.partitionBy("doc_id").orderBy("line_no")) - 1).cast("int"))
    cut = F.when(F.col("ord") % 3 == 2, F.expr("substring(title, 1, greatest(1, length(title) - 3))")).when(F.col("ord") % 5 == 4, F.reverse("title")).otherwise(F.col("title"))
    return rows.select("doc_id", "ord", cut.alias("title"), (F.col("ord") % 3 + 1).alias("level"))


@query()
def align_ordered(spark, d):
    """Sequential and fuzzy: tested against a row-at-a-time version."""
    rows = md(spark, d)
    return titles.align(_titles(spark, d), titles.headings(rows))


@query()
def structure_lines(spark, d):
    rows, _ = pipeline.structure(md(spark, d), _titles(spark, d))
    return rows


@query("SELECT page_id, '![](img dir/' || page_id || ' ü.jpg)' AS markdown_url, 'file:///data/r%20%C3%BC/img%20dir/' || page_id || '%20%C3%BC.jpg' AS file_url, 'img dir/' || page_id || ' ü.jpg' AS relative_path, 'http://localhost:8000/r%20%C3%BC/img%20dir/' || page_id || '%20%C3%BC.jpg' AS http_url FROM pages")
def url_forms(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat(F.col("page_id").cast("string"), F.lit(" ü.jpg")).alias("name"))
    return rows.select("page_id", files.url_forms(F.lit("/data/r ü/img dir"), F.col("name"), F.lit("/data/r ü")).alias("u")).select("page_id", "u.*")


@query("SELECT page_id, url_encode(url) AS coded, url AS plain FROM pages")
def url_round_trip(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id", text.quote(F.col("url"), "").alias("coded"))
    return rows.select("page_id", "coded", text.unquote(F.col("coded")).alias("plain"))


@query("SELECT page_id, 'file:///x%20y/' || page_id || '.jpg' AS file_url, CASE WHEN page_id % 3 = 0 THEN 'file:///x%20y/' || page_id || '.jpg' END AS fixed FROM pages")
def url_fix(spark, d):
    rows = spark.read.parquet(f"{d}/pages.parquet").select("page_id")
    there = rows.where("page_id % 3 = 0").select(F.concat(F.lit("/x y/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("path"))
    return files.fixed_urls(rows.select("page_id", F.concat(F.lit("file:///x%20y/"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("file_url")), there)


@query(f"WITH {_CLUSTERS} SELECT doc_id, page_idx, first_order, count(*) AS runs FROM (SELECT i.doc_id, i.page_idx, i.first_order, u.ord, u.t <> 'text' AND (u.ord = 1 OR x[u.ord - 1] = 'text') AS starts FROM (SELECT *, string_split(regexp_extract(data_type, '^cluster\\[(.*)\\]$', 1), ',') AS x FROM items WHERE starts_with(data_type, 'cluster')) i, unnest(x) WITH ORDINALITY AS u(t, ord)) WHERE starts GROUP BY ALL")
def image_runs(spark, d):
    """Of clusters. All tables here are bound to images, so each is part of a run."""
    found = annotate.runs(items(spark, d).where("is_cluster")).where("run IS NOT NULL")
    return found.groupBy("doc_id", "page_idx", "first_order").agg(F.count_distinct("run").alias("runs"))


@query()
def image_annotation(spark, d):
    """Through the offline client, which answers from the request alone."""
    return pipeline.annotated(md(spark, d))


@query("WITH c AS (SELECT md5(event_type || user_id) AS key, ts, event_id FROM events), n AS (SELECT max(ts) AS now FROM events), fresh AS (SELECT key, max(ts) AS ts FROM c, n WHERE c.ts > now - INTERVAL 24 HOUR GROUP BY key), asked AS (SELECT DISTINCT key FROM c) SELECT key, key IN (SELECT key FROM fresh) AS hit FROM asked")
def cache_lookup(spark, d):
    log = spark.read.parquet(f"{d}/events.parquet").select(F.md5(F.concat("event_type", F.col("user_id").cast("string"))).alias("key"), "ts", F.col("event_id").cast("string").alias("result"))
    hits, misses = annotate.with_cache(log.select("key").distinct(), log, log.agg(F.max("ts")).scalar())
    return hits.select("key", F.lit(True).alias("hit")).unionByName(misses.select("key", F.lit(False).alias("hit")))


def log(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet")
    return rows.select(F.concat(F.lit("e"), (F.col("user_id") % 4).cast("string")).alias("experiment"), F.col("user_id").alias("doc_id"), F.col("event_type").alias("stage"), (F.col("event_id") % 7 != 0).alias("success"), F.col("value").alias("duration"), (F.col("event_id") % 5).alias("operations"))


@query(f"WITH {_LOG}, x AS (SELECT doc_id, bool_and(success) AS ok FROM log GROUP BY doc_id) SELECT count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok) / count(*) AS rate FROM x")
def batch_report(spark, d):
    return reports.batch_summary(log(spark, d))


@query(f"WITH {_LOG} SELECT experiment, round(sum(duration), 3) AS duration, sum(operations)::BIGINT AS operations, count(*) FILTER (success) AS ok_stages, count(*) FILTER (success) / count(*) AS success_rate FROM log GROUP BY experiment")
def run_report(spark, d):
    return reports.run_summary(log(spark, d)).withColumn("duration", F.round("duration", 3))


@query(f"WITH {_LOG}, x AS (SELECT stage, doc_id, count(*) FILTER (success) AS ok, count(*) AS n, sum(duration) FILTER (success) AS dur FROM log GROUP BY ALL) SELECT stage, count(*) AS documents, round(avg(ok / n), 6) AS mean_rate, round(sum(dur) / sum(ok), 6) AS mean_duration FROM x GROUP BY stage")
def stage_report(spark, d):
    return reports.stage_summary(log(spark, d)).withColumns({"mean_rate": F.round("mean_rate", 6), "mean_duration": F.round("mean_duration", 6)})


@query(f"WITH {_LOG}, r AS (SELECT experiment, count(*) FILTER (success) / count(*) AS success_rate, sum(duration) AS duration FROM log GROUP BY experiment), b AS (SELECT * FROM r WHERE experiment = 'e0') SELECT r.experiment, round(r.success_rate, 9) AS success_rate, round(r.success_rate - b.success_rate, 9) AS rate_delta, round(r.duration - b.duration, 3) AS duration_delta, CAST(row_number() OVER (ORDER BY r.success_rate DESC, r.experiment) AS INT) AS rank FROM r, b")
def ablation_rank(spark, d):
    rows = reports.ablation(log(spark, d), "e0")
    return rows.withColumns({"success_rate": F.round("success_rate", 9), "rate_delta": F.round("rate_delta", 9), "duration_delta": F.round("duration_delta", 3)})


@query(f"WITH {_MD} SELECT doc_id, count(*) FILTER (regexp_matches(line, '^#+')) AS n_headings, sum(length(line))::BIGINT AS n_chars FROM linked GROUP BY doc_id")
def document_sizes(spark, d):
    return reports.document_sizes(md(spark, d))


@query(f"WITH {_MD} SELECT o.doc_id, n_objects, n_lines, n_links FROM (SELECT doc_id, count(*) AS n_objects FROM objects GROUP BY doc_id) o JOIN (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (line LIKE '![%') AS n_links FROM linked GROUP BY doc_id) l ON o.doc_id = l.doc_id")
def conversion_report(spark, d):
    return reports.conversion(objects(spark, d), md(spark, d))


@query(f"WITH {_MD}, k AS (SELECT *, line LIKE '![%' AS img, line LIKE '![%' AND TRY_CAST(regexp_extract(line, '/p(\\d+)', 1) AS INT) % 5 < 3 AS gone FROM linked) SELECT doc_id, count(*) FILTER (img) AS found, count(*) FILTER (img AND NOT gone) AS kept, count(*) FILTER (gone) AS removed, sum(length(line))::BIGINT AS size_before, coalesce(sum(length(line)) FILTER (NOT gone), 0)::BIGINT AS size_after FROM k GROUP BY doc_id")
def image_filter_report(spark, d):
    return reports.image_filter(md(spark, d), image_text_filter(spark, d))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to blocks, clusters and back to page records."""
    return restore_pages(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quire.plans import rules

    return QUERIES | rules.QUERIES


def oracle_sql() -> dict[str, str]:
    from quire.plans import rules

    return ORACLE | rules.ORACLE

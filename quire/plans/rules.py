"""Queries over rules on names, replies, titles and places. Inputs are made from whole tables, and each has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import replies, similarity, text
from quire.models import OfflineClient
from quire.operators import annotate, blocks, files, markdown, reports, titles
from quire.plans import drivers
from quire.plans.catalog import _BLOCKS, _CLUSTERS, _LINES, _LOG, _MD, block_rows, items, lines, log, md

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def text_of(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---------------------------------------------------------------- title trees and outlines

_TREE = """trees AS (SELECT doc_id, '[{"title":"A' || doc_id || '","subtitles":["s","",{"title":"B","subtitles":[{"title":"C","subtitles":[{"title":"D","subtitles":[' || CASE WHEN doc_id % 2 = 0 THEN '{"title":"E"}' ELSE '"E"' END
    || ']}]},"t"]},{"title":"","subtitles":["lost"]}]},{"title":"F","subtitles":[]},"G",{"title":"H","subtitles":[{"title":"I","subtitles":[]},{"title":"J","subtitles":["x"]}]}]' AS tree FROM documents)"""


def trees(spark, d):
    id_ = F.col("doc_id")
    last = F.when(id_ % 2 == 0, '{"title":"E"}').otherwise('"E"')
    tree = text_of('[{"title":"A', id_, '","subtitles":["s","",{"title":"B","subtitles":[{"title":"C","subtitles":[{"title":"D","subtitles":[', last, ']}]},"t"]},{"title":"","subtitles":["lost"]}]},{"title":"F","subtitles":[]},"G",{"title":"H","subtitles":[{"title":"I","subtitles":[]},{"title":"J","subtitles":["x"]}]}]')
    return table(spark, d, "documents").select("doc_id", tree.alias("tree"))


def _walk(level: str, strings: bool) -> str:
    """A tree read by recursion over JSON; level is SQL of the node n, its parent's level `above` and `depth`."""
    object_ = "json_type(n) = 'OBJECT'"
    title = f"CASE WHEN {object_} THEN n->>'$.title' ELSE n->>'$' END"
    keep = "" if strings else f" AND {object_}"
    step = f"SELECT doc_id, n, path, {title} AS title, CAST({level} AS INT) AS level, parent, depth FROM"
    return f"""WITH RECURSIVE {_TREE}, t AS (
    {step} (SELECT doc_id, u.n AS n, [u.i] AS path, NULL::VARCHAR AS parent, 0 AS above, 1 AS depth FROM trees, unnest(CAST(tree AS JSON[])) WITH ORDINALITY AS u(n, i)) WHERE {title} <> ''{keep}
    UNION ALL {step} (SELECT t.doc_id, u.n AS n, list_append(t.path, u.i) AS path, t.title AS parent, t.level AS above, t.depth + 1 AS depth FROM t, unnest(CAST(coalesce(CASE WHEN json_type(t.n) = 'OBJECT' THEN t.n->'$.subtitles' END, '[]') AS JSON[])) WITH ORDINALITY AS u(n, i)) WHERE {title} <> ''{keep}
    ), flat AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS INT) AS ord, title, level, CAST(path[1] - 1 AS INT) AS top_idx, parent FROM t)"""


_RULE = """CASE WHEN depth = 1 THEN 1 WHEN above = 2 THEN 3 WHEN json_type(n) <> 'OBJECT' THEN CASE above WHEN 1 THEN 3 ELSE 4 END
    WHEN coalesce(json_type(n->'$.subtitles[0]') = 'VARCHAR' OR json_type(n->'$.subtitles[0].subtitles') IS NOT NULL, false) OR above = 1 THEN 2 ELSE 4 END"""


@query(_walk(_RULE, True) + " SELECT *, lag(title) OVER (PARTITION BY doc_id ORDER BY ord) AS prev_title, lead(title) OVER (PARTITION BY doc_id ORDER BY ord) AS next_title FROM flat")
def title_flatten(spark, d):
    return titles.neighbours(titles.flatten(trees(spark, d)))


@query(_walk("depth", True) + " SELECT * FROM flat")
def title_flatten_depth(spark, d):
    return titles.flatten(trees(spark, d), "depth")


@query(_walk("depth", False) + " SELECT * FROM flat")
def title_flatten_objects(spark, d):
    return titles.flatten(trees(spark, d), "depth", False)


@query("SELECT doc_id, CAST(i AS INT) AS ord, t AS title, CAST(l AS INT) AS level, CAST(k AS INT) AS top_idx, p AS parent FROM documents, LATERAL (VALUES (0, 'A' || doc_id, 1, 0, NULL), (1, 'B', 2, 0, 'A' || doc_id), (2, 'C', 3, 0, 'B'), (3, 'D', 2, 0, 'A' || doc_id), (4, 'E' || lang, 1, 1, NULL)) AS v(i, t, l, k, p) WHERE doc_id % 3 <> 0")
def outline_parse(spark, d):
    docs = table(spark, d, "documents")
    reply = text_of("thinking\n", F.when(F.col("doc_id") % 3 == 0, "no marker").otherwise(replies.MARKER), "\nA", F.col("doc_id"), "\n    B\n        C\n\n- dropped\n    D\nE", F.col("lang"), "\n        lost\n")
    return replies.outlines(docs.select("doc_id", reply.alias("reply")))


@query("SELECT event_id, a, CASE WHEN event_id % 4 = 3 THEN '[]' ELSE a END AS b FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[' || event_id || ',\"x\"]' WHEN 1 THEN '[{\"title\":\"' || event_type || '\"}]' WHEN 2 THEN '[1,2]' END AS a FROM events)")
def reply_json(spark, d):
    """What a reply has of an array, and of a loose one made strict; compared as compact JSON."""
    id_ = F.col("event_id")
    reply = F.when(id_ % 4 == 0, text_of("so: [", id_, ', "x"] done')).when(id_ % 4 == 1, text_of('```json\n[{"title": "', F.col("event_type"), '"}]\n```')).when(id_ % 4 == 2, "[1, 2]").otherwise("no [ list")
    loose = F.when(id_ % 4 == 0, text_of("[", id_, ", 'x',]")).when(id_ % 4 == 1, text_of("```json\n[{title: '", F.col("event_type"), "',}]\n```")).when(id_ % 4 == 2, "[1, 2,]").otherwise("no [ list")
    compact = lambda c: F.to_json(F.try_parse_json(c))
    return table(spark, d, "events").select("event_id", compact(replies.json_array(reply)).alias("a"), compact(replies.repaired_json(loose)).alias("b"))


@query(
    "SELECT event_id, CAST(CASE WHEN event_id % 5 = 4 OR user_id < 1 OR user_id > 41 THEN -1 ELSE user_id END AS INT) AS line, CASE event_id % 3 WHEN 0 THEN '统计图' WHEN 1 THEN '表格图' ELSE '纯文本图' END AS kind, CASE WHEN event_id % 2 = 0 THEN event_type END AS choice,"
    " CAST(CASE WHEN event_id % 5 = 4 THEN -1 WHEN user_id BETWEEN 5 AND 30 THEN user_id ELSE 5 END AS INT) AS global_line, CASE event_id % 3 WHEN 2 THEN '统计图' || event_type ELSE event_type END AS description, CASE event_id % 3 WHEN 0 THEN '统计图' ELSE '纯文本图' END AS told FROM events"
)
def reply_parse(spark, d):
    id_, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    line = F.when(id_ % 5 == 0, text_of("第", user, "行之前")).when(id_ % 5 == 1, text_of("位置：", user)).when(id_ % 5 == 2, text_of("行", user)).when(id_ % 5 == 3, text_of("插入：第", user, "行")).otherwise("无法判断")
    image = F.when(id_ % 3 == 0, "```统计图\n```").when(id_ % 3 == 1, "是表格图或统计图").otherwise("图")
    picked = F.when(id_ % 2 == 0, text_of("选择： ", kind, " ")).otherwise("选择：other")
    where = F.when(id_ % 5 == 4, "插入位置：无").otherwise(text_of("插入全局行号： ", user))
    told, description = replies.kind_and_text(F.when(id_ % 3 == 0, text_of("统计图 ", kind)).when(id_ % 3 == 1, text_of("x ", kind)).otherwise(text_of("统计图", kind)))
    return table(spark, d, "events").select(
        "event_id", F.coalesce(replies.line_number(line, F.lit(40)), F.lit(-1)).alias("line"), replies.image_kind(image).alias("kind"), replies.choice(picked, F.array(kind)).alias("choice"),
        F.coalesce(replies.global_line(where, F.lit(5), F.lit(30)), F.lit(-1)).alias("global_line"), description.alias("description"), told.alias("told"),
    )


# ---------------------------------------------------------------- similarity and alignment

_PAIR = "p AS (SELECT event_id, 1 + event_id % 9 AS a, event_id % 8 AS b, event_id % 3 AS k FROM events)"


def pairs(spark, d):
    """Ideographs repeated, so that the longest common subsequence is known: the title is the heading's start, or has nothing of it, or is without ideographs."""
    a, b, k = 1 + F.col("event_id") % 9, F.col("event_id") % 8, F.col("event_id") % 3
    many = lambda c, n: F.repeat(F.lit(c), n.cast("int"))
    heading = F.concat(F.lit("1.2 "), many("甲", a), many("乙", b))
    title = F.when(k == 0, many("甲", a)).when(k == 1, many("丙", a)).otherwise(F.concat(F.lit("x"), many("y", b)))
    return table(spark, d, "events").select("event_id", heading.alias("heading"), title.alias("title"))


@query(f"WITH {_PAIR} SELECT event_id, round(CASE WHEN k = 0 AND b = 0 THEN 1.0 WHEN k = 0 AND 2.0 * a / (2 * a + b) >= 0.8 THEN 2.0 * a / (2 * a + b) WHEN k = 0 THEN 0.9 ELSE 0.0 END::DOUBLE, 6) AS score, round(CASE k WHEN 0 THEN 2.0 * a / (2 * a + b + 4) ELSE 0 END::DOUBLE, 6) AS ratio FROM {'p'}")
def title_similarity(spark, d):
    h, t = F.col("heading"), F.col("title")
    return pairs(spark, d).select("event_id", F.round(similarity.title_score(h, t), 6).alias("score"), F.round(similarity.ratio(h, t), 6).alias("ratio"))


_CJK = lambda c: rf"regexp_replace({c}, '[^\x{{4e00}}-\x{{9fff}}]', '', 'g')"


@query(f"WITH {_LINES} SELECT doc_id, line_no, {_CJK('line')} AS ideographs, length({_CJK('line')})::BIGINT AS n FROM (SELECT doc_id, line_no, '1.' || line_no || ' 公司' || left(line, 5) || '治理' AS line FROM lines)")
def title_ideographs(spark, d):
    rows = lines(spark, d).select("doc_id", "line_no", text.cjk(text_of("1.", F.col("line_no"), " 公司", F.substring("line", 1, 5), "治理")).alias("ideographs"))
    return rows.withColumn("n", F.length("ideographs").cast("long"))


#: Headings of a document: those of its linked lines. Titles: every second one, the fourth of them unknown, the others in order.
_HEADS = f"{_MD}, hs AS (SELECT doc_id, line_no, regexp_replace(line, '^#+\\s*', '') AS title FROM linked WHERE regexp_matches(line, '^#+\\s*[^#\\s]')), ts AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INT) AS ord, title FROM hs WHERE line_no % 2 = 1), tt AS (SELECT doc_id, ord, CASE WHEN ord % 4 = 3 THEN '丁' || ord ELSE title END AS title FROM ts)"


def heads_and_titles(spark, d):
    heads = titles.headings(md(spark, d))
    rows = heads.where("line_no % 2 = 1")
    ord_ = (F.row_number().over(titles.Window.partitionBy("doc_id").orderBy("line_no")) - 1).cast("int")
    rows = rows.select("doc_id", ord_.alias("ord"), "title", (F.pmod(F.col("line_no"), F.lit(3)) + 1).alias("level"))
    return heads, rows.withColumn("title", F.when(F.col("ord") % 4 == 3, text_of("丁", F.col("ord"))).otherwise(F.col("title")))


#: A line has no ideographs in these tables, so two titles are the same if their whole texts are.
@query(f"""WITH RECURSIVE {_HEADS}, walk AS (
    SELECT doc_id, -1 AS ord, -1 AS at, NULL::INT AS line_no FROM (SELECT DISTINCT doc_id FROM tt)
    UNION ALL SELECT w.doc_id, w.ord + 1, coalesce(m.line_no, w.at), m.line_no FROM walk w JOIN tt ON tt.doc_id = w.doc_id AND tt.ord = w.ord + 1
        LEFT JOIN LATERAL (SELECT min(hs.line_no) AS line_no FROM hs WHERE hs.doc_id = w.doc_id AND hs.line_no > w.at AND hs.title = tt.title) m ON true)
    SELECT doc_id, ord, coalesce(line_no, -1) AS line_no FROM walk WHERE ord >= 0""")
def align_equal(spark, d):
    heads, rows = heads_and_titles(spark, d)
    return titles.align(rows, heads, fuzzy=False).select("doc_id", "ord", F.coalesce("line_no", F.lit(-1)).alias("line_no"))


@query(f"WITH {_HEADS} SELECT tt.doc_id, ord, coalesce(min(hs.line_no), -1) AS line_no FROM tt LEFT JOIN hs ON hs.doc_id = tt.doc_id AND hs.title = tt.title GROUP BY tt.doc_id, ord")
def best_match(spark, d):
    """The first of the best: equal headings have a score of 1, which none exceeds. The threshold leaves nothing else."""
    heads, rows = heads_and_titles(spark, d)
    found = titles.best_matches(rows, heads, 1.0)
    return found.select("doc_id", "ord", F.coalesce(F.when(F.col("score") == 1, F.col("line_no")), F.lit(-1)).alias("line_no"))


_RUNS = "c AS (SELECT DISTINCT user_id AS doc_id, 1 + event_id % 12 AS n FROM events), h AS (SELECT doc_id, n AS line_no, repeat('甲', n::INT) AS title FROM c), t AS (SELECT DISTINCT doc_id, CAST(n % 5 AS INT) AS ord FROM c)"


@query(f"WITH {_RUNS}, r AS (SELECT t.doc_id, ord, h.line_no, 2.0 * least(ord + 1, h.line_no) / (ord + 1 + h.line_no) AS ratio FROM t JOIN h ON t.doc_id = h.doc_id), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, ord ORDER BY ratio DESC, line_no) AS INT) AS rank FROM r) SELECT doc_id, ord, rank, line_no, round(ratio::DOUBLE, 9) AS ratio FROM k WHERE rank <= 3")
def title_candidates(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (1 + F.col("event_id") % 12).alias("n")).distinct()
    heads = rows.select("doc_id", F.col("n").alias("line_no"), F.repeat(F.lit("甲"), F.col("n").cast("int")).alias("title"))
    asked = rows.select("doc_id", (F.col("n") % 5).cast("int").alias("ord")).distinct().withColumn("title", F.repeat(F.lit("甲"), F.col("ord") + 1))
    return titles.candidates(asked, heads).withColumn("ratio", F.round("ratio", 9))


@query(f"WITH {_MD} SELECT doc_id, line_no, CASE WHEN NOT regexp_matches(line, '^#+\\s*[^#\\s]') THEN line WHEN line_no % 4 = 0 THEN '## ' || regexp_replace(line, '^#+\\s*', '') ELSE '#### ' || regexp_replace(line, '^#+\\s*', '') END AS line FROM linked")
def relevel(spark, d):
    rows = md(spark, d)
    told = titles.headings(rows).where("line_no % 4 = 0").select("doc_id", F.col("line_no").alias("ord"), "line_no")
    return titles.relevelled(rows, told.select("doc_id", "ord", F.lit("x").alias("title"), F.lit(2).alias("level")), told)


@query(f"WITH {_LINES}, new AS (SELECT doc_id, line_no - 0.5 AS k, 1 AS o, '### T' || line_no AS line FROM lines WHERE line_no % 10 = 3), b AS (SELECT doc_id, line_no::DOUBLE AS k, 0 AS o, line FROM lines UNION ALL SELECT * FROM new) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, o) - 1 AS INT) AS line_no, line FROM b")
def title_insert(spark, d):
    rows = lines(spark, d)
    places = rows.where("line_no % 10 = 3").select("doc_id", F.lit(1).alias("ord"), text_of("T", F.col("line_no")).alias("title"), F.lit(3).alias("level"), F.col("line_no").alias("at"))
    return titles.inserted(rows, places)


@query(f"WITH {_MD}, f AS (SELECT *, last_value(TRY_CAST(nullif(regexp_extract(line, '^<page_idx:(\\d+)>', 1), '') AS INT) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS page_idx FROM linked) SELECT doc_id, page_idx, min(line_no) AS first_line, max(line_no) AS last_line FROM f WHERE page_idx IS NOT NULL GROUP BY doc_id, page_idx")
def page_offsets(spark, d):
    return titles.page_bounds(md(spark, d))


#: Pages of ten lines; asked ranges that overlap some, or lie behind all.
_ASK = "pg AS (SELECT DISTINCT user_id AS doc_id, event_id % 9 AS page_idx, 10 * (event_id % 9) AS first_line, 10 * (event_id % 9) + 9 AS last_line FROM events), ask AS (SELECT DISTINCT user_id AS doc_id, event_id % 7 AS ord, 15 * (event_id % 7) - 20 AS prev_line, 15 * (event_id % 7) - 12 AS next_line FROM events)"


@query(f"WITH {_ASK}, p AS (SELECT a.doc_id, a.ord, page_idx, last_line >= prev_line AND first_line <= next_line AS hit, first_line > prev_line AS later FROM ask a JOIN pg ON a.doc_id = pg.doc_id), q AS (SELECT *, bool_or(hit) OVER (PARTITION BY doc_id, ord) AS met, sum(later::INT) OVER (PARTITION BY doc_id, ord ORDER BY page_idx) AS n FROM p) SELECT doc_id, ord, page_idx FROM q WHERE hit OR (NOT met AND later AND n <= 5)")
def title_windows(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 9).alias("page_idx"), (F.col("event_id") % 7).alias("ord"))
    pages = rows.select("doc_id", "page_idx").distinct().withColumns({"first_line": F.col("page_idx") * 10, "last_line": F.col("page_idx") * 10 + 9})
    asked = rows.select("doc_id", "ord").distinct().withColumns({"prev_line": F.col("ord") * 15 - 20, "next_line": F.col("ord") * 15 - 12})
    return titles.page_windows(asked, pages)


@query(f"WITH {_HEADS}, missing AS (SELECT *, lag(title) OVER w AS p, lead(title) OVER w AS n FROM tt WINDOW w AS (PARTITION BY doc_id ORDER BY ord)), f AS (SELECT doc_id, title, min(line_no) AS line FROM hs GROUP BY ALL), l AS (SELECT doc_id, max(line_no) AS last FROM hs GROUP BY doc_id) SELECT m.doc_id, ord, coalesce(a.line, 0) AS prev_line, coalesce(b.line, last, 0) AS next_line FROM missing m LEFT JOIN f a ON a.doc_id = m.doc_id AND a.title = m.p LEFT JOIN f b ON b.doc_id = m.doc_id AND b.title = m.n LEFT JOIN l ON l.doc_id = m.doc_id WHERE ord % 4 = 3")
def title_anchors(spark, d):
    heads, rows = heads_and_titles(spark, d)
    unmatched = rows.where("ord % 4 = 3").select("doc_id", "ord", F.lit(None).cast("int").alias("line_no"))
    return titles.anchors(rows, unmatched, heads).select("doc_id", "ord", "prev_line", "next_line")


# ---------------------------------------------------------------- names and folders

_NAME = """names AS (SELECT page_id, '/r/' || CASE WHEN page_id % 7 = 0 THEN 'notes' || page_id ELSE lpad(page_id::VARCHAR, 6, '0') || '.SZ-公司' || page_id % 97 || '-' || (2000 + page_id % 25) || CASE WHEN page_id % 2 = 0 THEN '年度' ELSE '年' END || '报告' END
    || CASE page_id % 4 WHEN 0 THEN '_grouped' WHEN 1 THEN '_vlm' WHEN 2 THEN '_final' ELSE '' END || '.json' AS path FROM pages)"""


def names(spark, d):
    id_ = F.col("page_id")
    body = F.when(id_ % 7 == 0, text_of("notes", id_)).otherwise(text_of(F.lpad(id_.cast("string"), 6, "0"), ".SZ-公司", id_ % 97, "-", 2000 + id_ % 25, F.when(id_ % 2 == 0, "年度").otherwise("年"), "报告"))
    suffix = F.element_at(F.array(*map(F.lit, ["_grouped", "_vlm", "_final", ""])), (id_ % 4 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", text_of("/r/", body, suffix, ".json").alias("path"))


@query("SELECT page_id, CASE WHEN ok THEN lpad(page_id::VARCHAR, 6, '0') || '.SZ' ELSE 'UNKNOWN' END AS stock_code, CASE WHEN ok THEN '公司' || page_id % 97 ELSE '未知公司' END AS company_name, CASE WHEN ok THEN CAST(2000 + page_id % 25 AS INT) ELSE 0 END AS report_year, CASE WHEN ok THEN (2000 + page_id % 25) || CASE WHEN page_id % 2 = 0 THEN '年度' ELSE '年' END || '报告' || CASE WHEN page_id % 4 = 2 THEN '_final' ELSE '' END ELSE '未知报告' END AS report_title FROM (SELECT page_id, page_id % 7 <> 0 AS ok FROM pages)")
def metadata_short(spark, d):
    return names(spark, d).select("page_id", files.report_metadata(F.col("path")).alias("m")).select("page_id", "m.stock_code", "m.company_name", "m.report_year", "m.report_title").na.fill(0, ["report_year"])


@query("SELECT page_id, CASE WHEN ok THEN CAST(2000 + page_id % 25 AS INT) ELSE 0 END AS report_year, CASE WHEN ok THEN (2000 + page_id % 25) || '年度报告' ELSE '未知报告' END AS report_name, CASE WHEN ok THEN '报告' ELSE '未知类型' END AS report_type, page_id AS file_size_bytes FROM (SELECT page_id, page_id % 7 <> 0 AND page_id % 2 = 0 AS ok FROM pages)")
def metadata_long(spark, d):
    meta = files.file_metadata(F.col("path"), F.col("page_id"), F.lit("2024-01-02 03:04:05").cast("timestamp"))
    return names(spark, d).select("page_id", meta.alias("m")).select("page_id", "m.report_year", "m.report_name", "m.report_type", "m.file_size_bytes").na.fill(0, ["report_year"])


@query(f"WITH {_NAME} SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'existing' WHEN 1 THEN 'pages' WHEN 2 THEN 'blocks' ELSE 'raw' END AS form, CASE WHEN page_id % 4 = 0 THEN 'me' END AS author, CASE page_id % 4 WHEN 0 THEN '[1]' WHEN 1 THEN '[2]' WHEN 2 THEN '[{{\"data_type\":\"text\"}}]' ELSE '{{\"x\":' || page_id || '}}' END AS content FROM names")
def metadata_envelope(spark, d):
    id_ = F.col("page_id")
    body = F.when(id_ % 4 == 0, '{"metadata":{"author":"me","report_type":"old"},"pages":[1]}').when(id_ % 4 == 1, '{"pages":[2]}').when(id_ % 4 == 2, '[{"data_type":"text"}]').otherwise(text_of('{"x":', id_, "}"))
    rows = files.envelope(names(spark, d).select(text_of(F.col("path"), "#", id_).alias("path"), body.alias("json")))
    return rows.select(F.substring_index("path", "#", -1).cast("long").alias("page_id"), "form", F.col("metadata")["author"].alias("author"), "content")


@query("WITH n AS (SELECT DISTINCT CASE page_id % 5 WHEN 0 THEN '报告 ' || page_id || '(终)' WHEN 1 THEN 'plain-' || page_id || '.1' WHEN 2 THEN 'a b' || page_id // 10 WHEN 3 THEN 'ab' || page_id // 10 ELSE 'x*' || page_id % 50 END AS src FROM pages), c AS (SELECT src, regexp_replace(src, '[ ()*]', '', 'g') AS dst FROM n), w AS (SELECT dst, count(*) AS n, bool_or(src = dst) AS taken FROM c GROUP BY dst) SELECT src, c.dst, CASE WHEN src = c.dst THEN 'keep' WHEN n > 1 OR taken THEN 'collision' ELSE 'rename' END AS action FROM c JOIN w ON c.dst = w.dst")
def folder_clean_plan(spark, d):
    id_ = F.col("page_id")
    tens = F.floor(id_ / 10)
    name = F.when(id_ % 5 == 0, text_of("报告 ", id_, "(终)")).when(id_ % 5 == 1, text_of("plain-", id_, ".1")).when(id_ % 5 == 2, text_of("a b", tens)).when(id_ % 5 == 3, text_of("ab", tens)).otherwise(text_of("x*", id_ % 50))
    return files.rename_plan(table(spark, d, "pages").select(name.alias("name")))


_INDUSTRIES = [(s, i) for s, x in files.SECTORS.items() for i in x]


@query(f"WITH s AS (SELECT * FROM (VALUES {', '.join(f'({k}, {chr(39)}{s}{chr(39)}, {chr(39)}{i}{chr(39)})' for k, (s, i) in enumerate(_INDUSTRIES))}) AS v(k, sector, industry)) SELECT event_id, industry, sector FROM events JOIN s ON event_id % {len(_INDUSTRIES) + 3} = k")
def sector_lookup(spark, d):
    known = F.array(*[F.lit(i) for _, i in _INDUSTRIES], *[F.lit("none")] * 3)
    asked = table(spark, d, "events").select("event_id", F.element_at(known, (F.col("event_id") % (len(_INDUSTRIES) + 3) + 1).cast("int")).alias("industry"))
    return asked.join(F.broadcast(files.sectors(spark)), "industry").select("event_id", "industry", "sector")


_FILES = "fs AS (SELECT 'f' || page_id // 8 || CASE WHEN page_id // 8 % 3 = 0 THEN '_skip' ELSE '' END AS folder, CASE page_id % 8 WHEN 0 THEN 'a' || page_id || '_preprocessed.md' WHEN 1 THEN 'page_1.jpg' WHEN 2 THEN CASE WHEN page_id // 8 % 2 = 0 THEN 'page_2.jpg' ELSE 'z.JPG' END WHEN 3 THEN 'r' || page_id || '.json' WHEN 4 THEN 'preprocess_config.json' WHEN 5 THEN '.hidden.json' WHEN 6 THEN 'my_log.json' ELSE '~x.json' END AS name FROM pages)"


def listed(spark, d):
    id_, part = F.col("page_id"), F.floor(F.col("page_id") / 8)
    folder = text_of("f", part, F.when(part % 3 == 0, "_skip").otherwise(""))
    kind = F.array(text_of("a", id_, "_preprocessed.md"), F.lit("page_1.jpg"), F.when(part % 2 == 0, "page_2.jpg").otherwise("z.JPG"), text_of("r", id_, ".json"), *map(F.lit, ["preprocess_config.json", ".hidden.json", "my_log.json", "~x.json"]))
    return table(spark, d, "pages").select(folder.alias("folder"), F.element_at(kind, (id_ % 8 + 1).cast("int")).alias("name"))


@query(f"WITH {_FILES} SELECT folder, name FROM fs WHERE regexp_matches(name, '^r\\d+\\.json$')")
def report_listing(spark, d):
    return files.report_files(listed(spark, d)).select("folder", "name")


@query(f"WITH {_FILES} SELECT folder, count(*) AS n_files, string_agg(name, ',' ORDER BY name) AS names FROM fs WHERE NOT ends_with(folder, '_skip') GROUP BY folder")
def folder_listing(spark, d):
    return files.by_folder(listed(spark, d), ["_skip"]).select("folder", "n_files", F.array_join("names", ",").alias("names"))


@query(f"WITH {_FILES}, g AS (SELECT folder, min(name) FILTER (ends_with(name, '_preprocessed.md')) AS markdown, CASE WHEN bool_or(name = 'page_2.jpg') THEN 'page_2.jpg' WHEN bool_or(name = 'page_1.jpg') THEN 'page_1.jpg' ELSE min(name) FILTER (lower(name) LIKE '%.jpg') END AS toc_image FROM fs GROUP BY folder) SELECT * FROM g WHERE markdown IS NOT NULL AND toc_image IS NOT NULL")
def work_items(spark, d):
    return files.work_items(listed(spark, d))


@query("SELECT CASE WHEN page_id % 2 = 0 THEN '20240101_' ELSE '' END || 'r' || page_id AS report, 'r' || page_id || '_without_toc' AS images FROM pages WHERE page_id % 3 <> 0")
def report_pairs(spark, d):
    rows = table(spark, d, "pages").select("page_id", text_of("r", F.col("page_id")).alias("name"))
    images = rows.where("page_id % 3 <> 0").select(text_of(F.col("name"), "_without_toc").alias("images"))
    return files.paired(rows.select(text_of(F.when(F.col("page_id") % 2 == 0, "20240101_").otherwise(""), F.col("name")).alias("report")), images)


@query("SELECT page_id, string_split(url, '/')[-1] AS name, regexp_replace(string_split(url, '/')[-1], '(.)\\.[^.]*$', '\\1') AS stem, lower(regexp_extract(string_split(url, '/')[-1], '.(\\.[^.]*)$', 1)) AS extension, regexp_replace(url, '/?[^/]*$', '') AS folder, round((page_id * 100000 / 1048576)::DOUBLE, 2) AS mb, replace(url, '/', chr(92)) AS back FROM pages")
def path_parts(spark, d):
    url = F.col("url")
    back = F.replace(url, F.lit("/"), F.lit("\\"))
    return table(spark, d, "pages").select("page_id", text.basename(text.slashes(back)).alias("name"), text.stem(url).alias("stem"), text.extension(url).alias("extension"), text.dirname(url).alias("folder"), text.megabytes(F.col("page_id") * 100000).alias("mb"), back.alias("back"))


# ---------------------------------------------------------------- lines, blocks, reports


@query(f"WITH {_LINES}, s AS (SELECT doc_id, line_no, 'T ' || line_no || '  ' AS t, line_no % 9 - 1 AS k FROM lines) SELECT doc_id, line_no, repeat('#', greatest(1, least(6, k))::INT) || ' ' || trim(t) AS heading, CASE WHEN line_no % 2 = 0 THEN line_no ELSE -1 END AS page, CASE WHEN line_no % 3 = 0 THEN 'x/p' || line_no || '.PNG' END AS path, line_no % 4 < 3 AS is_table FROM s")
def line_rules(spark, d):
    """Rendered headings, markers of both forms, paths of links, and the wider table rule."""
    n = F.col("line_no")
    marker = F.when(n % 4 == 0, text_of("<page_idx:", n, ">")).when(n % 4 == 2, text_of("<page_idx：[", n, ">")).otherwise(text_of("<page:", n, ">"))
    link = F.when(n % 3 == 0, text_of("see ![](x/p", n, ".PNG) there")).otherwise(text_of("![](x/p", n, ".pdf)"))
    row = F.when(n % 4 == 0, " <table><tr>").when(n % 4 == 1, "# a | b").when(n % 4 == 2, "---").otherwise("plain")
    return lines(spark, d).select("doc_id", "line_no", text.heading(text_of("T ", n, "  "), n % 9 - 1).alias("heading"), F.coalesce(text.page_index(marker, True), F.lit(-1)).alias("page"), text.image_path(link).alias("path"), text.is_table_pattern(row).alias("is_table"))


@query(f"WITH {_CLUSTERS} SELECT doc_id, page_idx, first_order, starts_with(data_type, 'cluster') AND (contains(data_type, 'image')) OR data_type = 'image' OR (data_type = 'table' AND EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = i.doc_id AND b.page_idx = i.page_idx AND b.reading_order = i.first_order AND b.table_path IS NOT NULL)) AS asked FROM items i")
def needs_model(spark, d):
    rows = items(spark, d)
    return rows.select("doc_id", "page_idx", "first_order", annotate.needs_model(rows).alias("asked"))


@query(f"WITH {_BLOCKS}, x AS (SELECT DISTINCT doc_id, page_idx, reading_order FROM blocks) SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id")
def seen_blocks(spark, d):
    """Blocks that come twice are taken once."""
    # every second one twice, from one reading of the lines
    rows = block_rows(spark, d).withColumn("__copy", F.explode(F.sequence(F.lit(0), F.when(F.col("reading_order") % 2 == 0, 1).otherwise(0)))).drop("__copy")
    return blocks.unseen(rows).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT event_id AS doc_id, event_type AS stage FROM events WHERE event_id % 7 <> 0")
def succeeded_inputs(spark, d):
    rows = table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("event_type").alias("stage"))
    return reports.succeeded(rows, rows.where("doc_id % 7 = 0").select("doc_id"))


@query(f"WITH {_LOG} SELECT experiment, stage, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, round(count(*) FILTER (success) / count(*), 9) AS success_rate FROM log GROUP BY ALL")
def stage_statistics(spark, d):
    return reports.statistics(log(spark, d)).withColumn("success_rate", F.round("success_rate", 9))


@query("SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n, left(coalesce(text, ''), 50) || CASE WHEN length(coalesce(text, '')) > 50 THEN '...' ELSE '' END AS preview, to_base64(encode(left(coalesce(text, ''), 20))) AS coded, '/out/' || doc_id || '/x_preprocessed' AS folder FROM documents")
def text_previews(spark, d):
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.length(t).cast("long").alias("n"), text.preview(t).alias("preview"), F.base64(F.encode(F.substring(t, 1, 20), "UTF-8")).alias("coded"), files.output_folder(text_of("/in/", F.col("doc_id"), "/x.json"), "/in", "/out").alias("folder"))


@query(f"WITH {_MD} SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM linked) WHERE n <= 5")
def first_lines(spark, d):
    return markdown.preview(md(spark, d))


# ---------------------------------------------------------------- through a model client: the offline one answers from the request alone


@query("SELECT doc_id, CAST(i AS INT) AS ord, t AS title, CAST(l AS INT) AS level, CAST(k AS INT) AS top_idx, p AS parent FROM documents, LATERAL (VALUES (0, 'A' || doc_id, 1, 0, NULL), (1, 'B', CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END, 0, 'A' || doc_id), (2, 'C', 1, 1, NULL)) AS v(i, t, l, k, p)")
def outline_extraction(spark, d):
    """A reply with a JSON array is read as a tree, any other as an outline."""
    tree = text_of('[{"title":"A', F.col("doc_id"), '","subtitles":["B"]},"C"]')
    image = F.when(F.col("doc_id") % 2 == 0, tree).otherwise(text_of("A", F.col("doc_id"), "\n    B\nC"))
    return drivers.titles_of(drivers.outline_replies(table(spark, d, "documents").select("doc_id", F.encode(image, "UTF-8").alias("image"))))


@query(f"WITH {_RUNS}, r AS (SELECT t.doc_id, ord, h.line_no, 2.0 * least(ord + 1, h.line_no) / (ord + 1 + h.line_no) AS ratio FROM t JOIN h ON t.doc_id = h.doc_id) SELECT doc_id, ord, line_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ord ORDER BY ratio DESC, line_no) AS rank FROM r) WHERE rank = 1")
def title_choice(spark, d):
    """The offline client picks the first, which is the nearest."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), (1 + F.col("event_id") % 12).alias("n")).distinct()
    heads = rows.select("doc_id", F.col("n").alias("line_no"), F.repeat(F.lit("甲"), F.col("n").cast("int")).alias("title"))
    asked = rows.select("doc_id", (F.col("n") % 5).cast("int").alias("ord")).distinct().withColumn("title", F.repeat(F.lit("甲"), F.col("ord") + 1))
    return drivers.chosen(asked, heads)


@query(f"WITH {_LINES}, ask AS (SELECT doc_id, 0 AS ord, line_no + 2 AS prev_line FROM lines WHERE line_no % 8 = 1) SELECT doc_id, prev_line - 2 AS ord, prev_line AS at FROM ask")
def title_places(spark, d):
    """The offline client names the first line it sees; a window behind the last line keeps its own."""
    rows = lines(spark, d)
    missing = rows.where("line_no % 8 = 1").select("doc_id", F.col("line_no").alias("ord"), F.lit("t").alias("title"), F.lit(2).alias("level"), (F.col("line_no") + 2).alias("prev_line"), (F.col("line_no") + 9).alias("next_line"))
    return drivers.placed(rows, missing).select("doc_id", "ord", "at")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{\"relevant\":true}' WHEN 1 THEN '{\"relevant\":false}' ELSE '{\"raw_analysis\":\"no context\"}' END AS analysis FROM events")
def title_relevance(spark, d):
    id_, kind = F.col("event_id"), F.col("event_type")
    context = F.when(id_ % 3 == 0, text_of("of ", kind, " and more")).when(id_ % 3 == 1, "other").otherwise("")
    return drivers.relevance(table(spark, d, "events").select("event_id", kind.alias("title"), context.alias("context"))).select("event_id", "analysis")


@query(f"WITH {_LINES} SELECT doc_id, line_no AS page_num, CASE line_no % 3 WHEN 0 THEN 'layer ' || line_no WHEN 1 THEN 'read ' || line_no ELSE '' END AS text FROM lines")
def page_reading(spark, d):
    """Pages with a text layer keep it, others are read from their image, and one without either is empty."""
    n = F.col("line_no")
    pages = lines(spark, d).select("doc_id", n.alias("page_num"), F.when(n % 3 == 0, text_of("layer ", n)).otherwise(" ").alias("text"), F.when(n % 3 == 1, F.encode(text_of("read ", n), "UTF-8")).alias("image"))
    return drivers.page_texts(pages, OfflineClient()).select("doc_id", "page_num", "text")


@query(f"""WITH RECURSIVE {_HEADS}, walk AS (
    SELECT doc_id, -1 AS ord, -1 AS at, NULL::INT AS line_no FROM (SELECT DISTINCT doc_id FROM tt)
    UNION ALL SELECT w.doc_id, w.ord + 1, coalesce(m.line_no, w.at), m.line_no FROM walk w JOIN tt ON tt.doc_id = w.doc_id AND tt.ord = w.ord + 1
        LEFT JOIN LATERAL (SELECT min(hs.line_no) AS line_no FROM hs WHERE hs.doc_id = w.doc_id AND hs.line_no > w.at AND hs.title = tt.title) m ON true),
    c AS (SELECT count(*) AS titles, count(line_no) AS matched FROM walk WHERE ord >= 0)
    SELECT experiment, titles, matched, round(matched / titles, 9) AS rate, 0.0::DOUBLE AS rate_delta, rank FROM c, (VALUES ('baseline', 1), ('minimal_processing', 2), ('no_fuzzy_match', 3), ('strict_matching', 4)) AS v(experiment, rank)""")
def structure_variations(spark, d):
    """Variations that match equal titles only, against a baseline that does as well."""
    heads, rows = heads_and_titles(spark, d)
    found = drivers.structure_ablation(md(spark, d), rows, ["no_fuzzy_match", "strict_matching", "minimal_processing"], drivers.pipeline.Structure(fuzzy_match=False))
    return found.withColumns({"rate": F.round("rate", 9), "rate_delta": F.round("rate_delta", 9)})


@query(f"WITH {_LOG}, x AS (SELECT stage, doc_id, count(*) FILTER (success) / count(*) AS rate FROM log GROUP BY ALL), s AS (SELECT stage, count(*) AS n, avg(rate) AS rate FROM x GROUP BY stage) SELECT 'Stages' || chr(10) || string_agg(stage || ': ' || n || ' documents, ' || printf('%.1f', rate * 100) || ' % went well', chr(10) ORDER BY stage) AS report FROM s")
def stage_text(spark, d):
    return reports.as_text(reports.stage_summary(log(spark, d)))

"""Parsers of what models reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text

#: The marker before an outline, image kinds in the order they are tried, and the default.
MARKER = "### 最终输出结果"
KINDS = ["表格图", "流程图", "统计图", "关系图", "纯文本图", "混合图", "组合图"]
PLAIN = "纯文本图"


def line_number(reply: Column, lines: Column) -> Column:
    """The line a reply names, if it lies within 1 and lines + 1."""
    patterns = [r"第(\d+)行之前", r"第(\d+)行", r"行(\d+)", r"位置[：:](\d+)", r"插入[：:]第(\d+)行"]
    tried = [F.regexp_extract(reply, p, 1).try_cast("int") for p in patterns]
    number = F.coalesce(*[F.when(n.between(1, lines + 1), n) for n in tried])
    return number


def global_line(reply: Column, low: Column, high: Column) -> Column:
    """The strict form: null for none or no position; outside its bounds it becomes the lower."""
    number = F.regexp_extract(reply, r"插入全局行号[:：]\s*(\d+)", 1).try_cast("int")
    return F.when(reply.contains("插入位置：无"), F.lit(None)).otherwise(F.when(number.between(low, high), number).when(number.isNotNull(), low))


def choice(reply: Column, candidates: Column) -> Column:
    """The chosen candidate, null for what isn't one."""
    picked = text.strip(F.regexp_extract(reply, r"选择[:：]\s*(.+)", 1))
    return F.when(F.array_contains(candidates, picked), picked)


def image_kind(c: Column) -> Column:
    cleaned = text.strip(F.regexp_replace(c, "```|\n", ""))
    return F.coalesce(*[F.when(cleaned.contains(k), F.lit(k)) for k in KINDS], F.lit(PLAIN))


def kind_and_text(reply: Column) -> tuple[Column, Column]:
    """(kind, description) of "<kind> <text>"; without a blank the whole is the description and the kind is the default."""
    split = reply.contains(" ")
    return F.when(split, image_kind(F.substring_index(reply, " ", 1))).otherwise(F.lit(PLAIN)), F.when(split, F.regexp_extract(reply, r"(?s)^[^ ]* (.*)$", 1)).otherwise(reply)


def json_array(reply: Column) -> Column:
    """From the first [ to the last ], if that parses; else null."""
    found = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    return F.when(F.try_parse_json(found).isNotNull(), found)


def repaired_json(reply: Column) -> Column:
    """Loose JSON made strict: fences, single quotes, bare keys and trailing commas; [] if it still doesn't parse."""
    out = text.strip(F.regexp_replace(reply, r"```(?:json)?", ""))
    for pattern, by in ((r"'", '"'), (r"([\{,]\s*)([A-Za-z_]\w*)\s*:", r'$1"$2":'), (r",\s*([\]\}])", "$1")):
        out = F.regexp_replace(out, pattern, by)
    return F.when(F.try_parse_json(out).isNotNull(), out).otherwise(F.lit("[]"))


def outlines(replies: DataFrame) -> DataFrame:
    """Titles of replies(doc_id, reply): doc_id, ord, title, level, top_idx, parent. Indents of 0, 4 and 8 make levels 1, 2 and 3.

    Only what follows the marker counts; a reply without it gives no rows. Unindented lines that start with a bullet are dropped,
    and so is a title whose upper level is missing.
    """
    body = F.expr(f"substring(reply, locate('{MARKER}', reply) + {len(MARKER)})")
    lines = replies.where(F.col("reply").contains(MARKER)).select("doc_id", F.posexplode(F.split(text.strip(body), r"\r\n|[\n\r\x0b\x0c\x85  ]")).alias("pos", "line"))
    level = F.when(F.col("line").startswith(" " * 8), 3).when(F.col("line").startswith(" " * 4), 2).when(~F.col("line").rlike("^[-·•]"), 1)
    lines = lines.where(text.strip(F.col("line")) != "").select("doc_id", "pos", text.strip(F.col("line")).alias("title"), level.alias("level")).where("level IS NOT NULL")
    order = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    of = lambda k: F.last(F.when(F.col("level") == k, F.struct("pos", "title")), True).over(order)
    rows = lines.withColumns({"one": of(1), "two": of(2), "top": F.count_if(F.col("level") == 1).over(order) - 1})
    two = F.when(F.col("two.pos") > F.col("one.pos"), F.col("two"))
    rows = rows.withColumn("parent", F.when(F.col("level") == 2, F.col("one.title")).when(F.col("level") == 3, two["title"]))
    rows = rows.where("level = 1 OR parent IS NOT NULL")
    return rows.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1).alias("ord"), "title", "level", F.col("top").cast("int").alias("top_idx"), "parent")

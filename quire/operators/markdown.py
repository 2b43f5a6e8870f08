"""Layout objects to Markdown lines, links, pages. Lines carry (doc_id, line_no)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text


def pipe_table(html: Column) -> Column:
    """An HTML table with bare tags as a pipe table, a rule after the first of several rows; empty without rows."""
    cell = lambda c: text.strip(F.replace(text.strip_tags(c), F.lit("\n"), F.lit("")))
    cells = lambda r: F.array_join(F.transform(F.regexp_extract_all(r, F.lit("(?s)<t[dh]>(.*?)</t[dh]>"), F.lit(1)), cell), " | ")
    rows = F.transform(F.regexp_extract_all(html, F.lit("(?s)<tr>(.*?)</tr>"), F.lit(1)), cells)
    rule = F.array_join(F.array_repeat(F.lit("---"), F.size(F.split(F.get(rows, F.lit(0)), r" \| "))), " | ")
    return F.array_join(F.when(F.size(rows) > 1, F.array_insert(rows, 2, rule)).otherwise(rows), "\n")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """line_no from 0 in each document, by the order columns."""
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1)


def render(objects: DataFrame, markers: bool = True, keep_html: bool = True) -> DataFrame:
    """Lines of layout objects, in the order of obj_no: doc_id, line_no, line. Types other than text, image and table give none.

    Each object is a page marker (if asked for), its line and two blanks; a table's body has a marker of its own.
    """
    body = text.strip(F.replace(F.coalesce("table_body", F.lit("")), F.lit("\n"), F.lit("")))
    words = text.strip(F.coalesce("text", F.lit("")))
    head = F.when(F.col("text_level") > 0, F.concat(F.repeat(F.lit("#"), F.col("text_level")), F.lit(" "), words)).otherwise(words)
    content = F.when(F.col("type") == "text", head).when(F.col("type") == "table", body if keep_html else pipe_table(body))
    rows = objects.where(F.col("type").isin("text", "image", "table")).select("doc_id", "obj_no", "type", "page_idx", F.when(F.col("type") != "text", F.col("img_path")).alias("path"), content.alias("content"))
    # objects are sorted, not their lines: an object's first line is the count of those of all objects before it. What is done
    # before and behind the sort stays small enough for the JVM to compile (8000 bytes a method).
    table = (F.col("type") == "table") & (F.col("content") != "")
    own = F.when(F.col("type") == "text", 3).otherwise(2 + F.col("path").isNotNull().cast("int") + F.when(table, 1 + markers * keep_html).otherwise(0)) + int(markers)
    before = F.sum("own").over(Window.partitionBy("doc_id").orderBy("obj_no").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("own", own).select("doc_id", F.coalesce(before, F.lit(0)).cast("int").alias("start"), "type", "page_idx", "path", "content")
    first = [F.concat(F.lit("<page_idx:"), F.coalesce(F.col("page_idx").cast("string"), F.lit("")), F.lit(">"))] if markers else []
    blanks = [F.lit(""), F.lit("")]
    # the marker before a table's body is only kept with the HTML form
    second = [*(first if keep_html else []), F.col("content")]
    with_path = lambda *rest: F.when(F.col("path").isNull(), F.array(*first, *rest, *blanks)).otherwise(F.array(*first, F.col("path"), *rest, *blanks))
    lines = F.when(F.col("type") == "text", F.array(*first, F.col("content"), *blanks)).when(table, with_path(*second)).otherwise(with_path())
    return rows.select("doc_id", "start", F.posexplode(lines).alias("pos", "line")).select("doc_id", (F.col("start") + F.col("pos")).alias("line_no"), "line")


def link_images(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Bare image paths become links, all lines are stripped. With files(path), only paths that exist do; the listing is joined by path."""
    line = text.strip(F.col("line"))
    if files is None:
        return lines.withColumn("line", F.when(F.col("line").contains("_temp_images/") & text.is_image_path(line), F.concat(F.lit("![]("), line, F.lit(")"))).otherwise(line))
    there = files.select(F.col("path").alias("__key"), F.lit(True).alias("there")).distinct()
    rows = lines.withColumn("line", line)
    found = rows.withColumn("__key", spread(F.when(text.is_image_path(F.col("line")), F.col("line")))).join(there, "__key", "left")
    return found.withColumn("line", F.when(text.is_image_path(F.col("line")) & F.coalesce("there", F.lit(False)), F.concat(F.lit("![]("), F.col("line"), F.lit(")"))).otherwise(F.col("line"))).select(lines.columns)


def spread(path: Column) -> Column:
    """A key to join by path: lines without one get one of their own, which no path equals, so that they don't meet in one task."""
    return F.coalesce(path, F.concat(F.lit("\n"), F.xxhash64("doc_id", "line").cast("string")))


def keep_readable(lines: DataFrame, found: DataFrame, least: int = 3) -> DataFrame:
    """Drops link lines whose image has less text than `least`, by found(path, text_length); unknown images stay."""
    known = found.groupBy("path").agg(F.max("text_length").alias("text_length"))
    rows = lines.withColumn("path", text.image_path(F.col("line")))
    rows = rows.withColumn("__key", spread(F.col("path"))).join(known.withColumnRenamed("path", "__key"), "__key", "left")
    return rows.where(F.col("path").isNull() | F.coalesce(F.col("text_length") >= least, F.lit(True))).select(lines.columns)


def pages(lines: DataFrame) -> DataFrame:
    """Content lines by page: doc_id, page_idx, pos, line. Repeated markers merge; blanks and what precedes the first marker are dropped."""
    order = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    # blanks mark nothing, so they go before the sort
    rows = lines.where(text.strip_start(F.col("line")) != "").withColumn("mark", text.page_index(F.col("line")))
    rows = rows.withColumn("page_idx", F.last("mark", True).over(order)).where(F.col("mark").isNull() & F.col("page_idx").isNotNull())
    pos = F.row_number().over(Window.partitionBy("doc_id", "page_idx").orderBy("line_no")) - 1
    return rows.select("doc_id", "page_idx", pos.alias("pos"), text.strip_end(F.col("line")).alias("line"))


def page_text(paged: DataFrame) -> DataFrame:
    """The bracketed text of each page: doc_id, page_idx, page. No blank line stands between an image and its table."""
    order = Window.partitionBy("doc_id", "page_idx").orderBy("pos")
    after = F.lead("line").over(order)
    glue = F.when(after.isNull(), "").when(text.strip_start(F.col("line")).startswith("![") & text.is_table_line(after), "\n").otherwise("\n\n")
    rows = paged.select("doc_id", "page_idx", "pos", F.concat("line", glue).alias("piece"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    return rows.groupBy("doc_id", "page_idx").agg(F.concat(F.lit("<page_idx:"), F.col("page_idx").cast("string"), F.lit(">\n[\n\n"), body, F.lit("\n\n]\n")).alias("page"))


def documents(lines: DataFrame) -> DataFrame:
    """The whole Markdown of each document: lines joined, stripped, one newline at the end."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("doc_id").agg(F.concat(text.strip(body), F.lit("\n")).alias("markdown"))


def preview(lines: DataFrame, most: int = 5) -> DataFrame:
    """The first `most` lines of each document."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return lines.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")

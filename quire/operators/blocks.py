"""Typed blocks with inherited headings, section clusters, and the way back to pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text

HEADS = ["h1", "h2", "h3", "h4"]
STRICT, TOLERANT = r"(?s)^<html>.*?<table>.*?</table>.*?</html>", r"(?s)^(?:<div[^>]*>)?\s*(?:<html[^>]*>)?.*?<table[^>]*>.*?</table>"


def blocks(paged: DataFrame, tolerant: bool = False) -> DataFrame:
    """Blocks of lines(doc_id, page_idx, pos, line): doc_id, page_idx, reading_order, h1..h4, data_type, data, table_path.

    Headings carry over to later pages, and one clears those below it. An image right before a table becomes the table's path.
    reading_order counts a page's blocks from 0. All windows share the partitioning by doc_id. Missing headings are null.
    """
    line = text.strip(F.col("line"))
    head = F.when(line.startswith("#"), F.nullif(F.length(F.regexp_extract(line, r"^(#{1,4}) ", 1)).cast("string"), F.lit("0")))
    table = line.rlike(TOLERANT) if tolerant else line.startswith("<html>") & line.rlike(STRICT)
    kind = F.coalesce(head, F.when(text.is_image_link(F.col("line")), "image"), F.when(table, "table"), F.lit("text"))
    rows = paged.select("doc_id", "page_idx", "pos", line.alias("data"), kind.alias("kind"))
    order = Window.partitionBy("doc_id").orderBy("page_idx", "pos")
    at = F.struct("page_idx", "pos")
    seen = {f"s{k}": F.last(F.when(F.col("kind") == str(k), F.struct(at.alias("at"), F.expr(f"substring(data, {k + 2})").alias("title"))), True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for k in (1, 2, 3, 4)}
    beside = lambda f: F.when(f("page_idx").over(order) == F.col("page_idx"), f("kind").over(order))
    rows = rows.withColumns({**seen, "after": beside(F.lead), "before": beside(F.lag), "above": F.lag("data").over(order)})
    for k in (1, 2, 3, 4):
        upper = [~(F.col(f"s{j}.at") > F.col(f"s{k}.at")) | F.col(f"s{j}").isNull() for j in range(1, k)]
        valid = F.lit(True)
        for u in upper:
            valid &= u
        rows = rows.withColumn(f"h{k}", F.when(valid, F.col(f"s{k}.title")))
    rows = rows.where(~F.col("kind").isin("1", "2", "3", "4") & ~F.coalesce((F.col("kind") == "image") & (F.col("after") == "table"), F.lit(False)))
    path = F.when((F.col("kind") == "table") & (F.col("before") == "image"), F.col("above"))
    number = F.row_number().over(Window.partitionBy("doc_id", "page_idx").orderBy("pos")) - 1
    return rows.select("doc_id", "page_idx", number.alias("reading_order"), *HEADS, F.col("kind").alias("data_type"), "data", path.alias("table_path"))


def _is_image(c: Column) -> Column:
    return c.startswith("![")


def sections(rows: DataFrame) -> DataFrame:
    """Blocks gathered by page and headings, members in reading order: first_order, members, is_cluster (images and others together)."""
    member = F.struct("reading_order", "data_type", "data", "table_path")
    image = _is_image(F.col("data"))
    found = rows.groupBy("doc_id", "page_idx", *HEADS).agg(F.array_sort(F.collect_list(member)).alias("members"), F.min("reading_order").alias("first_order"), F.count_if(image).alias("n_images"), F.count_if(~image).alias("n_others"))
    return found.withColumn("is_cluster", (F.col("n_images") > 0) & (F.col("n_others") > 0))


def clusters(rows: DataFrame) -> DataFrame:
    """Clusters and single blocks of each page, in order of their first member: item, first_order, data_type, members.

    The type of a cluster is rendered as cluster[t1,t2,...]; inside, members stay a typed array.
    """
    # a section makes one item or one a member, in one pass over it
    found = sections(rows)
    apart = F.transform("members", lambda m: F.struct(m["reading_order"].alias("first_order"), F.array(m).alias("members")))
    made = F.when(F.col("is_cluster"), F.array(F.struct("first_order", "members"))).otherwise(apart)
    both = found.select("doc_id", "page_idx", *HEADS, "is_cluster", F.inline(made))
    tag = F.concat(F.lit("cluster["), F.array_join(F.transform("members", lambda m: m["data_type"]), ","), F.lit("]"))
    item = F.row_number().over(Window.partitionBy("doc_id", "page_idx").orderBy("first_order")) - 1
    return both.select("doc_id", "page_idx", item.alias("item"), "first_order", *HEADS, F.when(F.col("is_cluster"), tag).otherwise(F.col("members")[0]["data_type"]).alias("data_type"), "is_cluster", "members")


def cluster_types(tag: Column) -> Column:
    """The types of a rendered cluster tag; commas within brackets don't split."""
    return F.regexp_extract_all(F.regexp_extract(tag, r"(?s)^cluster\[(.*)\]$", 1), F.lit(r"(?:[^,\[\]]|\[(?:[^\[\]]|\[[^\]]*\])*\])+"), F.lit(0))


def restored(items: DataFrame) -> DataFrame:
    """Blocks again: members without data are dropped, images and tables of a cluster are numbered from 1."""
    rows = items.select("doc_id", "page_idx", "item", *HEADS, "is_cluster", F.posexplode("members").alias("pos", "m")).where("m.data IS NOT NULL")
    rows = rows.select("doc_id", "page_idx", "item", "pos", *HEADS, "is_cluster", "m.*")
    image = F.when(_is_image(F.col("data")), "image").otherwise(F.col("data_type"))
    ordinal = F.row_number().over(Window.partitionBy("doc_id", "page_idx", "item", image).orderBy("pos"))
    return rows.withColumn("ordinal", F.when(F.col("is_cluster") & image.isin("image", "table"), ordinal)).drop("pos", "is_cluster")


def page_records(rows: DataFrame) -> DataFrame:
    """A row for each page: n_blocks and content, an array of blocks in reading order."""
    block = F.struct("reading_order", *HEADS, "data_type", "data", "table_path")
    return rows.groupBy("doc_id", "page_idx").agg(F.count("*").alias("n_blocks"), F.array_sort(F.collect_list(block)).alias("content"))


def report(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """The final report of each document: metadata and its pages in order; documents without metadata keep a null."""
    pages = records.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_idx", "content"))).alias("pages"))
    fields = F.struct(*[c for c in metadata.columns if c != "doc_id"]).alias("metadata")
    return pages.join(metadata.select("doc_id", fields), "doc_id", "left").select("doc_id", "metadata", "pages")


def to_json_form(rows: DataFrame) -> DataFrame:
    """Missing headings as the text "null", as the files have it."""
    return rows.withColumns({h: F.coalesce(h, F.lit("null")) for h in HEADS})


def unseen(rows: DataFrame) -> DataFrame:
    """rows with each (doc_id, page_idx, reading_order) once."""
    return rows.dropDuplicates(["doc_id", "page_idx", "reading_order"])

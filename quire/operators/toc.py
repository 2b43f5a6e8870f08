"""Table-of-contents pages: keywords, density of signs, the first such page, and what is left without them."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text

#: Fixed values.
KEYWORDS = ["目录", "目錄", "目次", "索引", "章节目录", "章節目錄", "table of contents", "contents", "index", "toc", "chapter", "section", "part", "appendix", "references", "bibliography", "glossary"]
CHAPTERS = ["chapter", "section", "part", "appendix", "references", "章", "節", "部", "篇", "编", "編", "附录", "附錄", "参考文献"]
REPORTS = ["季度", "年度", "报告", "報告", "quarter", "annual", "report", "业绩", "業績", "表现", "表現", "良好", "下滑", "恢复"]
SIGNS = [(2, r"^\d+\.?\s+[A-Za-z一-鿿]"), (2, r"\.{3,}\s*\d+\s*$"), (1, r"\.{3,}|…{3,}"), (1, r"\d[\.-]\d"), (2, r"^\d+\s+[A-Za-z一-鿿].*\s+\d+$")]


def any_of(words: list[str], bounded: bool = False) -> str:
    joined = "|".join(map(re.escape, words)).replace(r"\ ", " ")
    return rf"\b(?:{joined})\b" if bounded else joined


def has_keyword(page: Column, bounded: bool = False) -> Column:
    """A keyword anywhere, even within a word; `bounded` takes whole words only."""
    return F.lower(page).rlike(any_of(KEYWORDS, True)) if bounded else holds(F.lower(page), KEYWORDS)


def holds(c: Column, words: list[str]) -> Column:
    """Any of the words anywhere. Words are sought one by one: a pattern would try all of them at each character."""
    least = [w for w in words if not any(x != w and x in w for x in words)]
    return reduce(or_, [c.contains(w) for w in least])


def line_score(line: Column, lowered: Column | None = None) -> Column:
    """The weights of SIGNS that a stripped line has, and 1 for a chapter's word. Signs with dots are only sought where dots are."""
    start, end, dots, numbers, both = SIGNS
    many = line.contains("...")
    of = lambda sign, found: sign[0] * found.cast("int")
    total = holds(F.lower(line) if lowered is None else lowered, CHAPTERS).cast("int")
    return total + of(start, line.rlike(start[1])) + of(end, many & line.rlike(end[1])) + of(dots, many | line.contains("………")) + of(numbers, line.rlike(numbers[1])) + of(both, line.rlike(both[1]))


def scored(pages: DataFrame, column: str = "text") -> DataFrame:
    """pages with toc_score, toc_lines (not blank) and is_toc. Row by row, no shuffle."""
    page = F.coalesce(column, F.lit(""))
    lines = F.filter(F.transform(F.split(page, "\n"), text.strip), lambda x: x != "")
    rows = pages.withColumn("__lines", lines)
    total = F.aggregate(F.zip_with("__lines", F.transform("__lines", F.lower), line_score), F.lit(0), lambda a, b: a + b)
    rows = rows.withColumns({"toc_score": total, "toc_lines": F.size("__lines")}).drop("__lines")
    dense = ((F.col("toc_score") > 0.5 * F.col("toc_lines")) & (F.col("toc_score") >= 5)) | (F.col("toc_score") >= 8)
    return rows.withColumn("is_toc", has_keyword(page) | ((F.col("toc_lines") > 0) & dense & ~holds(F.lower(page), REPORTS)))


def first_page(pages: DataFrame, most: int = 5) -> DataFrame:
    """The first contents page among the first `most`, by text layer or OCR: doc_id, toc_page (null if none)."""
    early = scored(pages.where(F.col("page_num") < most))
    if "ocr_text" in pages.columns:
        by_ocr = scored(early.drop("toc_score", "toc_lines").withColumnRenamed("is_toc", "by_text"), "ocr_text")
        early = by_ocr.withColumn("is_toc", F.col("by_text") | F.col("is_toc"))
    return early.groupBy("doc_id").agg(F.min(F.when(F.col("is_toc"), F.col("page_num"))).alias("toc_page"))


def without_toc(pages: DataFrame, most: int = 5) -> DataFrame:
    found = first_page(pages, most).where("toc_page IS NOT NULL").withColumnRenamed("toc_page", "page_num")
    return pages.join(found, ["doc_id", "page_num"], "left_anti").select(pages.columns)

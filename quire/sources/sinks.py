"""Writers. Each writes a new folder and overwrites nothing; rows that failed go to a folder of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import markdown


def write_markdown(lines: DataFrame, folder: str) -> None:
    """A text row for each document, in folders by document."""
    markdown.documents(lines).select("doc_id", F.regexp_replace("markdown", "\n$", "").alias("value")).write.partitionBy("doc_id").text(folder)


def write_pages(paged: DataFrame, folder: str) -> None:
    pages = markdown.page_text(paged)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_idx", "page"))), lambda x: x["page"]), "\n")
    pages.groupBy("doc_id").agg(F.regexp_replace(whole, "\n$", "").alias("value")).write.partitionBy("doc_id").text(folder)


def write_report(reports: DataFrame, folder: str, pretty: bool = True) -> None:
    """A JSON text for each document."""
    options = {"pretty": "true"} if pretty else {}
    reports.select("doc_id", F.to_json(F.struct("metadata", "pages"), options).alias("value")).write.partitionBy("doc_id").text(folder)


def write_records(rows: DataFrame, folder: str) -> None:
    """Page records as Parquet, clustered by document."""
    rows.repartition("doc_id").sortWithinPartitions("doc_id", "page_idx").write.parquet(folder)


def write_summary(rows: DataFrame, folder: str) -> None:
    rows.coalesce(1).write.json(folder)


def append_cache(misses: DataFrame, folder: str) -> None:
    misses.select("key", "ts", "result").write.mode("append").parquet(folder)


def split_failed(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows with an error to folder/failed and returns the others."""
    rows.where("error IS NOT NULL").write.parquet(f"{folder}/failed")
    return rows.where("error IS NULL")



"""Scans: listings, layout JSON, Markdown pages, title trees, page images. All are lazy and cut by Spark's own file splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.functions import text
from quire.operators import files


def listing(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """path, folder, name, size and modified of files; contents aren't read."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)
    path = text.unquote(F.col("path"))
    return rows.select(path.alias("path"), text.basename(text.dirname(path)).alias("folder"), text.basename(path).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def pdfs(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of PDF files, whatever the case of their extension."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{pdf,PDF,Pdf}").option("recursiveFileLookup", True).load(folder).select("path", "content")


def images(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder).where(text.extension(F.col("name")).isin(".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp")).orderBy("path")


def _doc_id():
    return text.stem(F.col("_metadata.file_path"))


def layouts(spark: SparkSession, *paths: str, pattern: str = "*.json") -> DataFrame:
    """Layout objects of JSON files, one list a file: doc_id is the file's stem, obj_no the place in the list. Broken files give no rows."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text([*dict.fromkeys(paths)])
    rows = rows.select(_doc_id().alias("doc_id"), F.posexplode(F.from_json("value", schemas.LAYOUT_FILE, {"mode": "PERMISSIVE"})).alias("obj_no", "o"))
    return rows.select("doc_id", "obj_no", "o.*")


def checked(spark: SparkSession, *paths: str, pattern: str = "*.json", fail_fast: bool = False) -> tuple[DataFrame, DataFrame]:
    """(layout objects, files that can't be read as one: doc_id, path, error). With `fail_fast` the first such file is an error of the job."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text([*dict.fromkeys(paths)])
    node = F.try_parse_json("value")
    error = F.when(node.isNull(), "isn't JSON").when(~F.schema_of_variant(node).startswith("ARRAY"), "isn't a list")
    rows = rows.select(_doc_id().alias("doc_id"), text.unquote(F.col("_metadata.file_path")).alias("path"), "value", error.alias("error"))
    if fail_fast:
        rows = rows.withColumn("value", F.when(F.col("error").isNull(), F.col("value")).otherwise(F.raise_error(F.concat("path", F.lit(": "), "error")).cast("string")))
    good = rows.where("error IS NULL") if not fail_fast else rows
    objects = good.select("doc_id", F.posexplode(F.from_json("value", schemas.LAYOUT_FILE, {"mode": "PERMISSIVE"})).alias("obj_no", "o")).select("doc_id", "obj_no", "o.*")
    return objects, rows.where("error IS NOT NULL").select("doc_id", "path", "error")


def samples(spark: SparkSession, folder: str, most: int = 5) -> list[bytes]:
    """The first `most` images of a folder by path, for a model's examples: they go with every request, so they are few."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").load(folder)
    return [bytes(r.content) for r in rows.orderBy("path").limit(most).select("content").collect()]


def metadata(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """Envelopes of the JSON files right in a folder, with what their names and the file system tell."""
    rows = records(spark, folder, pattern)
    return files.envelope(rows)


def trees_by_folder(listed: DataFrame, parts: int = 3) -> DataFrame:
    """Of listed files, those in folders whose name has at least `parts` parts between underscores."""
    return listed.where(F.size(F.split("folder", "_")) >= parts)


def markdown(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """Lines of Markdown files, numbered from 0."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder)
    return rows.select(_doc_id().alias("doc_id"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def trees(spark: SparkSession, folder: str, pattern: str = "*titles*.json") -> DataFrame:
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder)
    return rows.select(text.basename(text.dirname(F.col("_metadata.file_path"))).alias("doc_id"), F.col("value").alias("tree"))


def bracketed(lines: DataFrame) -> DataFrame:
    """Lines of grouped Markdown without its brackets: a line of just [ after a marker and ] before the next one or the end."""
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("line_no")
    full = lines.where(F.col("line") != "")
    rows = full.withColumns({"before": F.lag("line").over(order), "after": F.lead("line").over(order)})
    opens = (F.col("line") == "[") & F.col("before").startswith("<page_idx")
    closes = (F.col("line") == "]") & (F.col("after").isNull() | F.col("after").startswith("<page_idx"))
    return rows.where(~(F.coalesce(opens, F.lit(False)) | closes)).select("doc_id", "line_no", "line")


def records(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """path, json, size and modified of whole files."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(folder)
    return rows.select(text.unquote(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("json"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("modified"))

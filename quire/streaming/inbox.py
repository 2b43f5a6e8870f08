"""Reports as they come in: a file stream of layout JSON through the batch stages. All state is bounded by a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire import schemas
from quire.functions import text
from quire.plans import pipeline


def incoming(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Layout objects of new files: doc_id, obj_no and the object's fields."""
    rows = spark.readStream.format("text").schema("value string").option("wholetext", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_a_batch).load(folder)
    rows = rows.select(text.stem(F.col("_metadata.file_path")).alias("doc_id"), F.posexplode(F.from_json("value", schemas.LAYOUT_FILE)).alias("obj_no", "o"))
    return rows.select("doc_id", "obj_no", "o.*")


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Page records of each batch, written under out/batch=<n>; a batch run again overwrites its own folder, so none counts twice."""

    def batch(rows: DataFrame, number: int) -> None:
        pipeline.page_records(pipeline.preprocess(rows)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = incoming(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()

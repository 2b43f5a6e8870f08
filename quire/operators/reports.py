"""Summaries of run logs and of what stages did. One partial aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text


def _rate(ok, total):
    return F.when(total > 0, ok / total).otherwise(0.0)


def batch_summary(log: DataFrame) -> DataFrame:
    """total, ok, failed and rate over the log; a document is ok if none of its rows failed."""
    docs = log.groupBy("doc_id").agg(F.min(F.col("success").cast("int")).alias("ok"))
    rows = docs.agg(F.count("*").alias("total"), F.coalesce(F.sum("ok"), F.lit(0)).alias("ok"))
    return rows.select("total", "ok", (F.col("total") - F.col("ok")).alias("failed"), _rate(F.col("ok"), F.col("total")).alias("rate"))


def run_summary(log: DataFrame) -> DataFrame:
    """Of each experiment: duration, operations, stages that went well, success rate."""
    ok = F.count_if("success")
    return log.groupBy("experiment").agg(F.sum("duration").alias("duration"), F.sum("operations").alias("operations"), ok.alias("ok_stages"), _rate(ok, F.count("*")).alias("success_rate"))


def stage_summary(log: DataFrame) -> DataFrame:
    """Of each stage: the mean over documents of their success rates, and mean duration of the rows that went well."""
    docs = log.groupBy("stage", "doc_id").agg(F.count_if("success").alias("ok"), F.count("*").alias("n"), F.sum(F.when(F.col("success"), F.col("duration"))).alias("duration"))
    return docs.groupBy("stage").agg(F.count("*").alias("documents"), F.avg(F.col("ok") / F.col("n")).alias("mean_rate"), (F.sum("duration") / F.sum("ok")).alias("mean_duration"))


def statistics(log: DataFrame) -> DataFrame:
    ok, bad = F.count_if("success"), F.count_if(~F.col("success"))
    return log.groupBy("experiment", "stage").agg(ok.alias("ok"), bad.alias("failed"), (ok / F.greatest(F.lit(1), ok + bad)).alias("success_rate"))


def ablation(log: DataFrame, baseline: str) -> DataFrame:
    """Each experiment's success rate and duration against the baseline's, ranked by rate, then by name. The baseline is one row."""
    runs = run_summary(log)
    base = runs.where(F.col("experiment") == baseline).select(F.col("success_rate").alias("base_rate"), F.col("duration").alias("base_duration"))
    rows = runs.join(F.broadcast(base))
    rank = F.row_number().over(Window.orderBy(F.desc("success_rate"), "experiment"))
    return rows.select("experiment", "success_rate", (F.col("success_rate") - F.col("base_rate")).alias("rate_delta"), (F.col("duration") - F.col("base_duration")).alias("duration_delta"), rank.alias("rank"))


def succeeded(inputs: DataFrame, failed: DataFrame) -> DataFrame:
    return inputs.join(failed.select("doc_id").distinct(), "doc_id", "left_anti")


def document_sizes(lines: DataFrame) -> DataFrame:
    """Headings and characters of each document."""
    return lines.groupBy("doc_id").agg(F.count_if(F.col("line").rlike("^#+")).alias("n_headings"), F.sum(F.length("line")).alias("n_chars"))


def conversion(objects: DataFrame, lines: DataFrame) -> DataFrame:
    """Of each document: objects, lines, and lines that are image links."""
    a = objects.groupBy("doc_id").agg(F.count("*").alias("n_objects"))
    b = lines.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(text.is_image_link(F.col("line"))).alias("n_links"))
    return a.join(b, "doc_id", "left").na.fill(0, ["n_lines", "n_links"])


def image_filter(before: DataFrame, after: DataFrame) -> DataFrame:
    """Images found, kept and removed, and characters before and after, of each document."""
    count = lambda df, a, b: df.groupBy("doc_id").agg(F.count_if(text.is_image_link(F.col("line"))).alias(a), F.sum(F.length("line")).alias(b))
    rows = count(before, "found", "size_before").join(count(after, "kept", "size_after"), "doc_id", "left").na.fill(0, ["kept", "size_after"])
    return rows.select("doc_id", "found", "kept", (F.col("found") - F.col("kept")).alias("removed"), "size_before", "size_after")


def url_counts(fixed: DataFrame) -> DataFrame:
    return fixed.agg(F.count("*").alias("seen"), F.count("fixed").alias("fixed"))


def as_text(stages: DataFrame) -> DataFrame:
    """stage_summary() as one text: report."""
    line = F.concat("stage", F.lit(": "), F.col("documents").cast("string"), F.lit(" documents, "), F.format_number(F.col("mean_rate") * 100, 1), F.lit(" % went well"))
    return stages.agg(F.concat(F.lit("Stages\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("report"))  # a line for each stage

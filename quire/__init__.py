"""Document-structure analytics on PySpark."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from wherever the driver runs; a path that is set already stays."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


def preprocess(spark: SparkSession, *folders: str, **settings):
    """Layout JSON below the folders as Markdown lines; settings are those of plans.pipeline.Preprocess."""
    from quire.plans import pipeline
    from quire.sources import files

    return pipeline.preprocess(files.layouts(spark, *folders), pipeline.loaded(pipeline.Preprocess, settings))


def structure(lines, replies, client=None, **settings):
    """(lines with levels, alignment) by replies(doc_id, reply); settings are those of plans.pipeline.Structure."""
    from quire.plans import drivers, pipeline

    return drivers.structure(lines, replies, pipeline.loaded(pipeline.Structure, settings), client)

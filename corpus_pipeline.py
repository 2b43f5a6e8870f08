"""A corpus, from raw documents to packed sequences: each stage calls one operator of quire.llm.

A stage takes (spark, docs, sf_dir); docs has the columns of documents, and so has what all stages but the last return. Between
stages rows are written as Parquet and read again, so a lost executor costs one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import common, exact, mixing, packing, simhash, tokens, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go; all others stay, those without words too."""
    common.scratch(spark)
    return toxicity.clean(docs, toxicity.labels(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the one of the smallest doc_id stays; null and empty texts are equal, and rows without a doc_id stay.

    Extra columns are carried whatever their names, and an empty table stays one; so do all stages but the last.
    """
    common.scratch(spark)
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a similarity of 0.8 or more over five-word shingles, the one of the smallest doc_id stays.

    Texts without words (null, empty) are one group; those of fewer than five words are one shingle; rows without a doc_id stay.
    """
    common.scratch(spark)
    return simhash.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice. A null source is a source; texts without words count nothing; rows equal in doc_id, source and text tie."""
    common.scratch(spark)
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its sequence of 2048 tokens and its place there. Null and empty texts are an end id; repeated rows are packed each; other columns are not carried."""
    common.scratch(spark)
    return packing.pack(docs, tokens.vocabulary_path(), words=200_000)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: No SQL for nearest examples, fingerprints, tilted rates or packing; a brute-force version stands in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.sweep(spark, docs)  # what the stages so far wrote is read no more
        common.release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)

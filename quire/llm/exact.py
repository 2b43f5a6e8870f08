"""Operator 5, exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), common.SPACE, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def duplicates(docs: DataFrame, prefix: int = 64, digests: bool = False) -> DataFrame:
    """Groups of docs(doc_id, text) whose texts are equal after white space runs become one space.

    Rows are grouped by length; those whose length is shared, by a hash of their first `prefix` characters; only rows of groups
    that still hold several have their whole text hashed (SHA-256). Steps shuffle numbers and hashes, never texts, and groups are
    counted by partial aggregation. Large groups of copies are looked up where their rows lie (common.looked_up), so none is
    gathered anywhere. Where there are more shared prefixes than may be sent to all tasks, or for `digests`, every text is hashed as
    it is read: to carry the prefixes' verdict to the texts would take a shuffle of all texts, which costs more than the hash.

    Returns doc_id, keep_id (smallest doc_id of the group), group_size, kept, and text_sha256 (binary), which is null for texts that
    no other can equal unless `digests`. A null text equals an empty one. A null doc_id never stays if its group has another; a group
    of nulls has keep_id null and all stay. Repeated rows count each, and all of the smallest doc_id are kept. An empty table
    gives no rows. Other columns are not read.
    """
    text = docs.select("doc_id", normalised(F.col("text")).alias("t"))
    start = text.select("doc_id", "t", F.length("t").alias("n"), F.xxhash64(F.substring("t", 1, prefix)).alias("p"))
    if digests:  # one reading gives all three
        start = common.save(start.select("doc_id", "n", "p", digest(F.col("t")).alias("text_sha256")), "exact-keys")
        keys = start.select("n", "p")
    else:
        keys = common.save(start.select("n", "p"), "exact-keys")
    lengths = keys.groupBy("n").count().where("count > 1")
    shared = keys.groupBy("n", "p").agg(F.count("*").alias("again")).where("again > 1").join(lengths.select("n"), "n", "left_semi")
    shared = common.save(shared.select("n", "p", "again"), "exact-again")
    if not digests and shared.count() <= common.BROADCAST_ROWS:
        rows = start.join(F.broadcast(shared), ["n", "p"], "left").select("doc_id", "n", F.when(F.col("again").isNotNull(), digest(F.col("t"))).alias("text_sha256"), "again")
    else:
        rows = start if digests else start.select("doc_id", "n", "p", digest(F.col("t")).alias("text_sha256"))
        rows = common.looked_up(rows, shared, ["n", "p"], "again").select("doc_id", "n", "text_sha256" if digests else F.when(F.col("again").isNotNull(), F.col("text_sha256")).alias("text_sha256"), "again")
    rows = common.save(rows.select("doc_id", "n", "text_sha256", F.when(F.col("again").isNotNull(), F.col("text_sha256")).alias("full")), "exact-full")
    groups = rows.where("full IS NOT NULL").groupBy("n", "full").agg(F.min("doc_id").alias("least"), F.count("*").alias("size")).where("size > 1")
    out = common.looked_up(rows, common.save(groups, "exact-groups"), ["n", "full"], "size")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns. Repeated rows (same doc_id and text) become one as well.

    Rows are dropped by doc_id and text, so another text under a dropped doc_id stays. Rows with a null doc_id stay.
    """
    found = common.save(duplicates(docs), "exact")
    ours = [F.col("doc_id").alias("id"), F.col("text_sha256").alias("digest")]
    dropped = common.bounded(common.save(found.where("NOT kept AND doc_id IS NOT NULL").select(*ours).distinct(), "exact-dropped"))
    again = common.save(found.where("doc_id IS NOT NULL AND kept AND group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1").select(ours[0]).distinct(), "exact-again")
    # not an equality for the planner: only texts whose doc_id is met are hashed
    same = (docs["doc_id"] == dropped["id"]) & F.contains(digest(normalised(docs["text"])), dropped["digest"])
    left = docs.join(dropped, same, "left_anti")
    if again.isEmpty():
        return left
    again = common.bounded(again)
    rest, some = (left.join(again, left["doc_id"] == again["id"], how) for how in ("left_anti", "left_semi"))
    some = some.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", digest(normalised(F.col("text"))).alias("digest"))
    return rest.unionByName(some.dropDuplicates(["doc_id", "digest"]).select("row.*"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicates(common.documents(spark, sf_dir), digests=True)
    return found.withColumn("text_sha256", F.lower(F.hex("text_sha256")))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM t
"""

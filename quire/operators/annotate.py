"""Image annotation: what needs a model, runs of images, their context, cached and new replies, and blocks with descriptions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import importable
from quire.functions import replies
from quire.models import ModelClient, OfflineClient
from quire.operators.blocks import HEADS

#: Entries of a context beyond which its middle is left out.
CONTEXT = 2000


def needs_model(items: DataFrame) -> Column:
    """Items that hold an image, or are a plain table with a picture of it."""
    types = F.transform("members", lambda m: m["data_type"])
    return F.exists(types, lambda t: t.startswith("image")) | (~F.col("is_cluster") & (F.col("members")[0]["data_type"] == "table") & F.col("members")[0]["table_path"].isNotNull())


def runs(items: DataFrame) -> DataFrame:
    """Members of items that need a model, with run: consecutive images share one, all others have none."""
    rows = items.where(needs_model(items)).select("doc_id", "page_idx", "item", "first_order", *HEADS, F.posexplode("members").alias("pos", "m"))
    rows = rows.select("doc_id", "page_idx", "item", "first_order", *HEADS, "pos", "m.*")
    image = (F.col("data_type") == "image") | F.col("table_path").isNotNull()
    order = Window.partitionBy("doc_id", "page_idx", "item").orderBy("pos")
    starts = image & ~F.coalesce(F.lag(image).over(order), F.lit(False))
    return rows.withColumn("run", F.when(image, F.sum(starts.cast("int")).over(order)))


def shortened(entries: Column, most: int = CONTEXT) -> Column:
    """entries without their middle where there are more than `most`: the outer halves stay."""
    half = most // 2
    return F.when(F.size(entries) > most, F.concat(F.slice(entries, 1, half), F.slice(entries, -half, half))).otherwise(entries)


def contexts(members: DataFrame) -> DataFrame:
    """A request for each run: doc_id, page_idx, item, run, first, images (paths in order), context.

    The context has the headings, then the text or table right before and right after the run. Of more than CONTEXT entries,
    headings and the outer halves stay.
    """
    rows = beside(members).where("run IS NOT NULL")
    # a run ends where its last image is: only there is what follows not of the run
    found = rows.groupBy("doc_id", "page_idx", "item", "run", *HEADS).agg(
        F.min("pos").alias("first"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("table_path", "data").alias("path")))), lambda x: x["path"]).alias("images"),
        F.min_by("ahead", "pos").alias("ahead"),
        F.max_by("behind", "pos").alias("behind"),
    )
    return found.select("doc_id", "page_idx", "item", "run", "first", "images", _context().alias("context"))


def beside(members: DataFrame) -> DataFrame:
    """members with ahead and behind: what the text or table right before and right after each says."""
    order = Window.partitionBy("doc_id", "page_idx", "item").orderBy("pos")
    said = lambda f, word: F.when(f("data_type").over(order).isin("text", "table"), F.concat(F.lit(f"{word} "), (f("reading_order").over(order) + 1).cast("string"), F.lit(" ("), f("data_type").over(order), F.lit("): "), f("data").over(order)))
    return members.withColumns({"ahead": said(F.lag, "前文"), "behind": said(F.lead, "后文")})


def _context() -> Column:
    heads = F.array_compact(F.array(*[F.concat(F.lit(f"{h.upper()}: "), F.col(h)) for h in HEADS]))
    return F.array_join(F.concat(heads, shortened(F.array_compact(F.array("ahead", "behind")))), "\n")


def cache_key(prompt: Column, images: Column) -> Column:
    return F.md5(F.concat(prompt, F.to_json(F.array_sort(images))))


def with_cache(requests: DataFrame, cache: DataFrame, now: Column, hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(requests with the newest cached result within `hours`, requests that miss), by key. Cache rows are cut to one a key first."""
    fresh = cache.where(F.col("ts") > now - F.expr(f"interval {hours} hours")).groupBy("key").agg(F.max_by("result", "ts").alias("result"))
    return requests.join(fresh, "key"), requests.join(fresh, "key", "left_anti")


def described(requests: DataFrame, client: ModelClient | None = None, slots: int | None = None) -> DataFrame:
    """requests with kind and description from a model's reply "<kind> <text>".

    The model is called batch by batch in Python workers; `slots` bounds how many call at once, as by a number of keys. Without a
    client the offline one answers, which depends on the request alone.
    """
    importable(requests.sparkSession)
    client = client or OfflineClient()
    rows = requests.repartition(slots) if slots else requests

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(reply=[client.describe(list(images), context) for images, context in zip(batch["images"], batch["context"], strict=True)])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in requests.schema.fields)
    rows = rows.mapInPandas(run, f"{fields}, reply string")
    kind, description = replies.kind_and_text(F.col("reply"))
    return rows.withColumns({"kind": kind, "description": description}).drop("reply")


def merged(items: DataFrame, annotated_: DataFrame) -> DataFrame:
    """All members of items, those that a model was asked about as annotated(): the others keep their type and have no group."""
    rows = items.select("doc_id", "page_idx", "item", *HEADS, F.posexplode("members").alias("pos", "m")).select("doc_id", "page_idx", "item", "pos", *HEADS, "m.*")
    told = annotated_.select("doc_id", "page_idx", "item", "pos", F.col("data_type").alias("told"), "group_id", "kind", "description")
    rows = rows.join(told, ["doc_id", "page_idx", "item", "pos"], "left")
    return rows.select("doc_id", "page_idx", "item", "pos", *HEADS, "reading_order", "data", "table_path", F.coalesce("told", "data_type").alias("data_type"), "group_id", "kind", "description")


def figure_tags(members: DataFrame) -> DataFrame:
    """Consecutive combined figures of an item as one row: doc_id, page_idx, item, first, n and tag, their types joined by +."""
    order = Window.partitionBy("doc_id", "page_idx", "item").orderBy("pos")
    rows = members.withColumn("on", F.coalesce(F.col("kind") == "组合图", F.lit(False)))
    rows = rows.withColumn("island", F.sum((F.col("on") & ~F.coalesce(F.lag("on").over(order), F.lit(False))).cast("int")).over(order)).where("on")
    tags = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "data_type"))), lambda x: x["data_type"]), "+")
    return rows.groupBy("doc_id", "page_idx", "item", "island").agg(F.min("pos").alias("first"), F.count("*").alias("n"), tags.alias("tag")).drop("island")


def annotated(members: DataFrame, replies_: DataFrame) -> DataFrame:
    """Members with group_id and kind on each image of a run; the description stands on its first."""
    found = replies_.select("doc_id", "page_idx", "item", "run", "first", "kind", "description")
    rows = members.join(found, ["doc_id", "page_idx", "item", "run"], "left")
    return _tagged(rows.withColumn("description", F.when(F.col("pos") == F.col("first"), F.col("description"))))


def asked_in_place(members: DataFrame, client: ModelClient | None = None) -> DataFrame:
    """annotated() of members and described(contexts(members)) in one pass over members: the request of a run stands on its first row, and the model is called from there."""
    importable(members.sparkSession)
    client = client or OfflineClient()
    run = Window.partitionBy("doc_id", "page_idx", "item", "run").orderBy("pos")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    begins = F.col("run").isNotNull() & (F.col("place") == 1)
    rows = beside(members).withColumns({"place": F.row_number().over(run), "images": F.collect_list(F.when(F.col("run").isNotNull(), F.coalesce("table_path", "data"))).over(whole), "behind": F.last("behind").over(whole)})

    @F.pandas_udf("string")
    def describe(images: pd.Series, context: pd.Series) -> pd.Series:
        return pd.Series([None if i is None else client.describe(list(i), c) for i, c in zip(images, context, strict=True)], dtype=object)

    # as it isn't called deterministic, no plan calls it twice
    rows = rows.withColumn("reply", describe.asNondeterministic()(F.when(begins, F.col("images")), F.when(begins, _context())))
    kind, description = replies.kind_and_text(F.col("reply"))
    rows = rows.withColumns({"kind": F.first(F.when(begins, kind)).over(whole), "description": F.when(begins, description)})
    return _tagged(rows)


def _tagged(rows: DataFrame) -> DataFrame:
    group = F.when(F.col("kind").isNotNull(), F.concat_ws("-", "doc_id", "page_idx", "item", "run"))
    ordinal = F.row_number().over(Window.partitionBy("doc_id", "page_idx", "item", F.col("run").isNotNull()).orderBy("pos"))
    tag = F.when(F.col("kind").isNotNull(), F.concat(F.col("data_type"), F.lit("<image["), ordinal.cast("string"), F.lit("]["), "kind", F.lit("]>"))).otherwise(F.col("data_type"))
    return rows.select("doc_id", "page_idx", "item", "pos", *HEADS, "reading_order", "data", "table_path", tag.alias("data_type"), group.alias("group_id"), "kind", "description")

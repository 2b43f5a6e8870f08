"""What asks models, page readers and image encoders. Each takes a client, and calls it batch by batch in Python workers.

A client is any object with the methods of models.ModelClient (or OcrProvider, PageRenderer); without one the offline client
answers. Prompts, endpoints and keys are the client's. A reply that can't be used falls back to what needs no model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire import importable
from quire.functions import replies, text
from quire.models import ModelClient, OcrProvider, OfflineClient, PageCutter, PageRenderer
from quire.operators import reports, titles
from quire.plans import pipeline


def asked(rows: DataFrame, columns: list[str], call: Callable, name: str = "reply", kind: str = "string") -> DataFrame:
    """rows with `name`, what call(*columns) says of each row."""
    importable(rows.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{name: [call(*row) for row in zip(*[batch[c] for c in columns], strict=True)]})

    return rows.mapInPandas(run, f"{fields}, `{name}` {kind}")


def outline_replies(images: DataFrame, client: ModelClient | None = None, examples: list[bytes] = ()) -> DataFrame:
    """doc_id and reply of images(doc_id, image) of contents pages. Examples, a few page images, go along with each request."""
    client, examples = client or OfflineClient(), list(examples)
    return asked(images.select("doc_id", "image"), ["image"], lambda image: client.outline(bytes(image), examples)).select("doc_id", "reply")


def titles_of(found: DataFrame) -> DataFrame:
    """Titles of replies(doc_id, reply): from a JSON array if there is one, else from an indented outline."""
    rows = found.withColumn("tree", replies.json_array(F.col("reply")))
    columns = ["doc_id", "ord", "title", "level", "top_idx", "parent"]
    trees = titles.flatten(rows.where("tree IS NOT NULL").select("doc_id", "tree")).select(columns)
    return trees.unionByName(replies.outlines(rows.where("tree IS NULL").select("doc_id", "reply")).select(columns))


def chosen(rows: DataFrame, heads: DataFrame, client: ModelClient | None = None) -> DataFrame:
    """doc_id, ord and line_no: the heading that the model picks of each title's nearest three, else the nearest."""
    client = client or OfflineClient()
    near = titles.candidates(rows, heads).join(heads.select("doc_id", "line_no", F.col("title").alias("heading")), ["doc_id", "line_no"])
    sets = near.groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(F.struct("rank", "heading", "line_no"))).alias("c"))
    sets = sets.select("doc_id", "ord", F.col("c.heading").alias("names"), F.col("c.line_no").alias("places")).join(rows.select("doc_id", "ord", "title"), ["doc_id", "ord"])
    told = asked(sets, ["title", "names"], lambda title, names: client.choose(title, list(names)))
    picked = F.array_position("names", replies.choice(F.col("reply"), F.col("names")))
    return told.select("doc_id", "ord", F.element_at("places", F.when(picked > 0, picked).otherwise(1).cast("int")).alias("line_no"))


def placed(rows: DataFrame, missing: DataFrame, client: ModelClient | None = None, around: int = 0) -> DataFrame:
    """doc_id, ord, title, level and at: before which line each of missing(doc_id, ord, title, level, prev_line, next_line) goes.

    The model sees the lines from `around` before the window to `around` behind it and answers with a line of those, counted from 1;
    an answer that names none means the window's first line. Lines are joined to windows by document and range.
    """
    client = client or OfflineClient()
    low, high = F.greatest(F.col("prev_line") - around, F.lit(0)), F.col("next_line") + around
    windows = missing.join(rows, "doc_id", "left").where(F.col("line_no").isNull() | F.col("line_no").between(low, high))
    seen = windows.groupBy("doc_id", "ord").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("w"))
    seen = missing.join(seen, ["doc_id", "ord"], "left").withColumn("lines", F.coalesce(F.col("w.line"), F.array().cast("array<string>")))
    told = asked(seen.select("doc_id", "ord", "title", "level", "prev_line", F.col("w.line_no").alias("numbers"), "lines"), ["title", "lines"], lambda title, lines: client.place(title, list(lines)))
    at = F.get("numbers", replies.line_number(F.col("reply"), F.size("lines")) - 1)
    return told.select("doc_id", "ord", "title", "level", F.coalesce(at, "prev_line").alias("at"))


def relevance(rows: DataFrame, client: ModelClient | None = None) -> DataFrame:
    """rows(title, context) with analysis: the model's JSON, or its words under raw_analysis."""
    client = client or OfflineClient()
    told = asked(rows, ["title", "context"], lambda title, context: client.relate(title, context))
    return told.withColumn("analysis", F.when(F.try_parse_json("reply").isNotNull(), F.col("reply")).otherwise(F.to_json(F.struct(F.col("reply").alias("raw_analysis"))))).drop("reply")


def page_texts(pages: DataFrame, provider: OcrProvider, least: int = 1) -> DataFrame:
    """pages(doc_id, page_num, text, image) with text, from the text layer where it has `least` characters, else read from the image.

    Only pages without a text layer reach the provider; a page without either has an empty text.
    """
    layer = text.strip(F.coalesce("text", F.lit("")))
    rows = pages.withColumn("__bare", F.length(layer) < least)
    read = asked(rows.where("__bare").drop("text", "__bare"), ["image"], lambda image: provider.text(bytes(image)) if image is not None else "", "text")
    return rows.where("NOT __bare").select(pages.columns).unionByName(read.select(pages.columns))


def page_images(pages: DataFrame, renderer: PageRenderer, scale: float = 3.0) -> DataFrame:
    """doc_id, page_num and image of pages(doc_id, page_num, content), content being the PDF's bytes."""
    rows = asked(pages.select("doc_id", "page_num", "content"), ["content", "page_num"], lambda content, number: renderer.render(bytes(content), int(number), scale), "image", "binary")
    return rows.select("doc_id", "page_num", "image")


def text_lengths(images: DataFrame, provider: OcrProvider) -> DataFrame:
    """path and text_length of images(path, content), as pipeline.preprocess() takes them: characters read, blanks at the ends not counted."""
    read = asked(images.select("path", "content"), ["content"], lambda content: provider.text(bytes(content)), "text")
    return read.select("path", F.length(text.strip(F.coalesce("text", F.lit("")))).alias("text_length"))


def without_pages(pdfs: DataFrame, pages: DataFrame, cutter: PageCutter) -> DataFrame:
    """pdfs(doc_id, content), the pages(doc_id, page_num) cut out of those that have any."""
    gone = pages.groupBy("doc_id").agg(F.array_sort(F.collect_set("page_num")).alias("gone"))
    rows = pdfs.join(gone, "doc_id", "left")
    cut = asked(rows.where("gone IS NOT NULL"), ["content", "gone"], lambda content, gone: cutter.cut(bytes(content), [int(x) for x in gone]), "less", "binary")
    return rows.where("gone IS NULL").select(pdfs.columns).unionByName(cut.withColumn("content", F.col("less")).select(pdfs.columns))


def structure(rows: DataFrame, found: DataFrame, config: pipeline.Structure = pipeline.Structure(), client: ModelClient | None = None) -> tuple[DataFrame, DataFrame]:
    """pipeline.structure() for replies found(doc_id, reply), missing titles placed by the model if config has use_llm_matching.

    A document whose reply has no titles keeps its lines.
    """
    titles_ = titles_of(found)
    places = None
    if config.use_llm_matching and config.auto_insert_missing_titles:
        heads = titles.headings(rows)
        matches = titles.align(titles_, heads, config.title_similarity_threshold, config.cjk_only, config.fuzzy_match)
        places = placed(rows, titles.anchors(titles_, matches, heads), client)
    return pipeline.structure(rows, titles_, config, places)


def structure_ablation(rows: DataFrame, titles_: DataFrame, names: list[str] | None = None, config: pipeline.Structure = pipeline.Structure()) -> DataFrame:
    """A row for the baseline and each named variation: titles, matched, rate, its difference to the baseline's, and rank by rate, then name."""
    known = {name: config if name == "baseline" else pipeline.varied(config, name, pipeline.STRUCTURE_ABLATIONS) for name in ["baseline", *(names or pipeline.STRUCTURE_ABLATIONS)]}
    # variations that match alike are counted once: the threshold only counts for fuzzy ones
    rules = {name: (c.title_similarity_threshold if c.fuzzy_match else 1.0, c.cjk_only, c.fuzzy_match) for name, c in known.items()}
    apart = list(dict.fromkeys(rules.values()))
    counts = titles.matched_counts(titles_, titles.headings(rows), apart)
    log = counts.select("titles", F.inline(F.array(*[F.struct(F.lit(name).alias("experiment"), F.col("matched")[apart.index(rule)].alias("matched")) for name, rule in rules.items()])))
    log = log.withColumn("rate", F.col("matched") / F.greatest(F.lit(1), F.col("titles")))
    every = Window.orderBy(F.desc("rate"), "experiment")  # a row for each variation
    base = F.max(F.when(F.col("experiment") == "baseline", F.col("rate"))).over(Window.partitionBy())
    return log.select("experiment", "titles", "matched", "rate", (F.col("rate") - base).alias("rate_delta"), F.row_number().over(every).alias("rank"))


def batch_report(good: DataFrame, failed: DataFrame) -> DataFrame:
    """total, ok, failed and rate of documents read and files that failed, as sources.files.checked() gives them."""
    log = good.select("doc_id").distinct().withColumn("success", F.lit(True)).unionByName(failed.select("doc_id").withColumn("success", F.lit(False)))
    return reports.batch_summary(log)

"""Stages put together: preprocess, structure, and the way from lines to final records. Every call is a lazy plan."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.models import ModelClient
from quire.operators import annotate, blocks, files, markdown, titles, toc


@dataclass(frozen=True)
class Preprocess:
    add_page_markers: bool = True
    preserve_html_tables: bool = True
    link_images: bool = True
    validate_image_existence: bool = True
    text_detection: bool = True
    confidence_threshold: float = 30.0
    min_text_length: int = 3
    experiment: str = "default"

    def errors(self) -> list[str]:
        out = []
        if not 0 <= self.confidence_threshold <= 100:
            out.append("confidence_threshold is outside 0 to 100")
        if self.min_text_length < 0:
            out.append("min_text_length is negative")
        return out


@dataclass(frozen=True)
class Structure:
    title_similarity_threshold: float = 0.8
    fuzzy_match: bool = True
    use_llm_matching: bool = True
    auto_insert_missing_titles: bool = True
    insert_confidence_threshold: float = 0.7
    auto_adjust_levels: bool = True
    demote_unmatched: bool = True
    cjk_only: bool = False
    experiment: str = "default"

    def errors(self) -> list[str]:
        return [f"{k} is outside 0 to 1" for k in ("title_similarity_threshold", "insert_confidence_threshold") if not 0 <= getattr(self, k) <= 1]


#: Named variations and presets; an unknown name is an error.
PREPROCESS_ABLATIONS = {
    "no_text_detection": {"text_detection": False},
    "no_image_validation": {"validate_image_existence": False},
    "minimal_processing": {"link_images": False, "text_detection": False},
    "high_confidence": {"confidence_threshold": 70.0, "min_text_length": 10},
    "low_confidence": {"confidence_threshold": 10.0, "min_text_length": 1},
}
STRUCTURE_ABLATIONS = {
    "no_llm_matching": {"use_llm_matching": False},
    "no_fuzzy_match": {"fuzzy_match": False},
    "strict_matching": {"title_similarity_threshold": 0.95, "fuzzy_match": False, "use_llm_matching": False},
    "high_similarity": {"title_similarity_threshold": 0.9, "insert_confidence_threshold": 0.8},
    "low_similarity": {"title_similarity_threshold": 0.6, "insert_confidence_threshold": 0.5},
    "no_auto_insert": {"auto_insert_missing_titles": False},
    "minimal_processing": {"use_llm_matching": False, "fuzzy_match": False, "auto_insert_missing_titles": False, "auto_adjust_levels": False},
}
PRESETS = {"fast": {"text_detection": False}, "high_quality": {"confidence_threshold": 50.0, "min_text_length": 5}, "debug": {}}


def loaded(kind: type, values: dict):
    """A configuration of Preprocess or Structure from a dict; unknown names and values out of range are errors."""
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    config = kind(**values)
    if errors := config.errors():
        raise ValueError("; ".join(errors))
    return config


def preset(name: str, config: Preprocess = Preprocess()) -> Preprocess:
    return varied(config, name, PRESETS)


def varied(config, name: str, table: dict[str, dict]):
    if name not in table:
        raise ValueError(f"unknown variation: {name}")
    return replace(config, experiment=name, **table[name])


@dataclass
class Inputs:
    """What a run reads besides its objects; all are optional."""

    images: DataFrame | None = None  # path
    image_text: DataFrame | None = None  # path, text_length, and maybe confidence


def preprocess(objects: DataFrame, config: Preprocess = Preprocess(), inputs: Inputs | None = None) -> DataFrame:
    """Layout objects to Markdown lines: render, link, and drop links whose image has too little text."""
    inputs = inputs or Inputs()
    lines = markdown.render(objects, config.add_page_markers, config.preserve_html_tables)
    if config.link_images:
        lines = markdown.link_images(lines, inputs.images if config.validate_image_existence else None)
    if config.text_detection and inputs.image_text is not None:
        known = inputs.image_text
        if "confidence" in known.columns:
            known = known.withColumn("text_length", F.when(F.col("confidence") >= config.confidence_threshold, F.col("text_length")).otherwise(0))
        lines = markdown.keep_readable(lines, known, config.min_text_length)
    return lines


def structure(lines: DataFrame, titles_: DataFrame, config: Structure = Structure(), places: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(lines with levels by their titles, the alignment). Missing titles go to `places` or else before their anchor.

    Places that carry a confidence below insert_confidence_threshold don't count.
    """
    found = titles.aligned(titles_, titles.headings(lines), config.title_similarity_threshold, config.cjk_only, config.fuzzy_match)
    matches = found.select("doc_id", "ord", "line_no", "score")
    if not config.auto_insert_missing_titles:
        levels = found.where("line_no IS NOT NULL").select("doc_id", "line_no", F.col("level").alias("new_level"))
        return titles.levelled(lines, levels, config.demote_unmatched) if config.auto_adjust_levels else lines, matches
    where = found.withColumn("at", F.col("prev_line"))
    if places is not None and config.use_llm_matching:
        if "confidence" in places.columns:
            places = places.where(F.col("confidence") >= config.insert_confidence_threshold)
        known = places.select("doc_id", "ord", F.col("at").alias("told"))
        where = where.join(known, ["doc_id", "ord"], "left").withColumn("at", F.coalesce("told", "at"))
    return titles.restructured(lines, where, config.auto_adjust_levels, config.demote_unmatched), matches


def page_records(lines: DataFrame, tolerant: bool = False) -> DataFrame:
    """Lines to blocks, clusters and back to a record for each page. The windows and groups share their keys' partitioning."""
    rows = blocks.blocks(markdown.pages(lines), tolerant)
    return blocks.page_records(blocks.restored(blocks.clusters(rows)))


def annotated(lines: DataFrame, client: ModelClient | None = None, slots: int | None = None) -> DataFrame:
    """Members of clusters with image kinds and descriptions. With `slots`, requests are dealt to as many callers and their replies joined."""
    items = blocks.clusters(blocks.blocks(markdown.pages(lines)))
    members = annotate.runs(items)
    if not slots:
        return annotate.asked_in_place(members, client)
    return annotate.annotated(members, annotate.described(annotate.contexts(members), client, slots))


def final_reports(lines: DataFrame, names: DataFrame) -> DataFrame:
    """Final reports of documents, with metadata from names(doc_id, path)."""
    meta = names.select("doc_id", files.report_metadata(F.col("path")).alias("m")).select("doc_id", "m.*")
    return blocks.report(page_records(lines), meta)


def ablation(objects: DataFrame, inputs: Inputs | None = None, names: list[str] | None = None, config: Preprocess = Preprocess()) -> DataFrame:
    """Lines of each named variation, with an experiment column."""
    out = None
    for name in names or PREPROCESS_ABLATIONS:
        varied_ = varied(config, name, PREPROCESS_ABLATIONS)
        rows = preprocess(objects, varied_, inputs).withColumn("experiment", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def without_contents_pages(pages: DataFrame) -> DataFrame:
    return toc.without_toc(pages)

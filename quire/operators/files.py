"""What file names and paths tell: metadata, envelopes, URL forms, rename plans, work items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text

#: Fixed values.
SUFFIXES = ["_grouped", "_vlm", "_clustered", "_aligned", "_processed", "_final"]
UNKNOWN = {"stock_code": "UNKNOWN", "company_name": "未知公司", "report": "未知报告", "type": "未知类型"}
TOC_IMAGES = ["page_2.jpg", "page_1.jpg", "toc.jpg", "contents.jpg", "目录.jpg", "page_2.JPG", "page_1.JPG", "toc.JPG", "contents.JPG", "目录.JPG"]
SKIPPED = ["preprocess_batch_log.json", "preprocess_config.json", "preprocess_report.json", "config.json", "log.json", "batch_log.json", "_log.json", "_config.json", "_report.json"]
SECTORS = {
    "能源": ["煤炭", "石油石化"],
    "公用事业": ["电力及公用事业"],
    "原材料": ["钢铁", "建材", "有色金属", "农林牧渔"],
    "工业": ["电力设备及新能源", "机械", "建筑", "国防军工", "汽车", "轻工制造"],
    "消费": ["家电", "商贸零售", "纺织服装", "传媒", "消费服务", "房地产", "食品饮料"],
    "医疗保健": ["医药"],
    "金融": ["非银行金融", "综合金融"],
    "信息技术": ["计算机", "电子"],
    "通信服务": ["通信"],
    "交通运输": ["交通运输"],
}


def _parsed(path: Column, suffixes: str, years: str) -> tuple[Column, Column, list[Column]]:
    name = F.regexp_replace(text.stem(path), f"(?:{suffixes})$", "")
    pattern = rf"^([^-]+)-([^-]+)-(\d{{4}})({years})(.+)$"
    return name.rlike(pattern), name, [text.strip(F.regexp_extract(name, pattern, i)) for i in range(1, 6)]


def report_metadata(path: Column) -> Column:
    """Of <code>-<company>-<year>年度<type> or 年<type>: the short form of metadata. What doesn't parse gets its defaults."""
    ok, _, (code, company, year, mark, kind) = _parsed(path, "_grouped|_vlm", "年度|年")
    pick = lambda c, other: F.when(ok, c).otherwise(F.lit(other))
    return F.struct(
        pick(code, UNKNOWN["stock_code"]).alias("stock_code"), pick(company, UNKNOWN["company_name"]).alias("company_name"), F.when(ok, year.try_cast("int")).alias("report_year"),
        pick(F.concat(year, mark, kind), UNKNOWN["report"]).alias("report_title"), F.lit("ESG_Report").alias("report_type"), F.lit("China").alias("market"), text.basename(path).alias("original_filename"),
    )


def file_metadata(path: Column, size: Column | None = None, modified: Column | None = None, now: Column | None = None) -> Column:
    """The long form: only 年度, the first of six suffixes removed, and what is known of the file."""
    ok, _, (code, company, year, mark, kind) = _parsed(path, "|".join(SUFFIXES), "年度")
    pick = lambda c, other: F.when(ok, c).otherwise(F.lit(other))
    none = lambda c, t: F.lit(None).cast(t) if c is None else c.cast(t)
    return F.struct(
        pick(code, UNKNOWN["stock_code"]).alias("stock_code"), pick(company, UNKNOWN["company_name"]).alias("company_name"), F.when(ok, year.try_cast("int")).alias("report_year"),
        pick(F.concat(year, mark, kind), UNKNOWN["report"]).alias("report_name"), pick(kind, UNKNOWN["type"]).alias("report_type"), text.basename(path).alias("original_filename"),
        none(now, "timestamp").alias("processing_timestamp"), none(size, "bigint").alias("file_size_bytes"), none(modified, "timestamp").alias("file_modified_time"), F.lit("ESG_REPORT_PROCESSING").alias("data_source"),
    )


def envelope(files: DataFrame) -> DataFrame:
    """files(path, json) with form (pages, existing, blocks or raw), the metadata merged over what the file has, and its content."""
    node = F.try_parse_json("json")
    has = lambda p: F.expr(f"try_variant_get(node, '{p}', 'variant')").isNotNull()
    kind = F.schema_of_variant("node")
    rows = files.withColumn("node", node)
    form = F.when(kind.startswith("OBJECT") & has("$.metadata"), "existing").when(kind.startswith("OBJECT") & has("$.pages"), "pages").when(kind.startswith("ARRAY") & has("$[0].data_type"), "blocks").otherwise("raw")
    rows = rows.withColumn("form", form)
    old = F.from_json(F.to_json(F.expr("try_variant_get(node, '$.metadata', 'variant')")), "map<string,string>")
    known = {"size": "size", "modified": "modified", "now": "now"}  # where files has them
    new = F.from_json(F.to_json(file_metadata(F.col("path"), **{k: F.col(c) for k, c in known.items() if c in files.columns})), "map<string,string>")
    empty = F.expr("cast(map() as map<string,string>)")
    kept = F.map_filter(F.coalesce(old, empty), lambda k, _: ~F.array_contains(F.map_keys(new), k))
    content = F.to_json(F.when(F.col("form").isin("existing", "pages") & has("$.pages"), F.expr("try_variant_get(node, '$.pages', 'variant')")).otherwise(F.col("node")))
    return rows.select("path", "form", F.map_concat(kept, new).alias("metadata"), content.alias("content"))


def url_forms(folder: Column, name: Column, report: Column | None = None) -> Column:
    """markdown_url, file_url, relative_path and http_url of an image. With a report folder, paths inside it are relative to it."""
    path = text.slashes(F.concat_ws("/", folder, name))
    own = text.basename(folder)
    short = F.concat_ws("/", own, name)
    relative, http = short, short
    if report is not None:
        inside = path.startswith(F.concat(report, F.lit("/")))
        beside = F.concat(F.lit("../"), F.substr(path, F.length(text.dirname(report)) + 2))
        relative = F.when(inside, F.substr(path, F.length(report) + 2)).when(text.dirname(report) == text.dirname(folder), beside).otherwise(short)
        http = F.when(text.dirname(folder) == report, F.concat_ws("/", text.basename(report), short)).otherwise(short)
    return F.struct(F.concat(F.lit("![]("), short, F.lit(")")).alias("markdown_url"), F.concat(F.lit("file://"), text.quote(path, ":/")).alias("file_url"), relative.alias("relative_path"), F.concat(F.lit("http://localhost:8000/"), text.quote(http)).alias("http_url"))


def fixed_urls(rows: DataFrame, files: DataFrame, column: str = "file_url", root: str = "file://") -> DataFrame:
    """rows with `fixed`: the URL decoded, looked up in files(path) and encoded again; null where no such file is."""
    path = text.slashes(text.unquote(F.substr(F.col(column), F.lit(len(root) + 1))))
    there = files.select(F.col("path").alias("__path")).distinct()
    found = rows.withColumn("__want", path).join(there, F.col("__want") == F.col("__path"), "left")
    return found.withColumn("fixed", F.when(F.col("__path").isNotNull(), F.concat(F.lit(root), text.quote(F.col("__path"), ":/")))).drop("__want", "__path")


def rename_plan(names: DataFrame) -> DataFrame:
    """src, dst and action of names(name): keep, rename, or collision where the new name is taken or wanted twice."""
    rows = names.select(F.col("name").alias("src"), text.clean_name(F.col("name")).alias("dst")).distinct()
    wanted = rows.groupBy("dst").agg(F.count("*").alias("n"), F.max(F.col("src") == F.col("dst")).alias("taken"))
    rows = rows.join(wanted, "dst")
    return rows.select("src", "dst", F.when(F.col("src") == F.col("dst"), "keep").when((F.col("n") > 1) | F.col("taken") | (F.col("dst") == ""), "collision").otherwise("rename").alias("action"))


def report_files(files: DataFrame) -> DataFrame:
    """JSON files that are reports: no dot or ~ names, none that equals or ends in a skipped name."""
    skip = F.lit(False)
    for s in SKIPPED:
        skip |= F.col("name").endswith(s)
    return files.where(F.col("name").endswith(".json") & ~F.col("name").rlike("^[.~]") & ~skip)


def work_items(files: DataFrame) -> DataFrame:
    """folder, markdown and toc_image of folders that have both: the image by the fixed order of names, else the first JPG."""
    jpg = files.where(F.lower("name").endswith(".jpg"))
    order = F.array_position(F.array(*map(F.lit, TOC_IMAGES)), F.col("name"))
    rank = F.struct(F.when(order > 0, order).otherwise(99), F.col("name"))
    images = jpg.groupBy("folder").agg(F.min_by("name", rank).alias("toc_image"))
    docs = files.where(F.col("name").endswith("_preprocessed.md")).groupBy("folder").agg(F.min("name").alias("markdown"))
    return docs.join(images, "folder").select("folder", "markdown", "toc_image")


def by_folder(files: DataFrame, excluded: list[str] = ()) -> DataFrame:
    """Files of each folder whose name doesn't end in an excluded suffix: folder, n_files, names."""
    rows = files
    for s in excluded:
        rows = rows.where(~F.col("folder").endswith(s))
    return rows.groupBy("folder").agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list("name")).alias("names"))


def paired(reports: DataFrame, images: DataFrame) -> DataFrame:
    """report and image folders that belong together: a leading eight-digit date doesn't count."""
    key = F.concat(F.regexp_replace("report", r"^\d{8}_", ""), F.lit("_without_toc"))
    return reports.withColumn("images", key).join(images.select("images").distinct(), "images").select("report", "images")


def sectors(spark) -> DataFrame:
    return spark.createDataFrame([(s, i) for s, industries in SECTORS.items() for i in industries], "sector string, industry string")


def output_folder(path: Column, root: str, out: str) -> Column:
    """Where the results of a file go: its folder below `root` moved below `out`, and in it one named after the file."""
    return F.concat(F.lit(out), F.substr(text.dirname(path), F.lit(len(root) + 1)), F.lit("/"), text.stem(path), F.lit("_preprocessed"))

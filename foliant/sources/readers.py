"""Readers of the formats that come in. All of them go through Spark, so any store that it reads will do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import image_page_id, ocr_issue_id
from foliant.sources import exports
from foliant.sources import hocr as hocr_source

_S = lambda name: T.StructField(name, T.StringType())
EXCERPT = T.StructType([_S("journal_id"), _S("page_id"), T.StructField("page_number", T.IntegerType()), T.StructField("page_type", T.IntegerType()), *map(_S, ("title", "authors", "refs", "toc", "explanation"))])
GROUND = "file_basename string, page_type int"
#: Lists of an annotation export and their items.
COCO = {
    "images": "struct<id:bigint,width:int,height:int,file_name:string>",
    "annotations": "struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>>",
    "categories": "struct<id:bigint,name:string>",
}


def images(spark: SparkSession, path: str) -> DataFrame:
    """Paths of a folder's .jpg and .png files in the order of their names. Contents are not read; a folder without any is an error."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,png}").load(path).select("path")
    if found.isEmpty():
        raise ValueError(f"no images in {path}")
    return found.orderBy("path")


def excerpts(spark: SparkSession, path: str) -> DataFrame:
    """Excerpt lines; a broken line or one that lacks a key fails the query that reads it."""
    rows = spark.read.schema(EXCERPT).option("mode", "FAILFAST").json(path)
    whole = [F.col(c).isNotNull() for c in EXCERPT.names]
    ok = whole[0]
    for w in whole[1:]:
        ok = ok & w
    checked = F.when(ok, F.col("page_id")).otherwise(F.raise_error(F.lit("an excerpt lacks a key")))
    return rows.withColumn("page_id", checked)


def ground(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file_basename, page_type and seq from one or many CSV files, headers dropped.

    seq orders the rows: by the place of their path in the list (a file below a folder by its own path), then as they stand
    in the file. Row ids grow within a block of a file, and blocks are ordered by where they start.
    """
    def read(i: int, one: str) -> DataFrame:
        rows = spark.read.schema(GROUND).option("header", True).csv(one)
        at = F.struct(F.lit(i).alias("list"), "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
        return rows.select("file_basename", "page_type", at.alias("seq"))

    return reduce(DataFrame.unionAll, [read(i, p) for i, p in enumerate([path] if isinstance(path, str) else path)])


def stats(spark: SparkSession, path: str | list[str]) -> DataFrame:
    from foliant.operators.datasets import COUNTS

    return spark.read.schema("issue_id string, " + ", ".join(f"{c} bigint" for c in COUNTS)).option("header", True).csv(path)


def key_values(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, key and value of lines like key=value."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.split("value", "=", 2).alias("p")).where(F.size("p") == 2)
    return rows.select("file", F.col("p")[0].alias("key"), F.col("p")[1].alias("value"))


def training_vectors(spark: SparkSession, path: str) -> DataFrame:
    """vec and page_type from training lines; every line counts, there is no header."""
    parts = F.transform(F.split("value", ","), lambda x: F.trim(x).cast("double"))
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    return rows.select(F.slice("p", F.lit(1), F.size("p") - 1).alias("vec"), F.element_at("p", -1).cast("int").alias("page_type"))


def label_names(spark: SparkSession, path: str) -> DataFrame:
    """label (from 1) and name, one name a line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.transform(F.split("value", "\n"), F.trim), lambda x: x != "")).alias("n", "name"))
    return lines.select((F.col("n") + 1).alias("label"), "name")


def coco_items(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """task (the file's name without suffix), n and the items of one list of annotation exports, read a piece at a time."""
    exports.register(spark)
    rows = spark.read.format("json_items").load(path).where(F.col("list") == kind)
    return rows.select(image_page_id(F.col("file")).alias("task"), "n", F.from_json("item", COCO[kind], {"mode": "FAILFAST"}).alias("item"))


def coco(spark: SparkSession, path: str) -> DataFrame:
    """task, images, annotations and categories of annotation exports; a task that lacks a list has an empty one."""
    exports.register(spark)
    rows = spark.read.format("json_items").load(path).where(F.col("list").isin(*COCO))
    parsed = [F.when(F.col("list") == k, F.struct("n", F.from_json("item", t, {"mode": "FAILFAST"}).alias("x"))).alias(k) for k, t in COCO.items()]
    lists = rows.select(image_page_id(F.col("file")).alias("task"), *parsed).groupBy("task").agg(*[F.array_sort(F.collect_list(k)).alias(k) for k in COCO])
    return lists.select("task", *[F.transform(k, lambda v: v["x"]).alias(k) for k in COCO])


def outline_project(spark: SparkSession, path: str) -> DataFrame:
    """Regions of image-outline projects: file_name, n, shape attributes and region attributes as maps."""
    region = "struct<shape_attributes:map<string,string>,region_attributes:map<string,string>>"
    schema = f"_via_img_metadata map<string,struct<filename:string,regions:array<{region}>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("_via_img_metadata").alias("k", "v"))
    return rows.select(F.col("v.filename").alias("file_name"), F.posexplode("v.regions").alias("n", "r")).select("file_name", "n", "r.shape_attributes", "r.region_attributes")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """seq, date and identifier of catalog lines (JSON with date and identifier)."""
    from foliant.functions.text import to_timestamp

    rows = spark.read.schema("date string, identifier string").json(path)
    return rows.select(F.monotonically_increasing_id().alias("seq"), to_timestamp(F.col("date")).alias("date"), "identifier")


def debug_images(spark: SparkSession, path: str) -> DataFrame:
    """page_id and path of the images of boxes below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*__boxes.jpg").load(path)
    return rows.select(F.regexp_extract("path", r"([^/]*)__boxes\.jpg$", 1).alias("page_id"), "path")


def masks(spark: SparkSession, path: str) -> DataFrame:
    """file_name (below the folder) and content of the .png files of a folder, for images.mask_colours()."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(path)
    return rows.select(F.substring_index("path", "/", -1).alias("file_name"), "content")


def issue_results(spark: SparkSession, path: str) -> DataFrame:
    """Result documents of issues below a folder."""
    article = "struct<title:string,authors:string,page:int,page_id:string,refs:string>"
    return spark.read.schema(f"articles array<{article}>, toc_ocr string, issue_id string, journal_id string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.extract.json").json(path)


def hocr_files(spark: SparkSession, path: str) -> DataFrame:
    """issue_id and path of the OCR file of each issue below a folder; a plain file is taken before a packed one."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*hocr.html{,.gz}").load(path)
    rows = rows.select(ocr_issue_id(F.col("path")).alias("issue_id"), "path").where("issue_id is not null")
    return rows.groupBy("issue_id").agg(F.max_by("path", F.struct(~F.endswith("path", F.lit(".gz")), "path")).alias("path"))


def count_issues(spark: SparkSession, path: str) -> int:
    """Issues below a folder that have an OCR file, plain or packed, each counted once."""
    return hocr_files(spark, path).count()


def hocr(spark: SparkSession, path: str) -> DataFrame:
    """Words of all issues below a folder, as hocr.WORD; nested_lines() takes them. Filters on issue_id and page choose what is read."""
    hocr_source.register(spark)
    return spark.read.format("hocr").load(path)

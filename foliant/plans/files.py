"""Queries that write files and read them back, and those of the small functions over names, pages and labels."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import datasets, golden, regions
from foliant.plans import fixtures as fx
from foliant.plans.registry import answers
from foliant.sources import readers, writers


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or "file:///tmp/foliant-checkpoints"
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- files out and in


@answers(f"select journal_id, page_id, page_number, page_type, title, authors, refs, toc, 'note ' || page_id as explanation from ({fx.EXCERPTS}) e")
def excerpt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = folder(spark, "excerpts")
    writers.excerpts(fx.query(spark, sf_dir, fx.EXCERPTS).withColumn("explanation", F.concat(F.lit("note "), "page_id")), where)
    return readers.excerpts(spark, where).select(*readers.EXCERPT.names)


#: Two lists of pages with types: the second one repeats every third page with another type.
_TYPES = "select 'page_' || cast(doc_id as string) as file_basename, cast(quality as int) as page_type from labels"
_AGAIN = "select 'page_' || cast(doc_id as string) as file_basename, cast(3 - toxic as int) as page_type from labels where doc_id % 3 = 0"


@answers(f"select n.file_basename, coalesce(a.page_type, t.page_type, 0) as page_type from ({fx.NAMES}) n left join ({_TYPES}) t using (file_basename) left join ({_AGAIN}) a using (file_basename)")
def ground_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground truth of two files, of which the second one's rows count where both have a page."""
    where = folder(spark, "ground")
    for name, sql in (("a", _TYPES), ("b", _AGAIN)):
        writers.csv(fx.query(spark, sf_dir, sql), f"{where}/{name}")
    return datasets.with_ground(fx.query(spark, sf_dir, fx.NAMES), readers.ground(spark, [f"{where}/a", f"{where}/b"]))


_VECTORS = "select cast(doc_id as double) as a, cast(quality as double) / 4 as b, cast(toxic as int) as page_type from labels"


@answers(f"select a, b, page_type from ({_VECTORS}) v")
def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = folder(spark, "vectors")
    writers.training_vectors(fx.query(spark, sf_dir, _VECTORS).select(F.array("a", "b").alias("vec"), "page_type"), where)
    return readers.training_vectors(spark, where).select(F.get("vec", F.lit(0)).alias("a"), F.get("vec", F.lit(1)).alias("b"), "page_type")


@answers("select 'item_' || cast(o_orderkey as string) as identifier, o_orderdate as date from orders")
def catalog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = folder(spark, "catalog")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date")
    fx.table(spark, sf_dir, "orders").select(stamp, F.concat(F.lit("item_"), F.col("o_orderkey").cast("string")).alias("identifier")).write.json(where)
    return readers.catalog(spark, where).select("identifier", "date")


@answers("""with s as (select 'issue_' || cast(doc_id % 50 as string) as task, sum(quality) as quality, sum(toxic) as toxic from labels group by all)
select task, 'quality' as key, cast(quality as string) as value from s union all select task, 'toxic', cast(toxic as string) from s""")
def stats_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of issues as lines like key=value, a file for each issue."""
    where = folder(spark, "stats")
    issue = F.concat(F.lit("issue_"), (F.col("doc_id") % 50).cast("string")).alias("issue_id")
    writers.stats_text(fx.table(spark, sf_dir, "labels").groupBy(issue).agg(F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic")), where)
    rows = readers.key_values(spark, where).where("key <> 'task_name'")
    return rows.select(F.regexp_extract("file", "issue_id=([^/]+)", 1).alias("task"), "key", "value")


# --- annotation exports

#: Tasks of 50 images each: an image of each document, a box for each label row, and a status.
_EXPORT = """
select cast(floor(doc_id / 50) as int) as task_no, doc_id as image_id, cast(doc_id % 45 as int) as page_number,
       'scans/page_' || cast(doc_id % 45 as string) || case when doc_id % 7 = 0 then '.gif' when doc_id % 2 = 0 then '.jpg' else '.png' end as file_name from documents
"""


def tasks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.struct(F.col("image_id").alias("id"), F.lit(100).alias("width"), F.lit(200).alias("height"), "file_name")
    rows = fx.query(spark, sf_dir, _EXPORT).groupBy("task_no").agg(F.array_sort(F.collect_list(image)).alias("images"))
    names = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(n).alias("name")) for i, n in enumerate(tx.LABEL_NAMES, 1)])
    few = F.slice(names, 1, 3)  # every fifth task lacks a category
    status = F.when(F.col("task_no") % 3 == 0, "pending").otherwise("completed").alias("status")
    return rows.select(F.concat(F.lit("t"), F.col("task_no").cast("string")).alias("task"), status, "images", F.when(F.col("task_no") % 5 == 0, few).otherwise(names).alias("categories"))


@answers(f"""with r as (select *, row_number() over (partition by task_no, page_number order by image_id desc) as k from ({_EXPORT}) e
 where try_cast(split_part(replace(replace(file_name, '.jpg', ''), '.png', ''), '_', -1) as int) is not null)
select 't' || cast(task_no as string) as task, image_id, file_name, page_number from r where k = 1 and (file_name like '%.jpg' or file_name like '%.png')""")
def export_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of images of one page the last one counts, if its name is an image's."""
    # a name with another suffix tells no page number, so it takes no page from another image
    return golden.images_of(tasks_of(spark, sf_dir)).select("task", "image_id", "file_name", "page_number")


@answers(f"select distinct 't' || cast(task_no as string) as task from ({_EXPORT}) e where task_no % 3 <> 0 and task_no % 5 <> 0")
def export_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that are completed and have the expected categories."""
    return golden.same_categories(golden.completed(tasks_of(spark, sf_dir))).select("task")


@answers(f"select n.file_basename from ({fx.NAMES}) n where n.file_basename not in (select file_basename from ({_AGAIN}) a)")
def images_without_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.blank_images(fx.query(spark, sf_dir, fx.NAMES), fx.query(spark, sf_dir, _AGAIN))


# --- functions over names, labels and pages


@answers(f"""select doc_id, case when length(text) > 150 then substr(text, 1, 150) || '...' else text end as title,
 '{tx.BASE_URL}/' || source || '/page/n' || cast(doc_id as string) || '/mode/1up?admin=1' as page, '{tx.BASE_URL}/' || source || '/?admin=1' as issue from documents""")
def issue_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.short_title(F.col("text")).alias("title"), tx.page_url(F.col("source"), F.col("doc_id")).alias("page"), tx.issue_url(F.col("source")).alias("issue"))


@answers("""select doc_id, ['0,0,0', '255,0,0', '0,255,0', '0,0,255', '128,0,128'][doc_id % 5 + 1] as colour,
 cast(doc_id % 256 as string) || ',128,' || cast(quality as string) as rgb,
 array_to_string(list_transform(range(4), lambda j: case when j = doc_id % 4 then '1' else '0' end), ',') as bits from labels""")
def label_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    written = F.format_string("#%02x80%02x", F.col("doc_id") % 256, F.col("quality"))
    return fx.table(spark, sf_dir, "labels").select(
        "doc_id", text(tx.label_colour((F.col("doc_id") % 5).cast("int"))).alias("colour"), text(tx.hex_rgb(written)).alias("rgb"), text(tx.type_bits(F.col("doc_id") % 4, 4)).alias("bits")
    )


@answers("""select o_orderkey, case when o_orderkey % 4 = 0 then null else date_trunc('second', o_orderdate) end as stamp from orders""")
def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamps of catalogs; text of another form has none."""
    shape = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", tx.to_timestamp(shape).alias("stamp"))


_FILES = "select doc_id, 'scans/' || source || case when doc_id % 5 = 0 then '_cover' else '_' || lpad(cast(doc_id as string), 9, '0') end || case when doc_id % 3 = 0 then '.jpg' when doc_id % 3 = 1 then '.PNG' else '.txt' end as name from documents"


@answers(f"""with f as (select doc_id, name, replace(replace(split_part(name, '/', -1), '.jpg', ''), '.PNG', '') as base from ({_FILES}) n)
select doc_id, base, coalesce(try_cast(split_part(base, '_', -1) as int), -1) as page_number, name like '%.jpg' as image from f""")
def image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return fx.query(spark, sf_dir, _FILES).select("doc_id", tx.image_basename(name).alias("base"), F.coalesce(tx.image_page_number(name), F.lit(-1)).alias("page_number"), tx.is_image(name).alias("image"))


@answers(f"""with g as ({fx.GOLDEN}), c as ({fx.CHECK})
select g.page_id, g.page_type = 0 as blank, g.page_type = 1 as article, g.page_type = 2 as refs, g.page_type = 3 as toc,
 g.journal_id = c.journal_id and g.page_number = c.page_number as same_page, g.page_type = c.page_type as same_type from g join c using (page_id)""")
def page_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, c = (fx.query(spark, sf_dir, sql).alias(k) for k, sql in (("g", fx.GOLDEN), ("c", fx.CHECK)))
    both = g.join(c, "page_id").select("page_id", F.struct("g.journal_id", "page_id", "g.page_number", "g.page_type").alias("a"), F.struct("c.journal_id", "page_id", "c.page_number", "c.page_type").alias("b"))
    kinds = {"blank": tx.BLANK, "article": tx.ARTICLE, "refs": tx.REFS, "toc": tx.TOC}
    return both.select("page_id", *[tx.is_type(k, F.col("a.page_type")).alias(n) for n, k in kinds.items()], tx.same_page("a", "b").alias("same_page"), tx.same_type("a", "b").alias("same_type"))


_COUNTS = "select event_id, cast(event_id % 6 as int) as label, user_id * 7 as n from events"


@answers(f"select event_id, label, n from ({_COUNTS}) c where label > 0 and n >= 500")
def wanted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.wanted_labels(fx.query(spark, sf_dir, _COUNTS))


_PLACES = "select event_id, cast(event_id % 6 as int) as label, cast(user_id % 6 as int) as ith from events"


@answers(f"select event_id, label between 1 and 4 and ith between 0 and 3 as fits from ({_PLACES}) p")
def region_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = regions.checked(fx.query(spark, sf_dir, _PLACES))
    return good.select("event_id", F.lit(True).alias("fits")).unionByName(bad.select("event_id", F.lit(False).alias("fits")))

"""Queries through the files of a scan: hOCR, masks and exports that the test tables are turned into, written, and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import datasets, golden, images, isolation, page_model
from foliant.plans import fixtures as fx
from foliant.plans.files import folder
from foliant.plans.registry import answers
from foliant.sources import named_files, readers, writers

# --- hOCR: an issue of up to 500 pages, a page for each order, a line for each of its rows; every seventh line has no words

_LINES = """
select l_orderkey, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) - 1 as int) as line_no,
       l_linenumber, l_returnflag || '&' || l_linestatus as a, cast(l_partkey as string) as b from lineitem
"""


def _hocr(spark: SparkSession, sf_dir: str, where: str) -> None:
    word = lambda n, text: F.format_string("<span class='ocrx_word' title='bbox %d %d %d %d; x_wconf 90'>%s</span>", F.lit(60 * n), F.col("line_no") * 30, 10 * F.length(text) + 60 * n, F.col("line_no") * 30 + 20, F.replace(text, F.lit("&"), F.lit("&amp;")))
    words = F.when(F.col("l_linenumber") == 7, "").otherwise(F.concat(word(0, F.col("a")), F.lit(" "), word(1, F.col("b"))))
    line = F.concat(F.lit("<span class='ocr_line'>"), words, F.lit("</span>\n"))
    lines = fx.query(spark, sf_dir, _LINES).select(F.col("l_orderkey").alias("o_orderkey"), F.struct("line_no", line.alias("html")).alias("x"))
    pages = lines.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    body = F.coalesce(F.array_join(F.transform("xs", lambda x: x["html"]), ""), F.lit(""))
    pages = fx.table(spark, sf_dir, "orders").select("o_orderkey").join(pages, "o_orderkey", "left")
    page = F.struct("o_orderkey", F.concat(F.lit("<div class='ocr_page'>\n"), body, F.lit("</div>\n")).alias("html"))
    issues = pages.groupBy(F.expr("o_orderkey div 500").alias("issue")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda p: p["html"]), "").alias("html"))
    name = F.format_string("vol_%d/sim_h_%d_hocr.html", F.col("issue") % 7, F.col("issue"))
    named_files.write(issues.select(name.alias("name"), F.concat(F.lit("<html><body>\n"), "html", F.lit("</body></html>")).alias("content")), where)


@answers(f"""with l as ({_LINES}), w as (select l.*, unnest(range(2)) as n from l where l_linenumber <> 7), p as (select *, case when n = 0 then a else b end as text from w)
select 'sim_h_' || cast(l_orderkey // 500 as string) as issue_id, cast(l_orderkey % 500 as int) as page, line_no, cast(n as int) as word_no, text, cast(60 * n as int) as x0, 30 * line_no as y0,
       cast(60 * n + 10 * length(text) as int) as x1, 30 * line_no + 20 as y1 from p
union all select 'sim_h_' || cast(l_orderkey // 500 as string), cast(l_orderkey % 500 as int), line_no, -1, '', -1, -1, -1, -1 from l where l_linenumber = 7""")
def hocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and empty lines of all issues, written as hOCR files in folders and read back by the hocr source."""
    where = folder(spark, "hocr")
    _hocr(spark, sf_dir, where)
    return readers.hocr(spark, where).na.fill(-1, ["word_no", "x0", "y0", "x1", "y1"]).na.fill("", ["text"])


# --- masks: a page of 16 by 12 for each supplier, painted with a box for each of its lines

_WIDE, _HIGH = 16, 12
_STROKES = """
select l_suppkey, cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as int) as n,
       cast(1 + l_partkey % 4 as int) as label, cast(l_partkey % 20 - 3 as int) as x, cast(l_orderkey % 15 - 2 as int) as y,
       cast(1 + l_linenumber % 4 as int) as w, cast(1 + l_quantity % 3 as int) as h from lineitem
"""
_CELLS = f"""cells as (select x, y from (select unnest(range({_WIDE})) as x), (select unnest(range({_HIGH})) as y)),
strokes as ({_STROKES}), covered as (select l_suppkey, c.x, c.y, n, label from strokes s join cells c on c.x >= s.x and c.x < s.x + w and c.y >= s.y and c.y < s.y + h)"""
_COLOURS = f"(values {', '.join(f'({i}, {r}, {g}, {b})' for i, (r, g, b) in enumerate(tx.LABEL_COLOURS))}) as k(label, red, green, blue)"


def _pages_of_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    stroke = F.struct("n", "label", "x", "y", "w", "h")
    pages = fx.query(spark, sf_dir, _STROKES).groupBy("l_suppkey").agg(F.array_sort(F.collect_list(stroke)).alias("strokes"))
    pages = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey")).join(pages, "l_suppkey", "left")
    return pages.select(F.format_string("page_%d.png", "l_suppkey").alias("file_name"), F.lit(_WIDE).alias("width"), F.lit(_HIGH).alias("height"), "strokes")


def _read_back(spark: SparkSession, where: str) -> DataFrame:
    return images.mask_colours(readers.masks(spark, where)).select("file_name", "red", "green", "blue", "n", "places")


def _counted(pixels: str) -> str:
    return f"""select 'page_' || cast(s_suppkey as string) || '.png' as file_name, red, green, blue, count(*) as n, cast(sum(y * {_WIDE} + x) as bigint) as places from {pixels} group by all"""


@answers(f"""with {_CELLS}, last as (select l_suppkey, x, y, arg_max(label, n) as label from covered group by all),
p as (select s_suppkey, c.x, c.y, coalesce(label, 0) as label from supplier cross join cells c left join last l on l.l_suppkey = s_suppkey and l.x = c.x and l.y = c.y)
{_counted(f"(select s_suppkey, x, y, red, green, blue from p join {_COLOURS} using (label))")}""")
def mask_png_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks painted in order, written as PNG files all at once, read back and counted by colour."""
    where = folder(spark, "masks")
    writers.masks(images.mask_files(_pages_of_strokes(spark, sf_dir)), where)
    return _read_back(spark, where)


@answers(f"""with {_CELLS}, s as (select l_suppkey, x, y, sum(red) % 256 as red, sum(green) % 256 as green, sum(blue) % 256 as blue
 from (select distinct l_suppkey, x, y, label from covered) c join {_COLOURS} using (label) group by all),
p as (select s_suppkey, c.x, c.y, cast(coalesce(red, 0) as int) as red, cast(coalesce(green, 0) as int) as green, cast(coalesce(blue, 0) as int) as blue
      from supplier cross join cells c left join s on s.l_suppkey = s_suppkey and s.x = c.x and s.y = c.y)
{_counted("p")}""")
def composite_png_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of each label mixed by colour, where sums beyond 255 wrap."""
    where = folder(spark, "composites")
    writers.masks(images.composite_files(_pages_of_strokes(spark, sf_dir)), where)
    return _read_back(spark, where)


# --- pages that fail in a worker: label probabilities of 28 by 28 for each customer, every tenth one cut short

_SIDE, _LABELS = 28, 5


def _probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of one label on each page, as a network would give it."""
    import numpy as np

    key = F.col("c_custkey")
    rows = fx.table(spark, sf_dir, "customer").select(key.alias("page_number"), (1 + key % 4).alias("label"), (19 + key % 3).alias("high"))

    def work(p) -> list[tuple]:
        probs = np.zeros((_SIDE, _SIDE, _LABELS), np.float32)
        probs[:, :, 0] = 1
        probs[: p.high, :, 0], probs[: p.high, :, p.label] = 0.25, 0.75
        content = probs.tobytes()
        return [(f"page_{p.page_number}", p.page_number, _SIDE, _SIDE, content[:-3] if p.page_number % 10 == 0 else content)]

    # the table is small, but each of its rows becomes pixels and then regions
    return isolation.each(isolation.dealt(rows, ["page_number"]), work, "page_id string, page_number int, height int, width int, probs binary", ["page_number"]).drop("error")


@answers("""with p as (select c_custkey as k, cast(1 + c_custkey % 4 as int) as label, 19 + c_custkey % 3 as h from customer)
select 'page_' || cast(k as string) as page_id, label, 28 * h * 0.75 / (27 * (h - 1)) as confidence, cast(h - 1 as int) as y1, '' as error from p where k % 10 <> 0
union all select 'page_' || cast(k as string), 0, 0.0, 0, 'ValueError' from p where k % 10 = 0""")
def page_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of good pages and dead letters of the others, from tables that one pass has written."""
    good, dead = isolation.parted(images.regions_or_errors(_probabilities(spark, sf_dir)), folder(spark, "regions"))
    failed = dead.select("page_id", F.lit(0).alias("label"), F.lit(0.0).alias("confidence"), F.lit(0).alias("y1"), F.substring_index("error", ":", 1).alias("error"))
    return good.select("page_id", "label", "confidence", "y1", F.lit("").alias("error")).unionByName(failed)


# --- folds, and names looked for in lines

_TYPED = "select event_id, case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 else 0 end as page_type from events"


@answers(f"""select event_id, page_type, cast((row_number() over (partition by page_type order by event_id) - 1) * 5 // count(*) over (partition by page_type) as int) as fold from ({_TYPED}) t""")
def post_model_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five contiguous folds in each page type."""
    return page_model.folds(fx.query(spark, sf_dir, _TYPED), "event_id")


#: Names of pages, and lines that hold some of them: in a path, glued to more digits, or not at all.
_SOUGHT = "select 'sim_' || source || '_' || cast(doc_id as string) as file_basename from documents"
_HELD = """select case doc_id % 3 when 0 then 'train/sim_' || source || '_' || cast(doc_id as string) || '.jpg,1'
 when 1 then 'x' || cast(doc_id as string) || ',0' else 'sim_' || source || '_' || cast(doc_id * 10 + 7 as string) || ',2' end as file_basename from documents"""


@answers(f"""select n.file_basename from ({_SOUGHT}) n where not exists (select 1 from ({_HELD}) g where contains(g.file_basename, n.file_basename))""")
def ground_missing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that no line of the ground truth contains."""
    return datasets.missing_ground(fx.query(spark, sf_dir, _SOUGHT), fx.query(spark, sf_dir, _HELD), exact=False)


# --- annotation exports: a file for each task of 50 images; an annotation for each label row, every ninth of an unknown image

_NOTES = """select cast(floor(doc_id / 50) as int) as task_no, case when doc_id % 9 = 0 then 900000000 + doc_id else doc_id end as image_id, doc_id as id,
 cast(1 + quality + 2 * toxic as int) as label, cast(doc_id % 50 as double) as x, cast(doc_id % 31 as double) as y, cast(3 + doc_id % 5 as double) as w, cast(2.5 as double) as h from labels"""


@answers(f"""with n as (select *, row_number() over (partition by task_no order by id) - 1 as n from ({_NOTES}) a), i as (select doc_id as image_id from documents)
select 't' || cast(task_no as string) as task, n, n.image_id, label, cast(x * 2 as bigint) as x0, cast((y + round_even(h, 0)) * 2 as bigint) as y1, i.image_id is null as orphan from n left join i using (image_id)""")
def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of exports that are written as files and read back a piece at a time, and whether their image is there."""
    from foliant.plans.files import tasks_of

    where = folder(spark, "exports")
    box = F.struct(F.col("id"), F.struct("id", "image_id", F.col("label").alias("category_id"), F.array("x", "y", "w", "h").alias("bbox")).alias("a"))
    notes = fx.query(spark, sf_dir, _NOTES).groupBy(F.concat(F.lit("t"), F.col("task_no").cast("string")).alias("task")).agg(F.array_sort(F.collect_list(box)).alias("notes"))
    tasks = tasks_of(spark, sf_dir).join(notes, "task", "left")
    doc = F.struct(F.struct(F.lit("made up").alias("description")).alias("info"), "images", F.coalesce(F.transform("notes", lambda x: x["a"]), F.array()).alias("annotations"), "categories")
    named_files.write(tasks.select(F.concat("task", F.lit(".json")).alias("name"), F.to_json(doc).alias("content")), where)
    read = readers.coco(spark, where)
    notes = golden.annotations_of(read)
    images_ = read.select("task", F.explode("images.id").alias("image_id"))
    lost = golden.orphans(notes, images_).select("task", F.col("n").alias("lost"))
    rows = notes.alias("a").join(lost.alias("b"), (F.col("a.task") == F.col("b.task")) & (F.col("a.n") == F.col("b.lost")), "left")
    return rows.select("a.task", F.col("a.n").cast("long").alias("n"), "a.image_id", "a.label", "a.box.x0", "a.box.y1", F.col("lost").isNotNull().alias("orphan"))

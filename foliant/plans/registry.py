"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import datasets, golden, issues, ocr, page_model, regions, rules, scoring
from foliant.plans import fixtures as fx
from foliant.sources import writers

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

ISSUE = ["journal_id", "issue_id"]
PAGE = ["page_key"]
#: The box whose text and words are asked for.
BOX = {"x0": 60, "x1": 500, "y0": 30, "y1": 200}


def answers(sql: str | None = None):
    """Register a query under its function's name, with the SQL for it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _excerpts(spark, sf_dir):
    return fx.query(spark, sf_dir, fx.EXCERPTS)


def _sql_re(pattern: str) -> str:
    return f"$re${pattern}$re$"


# --- issues

_SCAN = f"""
e as ({fx.EXCERPTS}),
a as (select *, sum(case when page_type = 1 then 1 else 0 end) over (partition by issue_id order by page_number) as g from e),
b as (select *, max(case when page_type = 2 then 1 else 0 end) over (partition by issue_id, g order by page_number) as seen from a),
c as (select *, max(case when page_type = 0 and seen = 1 then 1 else 0 end) over (partition by issue_id, g order by page_number) as closed from b),
k as (select * from c where g > 0 and (page_type = 1 or (page_type = 2 and closed = 0))),
art as (select journal_id, issue_id, g, max(case when page_type = 1 then page_number end) as page, max(case when page_type = 1 then page_id end) as page_id,
               max(case when page_type = 1 then title end) as title,
               replace(replace(max(case when page_type = 1 then authors end), '&', ' '), chr(10), ', ') as authors,
               count(case when page_type = 2 then 1 end) as n_refs,
               coalesce(string_agg(case when page_type = 2 then refs end, chr(10) order by page_number), '') as refs from k group by all),
t as (select *, page_number - row_number() over (partition by issue_id order by page_number) as isl,
             min(page_number) over (partition by issue_id) as first from e where page_type = 3),
run as (select * from t where isl = first - 1),
toc as (select issue_id, string_agg(toc, chr(10) order by page_number) as toc_ocr from run group by issue_id)
"""


@answers(f"with {_SCAN} select journal_id, issue_id, page, page_id, title, authors, cast(n_refs as int) as n_refs, refs from art")
def issue_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.articles(_excerpts(spark, sf_dir))


@answers(f"with {_SCAN} select issue_id, page_number, page_id, toc from run")
def toc_first_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.contents_run(_excerpts(spark, sf_dir)).select("issue_id", "page_number", "page_id", "toc")


@answers(f"select issue_id, count(distinct page_number) as page_count, max(page_number) as max_page, max(page_number) + 1 = count(distinct page_number) and min(page_number) >= 0 as contiguous from ({fx.GOLDEN}) g group by issue_id")
def issue_contiguity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.contiguity(fx.query(spark, sf_dir, fx.GOLDEN), ["issue_id"])


@answers(f"""with {_SCAN}, per as (select issue_id, count(*) as n_articles, count(case when n_refs > 0 then 1 end) as n_articles_with_refs,
       string_agg(title || '|' || authors || '|' || cast(page as string) || '|' || page_id || '|' || refs, chr(10) order by page) as written from art group by issue_id)
select i.issue_id, coalesce(n_articles, 0) as n_articles, coalesce(n_articles_with_refs, 0) as n_articles_with_refs, coalesce(written, '') as written, coalesce(toc_ocr, '') as toc_ocr
from (select distinct issue_id from e) i left join per using (issue_id) left join toc using (issue_id)""")
def issue_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the result document holds, taken back from its JSON."""
    rows = issues.results(_excerpts(spark, sf_dir))
    kind = rows.schema["articles"].dataType.simpleString()
    doc = F.from_json("json", f"articles {kind}, toc_ocr string, issue_id string, journal_id string").alias("d")
    back = issues.result_json(rows).select(doc)
    line = F.transform("d.articles", lambda a: F.concat_ws("|", a["title"], a["authors"], a["page"].cast("string"), a["page_id"], a["refs"]))
    counts = rows.select("issue_id", "n_articles", "n_articles_with_refs")
    return back.select(F.col("d.issue_id").alias("issue_id"), F.array_join(line, "\n").alias("written"), F.col("d.toc_ocr").alias("toc_ocr")).join(counts, "issue_id")


@answers(f"with {_SCAN} select issue_id, '''' || title || ''' BY ' || authors || '  PAGE ' || cast(page as string) as line from art")
def issue_contents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.contents_lines(issues.results(_excerpts(spark, sf_dir))).select("issue_id", "line")


@answers("""select 'sim_' || source as issue_id, cast(doc_id % 40 as int) as page_number, max_by(n_chars, doc_id) as n_chars, max(doc_id) as doc_id
from documents group by all""")
def keep_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fx.query(spark, sf_dir, "select 'sim_' || source as issue_id, cast(doc_id % 40 as int) as page_number, n_chars, doc_id, doc_id as seq from documents")
    return issues.latest(docs, "seq", ["issue_id"])


@answers(f"""select page_id, case when page_type = 0 then null
 when page_type = 1 then page_id || ': ARTICLE page ' || cast(page_number as string) || ': ' || chr(10) || '    "' || title || '" by "' || authors || '"'
 when page_type = 2 then page_id || ': REFS page ' || cast(page_number as string) || ': ' || chr(10) || '    ' || replace(refs, chr(10), '\\n')
 else page_id || ': TOC page ' || cast(page_number as string) || ': ' || chr(10) || '    ' || replace(toc, chr(10), '\\n') end as pretty from ({fx.EXCERPTS}) e""")
def pretty_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _excerpts(spark, sf_dir).withColumn("explanation", F.lit("")).select("page_id", tx.pretty().alias("pretty"))


# --- text and ids

_TOKENS = f"regexp_extract_all(text, {_sql_re(tx.TOKEN)})"


@answers(f"select doc_id, cast(len({_TOKENS}) as int) as n_tokens, array_to_string({_TOKENS}, '|') as tokens from documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tx.tokens(F.col("text"))
    return fx.table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_tokens"), F.array_join(found, "|").alias("tokens"))


@answers(f"select token, count(*) as n, count(distinct doc_id) as n_docs from (select doc_id, unnest({_TOKENS}) as token from documents) group by token")
def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    # occurrences are summed by token and document first, so that frequent tokens shrink before they move
    each = fx.table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.tokens(F.col("text"))).alias("token"))
    by_doc = each.groupBy("token", "doc_id").agg(F.count("*").alias("n"))
    return by_doc.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"))


@answers(f"""select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, {_sql_re(tx.AFTER_COMMA)}, ', ', 'g'), {_sql_re(tx.NO_AUTHOR_CHAR)}, '', 'g'), ' +', ' ', 'g'), ' ') as authors from documents""")
def clean_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", tx.clean_authors(F.col("text")).alias("authors"))


@answers(f"select doc_id, trim(regexp_replace(replace(text, '\\n', ' '), {_sql_re(f'[{tx.SPACE}]+')}, ' ', 'g'), ' ') as line from documents")
def one_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", tx.one_line(F.col("text")).alias("line"))


@answers(f"select doc_id, rtrim(regexp_replace(text, {_sql_re(f'[{tx.SPACE}]+')}, ' ', 'g'), ' ') as title from documents")
def title_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", tx.title_line(F.col("text")).alias("title"))


_IDS = f"""select page_id from ({fx.EXCERPTS}) e union all select 'other_' || page_id from ({fx.EXCERPTS}) f
union all select page_id || 'x' from ({fx.EXCERPTS}) g"""


@answers(f"""select page_id, case when ok then regexp_extract(page_id, '^(sim_[^_]+)_', 1) end as journal_id, case when ok then regexp_extract(page_id, '^(.*)_[^_]*$', 1) end as issue_id,
 case when ok then n else -1 end as page_number from (select page_id, n, n is not null and starts_with(page_id, 'sim_') as ok
   from (select page_id, try_cast(regexp_extract(page_id, '_([^_]*)$', 1) as int) as n from ({_IDS})))""")
def parse_page_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.query(spark, sf_dir, _IDS).select("page_id", tx.page_id_parts(F.col("page_id")).alias("p")).select("page_id", "p.*").na.fill(-1, ["page_number"])


_PATHS = "select doc_id, '/data/' || source || '/sim_' || source || '_' || cast(doc_id as string) || case doc_id % 4 when 0 then '_hocr.html' when 1 then '_chocr.html.gz' when 2 then '_hocr.html.gz' else '_djvu.xml' end as path from documents"


@answers(f"select doc_id, nullif(regexp_extract(path, '(?:^|/)([^/]+?)[^/]c?hocr\\.html(?:\\.gz)?(?:/|$)', 1), '') as issue_id, regexp_extract(path, '([^/.]*)[^/]*$', 1) as page_id from ({_PATHS})")
def ocr_issue_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.query(spark, sf_dir, _PATHS).select("doc_id", tx.ocr_issue_id(F.col("path")).alias("issue_id"), tx.image_page_id(F.col("path")).alias("page_id"))


# --- OCR

_BOX_SQL = " and ".join([f"x0 >= {BOX['x0']}", f"x1 <= {BOX['x1']}", f"y0 >= {BOX['y0']}", f"y1 <= {BOX['y1']}"])
_LINE_TEXT = f"select page_key, line_no, coalesce(string_agg(case when {_BOX_SQL} then text || ' ' end, '' order by word_no), '') as lt from ({fx.WORDS}) group by all"


def _box() -> dict:
    return {k: F.lit(v) for k, v in BOX.items()}


@answers(f"""select page_key, regexp_replace(string_agg(lt, chr(10) order by line_no), {_sql_re(f'^[{tx.SPACE}]+|[{tx.SPACE}]+$')}, '', 'g') as text from ({_LINE_TEXT}) group by page_key""")
def bbox_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.texts_in_box(fx.words(spark, sf_dir), PAGE, _box())


@answers(f"select page_key, cast(count(case when {_BOX_SQL} then 1 end) as int) as n_words from ({fx.WORDS}) group by page_key")
def bbox_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.words_in_box(fx.words(spark, sf_dir), PAGE, _box())


# --- regions and rules

_REGION_COLUMNS = ["confidence", "normalized_x", "normalized_y", "page_width_fraction", "page_height_fraction", "x0", "y0", "x1", "y1"]


def _found(spark, sf_dir):
    return fx.query(spark, sf_dir, fx.REGIONS.replace("*, cast(row_number()", "t.*, cast(row_number()")).drop("ith")


def _regions(spark, sf_dir):
    raw = _found(spark, sf_dir)
    order = [F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    return regions.numbered(raw, PAGE, order).select("page_key", "page_number", "model_type", "label", "ith", *_REGION_COLUMNS)


def _by_page(spark, sf_dir):
    r = F.struct("label", "ith", *_REGION_COLUMNS)
    return _regions(spark, sf_dir).groupBy("page_key", "page_number", "model_type").agg(F.array_sort(F.collect_list(r)).alias("regions"))


@answers(f"select page_key, label, ith, confidence, normalized_x, normalized_y, page_width_fraction from ({fx.TOP_REGIONS})")
def region_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).select("page_key", "label", "ith", "confidence", "normalized_x", "normalized_y", "page_width_fraction")


_BEST = f"""r as ({fx.TOP_REGIONS}), ranked as (select *, row_number() over (partition by page_key order by confidence desc, label, ith) as k from r where confidence > 0),
pages as (select distinct page_key, page_number, model_type from r),
best as (select p.page_key, p.page_number, p.model_type, coalesce(b.label, 0) as best_label, coalesce(b.ith, 0) as best_ith, coalesce(b.confidence, 0) as best_confidence,
         coalesce(b.page_width_fraction, 0) as width from pages p left join ranked b on b.page_key = p.page_key and b.k = 1)"""


@answers(f"with {_BEST} select page_key, best_label, best_ith, best_confidence from best")
def best_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_page(spark, sf_dir).select("page_key", regions.best_label(F.col("regions")).alias("b"))
    return rows.select("page_key", F.col("b.label").alias("best_label"), F.col("b.ith").alias("best_ith"), F.col("b.confidence").alias("best_confidence"))


def _judged(spark, sf_dir):
    rows = _by_page(spark, sf_dir).withColumn("b", regions.best_label(F.col("regions")))
    width = F.get(F.filter("regions", lambda r: (r["label"] == F.col("b.label")) & (r["ith"] == F.col("b.ith"))), F.lit(0))["page_width_fraction"]
    return rows.withColumn("width", F.coalesce(width, F.lit(0.0)))


@answers(f"""with {_BEST}, o as (select *, case when model_type = 1 and best_label = 4 and width > 0.6 and page_number < 10 and best_confidence > 0.48 then 3 else model_type end as t from best)
select page_key, model_type, cast(case when t = 3 and page_number > 20 then 0 else t end as int) as page_type from o""")
def page_type_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = rules.overridden(F.col("model_type"), F.col("b"), F.col("width"), F.col("page_number"))
    return _judged(spark, sf_dir).select("page_key", "model_type", kind.alias("page_type"))


@answers(f"""with {_BEST} select page_key, best_confidence > 0.3 and case model_type when 0 then best_confidence > 0.45 when 1 then best_label not in (1, 2)
 when 2 then best_label <> 3 else best_label <> 4 end as disagrees from best""")
def disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("page_key", rules.disagreement(F.col("model_type"), F.col("b")).alias("disagrees"))


@answers(f"""with r as ({fx.TOP_REGIONS}), fit as (select *, row_number() over (partition by page_key order by normalized_x, ith) as k
  from r where label = 3 and page_width_fraction >= 0.35 and confidence >= 0.4),
two as (select page_key, max(case when k = 1 then ith end) as i1, max(case when k = 1 then confidence end) as c1, max(case when k = 2 then ith end) as i2,
        max(case when k = 2 then confidence end) as c2 from fit where k <= 2 group by page_key)
select p.page_key, case when c1 > 0.48 and c2 > 0.48 then cast(i1 as string) || ',' || cast(i2 as string) when c1 > 0.48 then cast(i1 as string) else '' end as chosen
from (select distinct page_key from r) p left join two using (page_key)""")
def refs_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.transform(rules.refs_regions(F.col("regions")), lambda r: r["ith"].cast("string"))
    return _by_page(spark, sf_dir).select("page_key", F.array_join(chosen, ",").alias("chosen"))


def _sorted_sql(label: int, key: str, sign: str) -> str:
    return f"""(select page_key, string_agg(cast(i as string), ',' order by v {sign}, i) as s from (select p.page_key, i, coalesce(r.{key}, 0) as v
 from (select distinct page_key from r0) p cross join (select unnest(range(4)) as i) left join r0 r on r.page_key = p.page_key and r.ith = i and r.label = {label}) group by page_key)"""


@answers(f"""with r0 as ({fx.TOP_REGIONS}) select page_key, a.s as title_by_confidence, b.s as authors_by_y, c.s as refs_by_x
 from {_sorted_sql(1, "confidence", "desc")} a join {_sorted_sql(2, "normalized_y", "asc")} b using (page_key) join {_sorted_sql(3, "normalized_x", "asc")} c using (page_key)""")
def label_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = lambda label, key, up: F.array_join(F.transform(regions.all_instances(F.col("regions"), label, key, up), lambda i: i.cast("string")), ",")
    return _by_page(spark, sf_dir).select("page_key", listed(1, "confidence", False).alias("title_by_confidence"), listed(2, "normalized_y", True).alias("authors_by_y"), listed(3, "normalized_x", True).alias("refs_by_x"))


def _measured(spark, sf_dir):
    r = _regions(spark, sf_dir).withColumns({"region_size": F.col("page_width_fraction") * F.col("page_height_fraction"), "aspect_ratio": F.lit(1.5)})
    return r.groupBy("page_key", "page_number", "model_type").agg(F.array_sort(F.collect_list(F.struct("label", "ith", *regions.FIELDS[1:]))).alias("regions"))


def _vectors(spark, sf_dir):
    return _measured(spark, sf_dir).select("page_key", "page_number", "model_type", regions.vector(F.col("regions")).alias("vec"))


@answers(f"""with r as (select *, page_width_fraction * page_height_fraction as region_size, 1.5::double as aspect_ratio from ({fx.TOP_REGIONS}))
select page_key, (label - 1) * 32 + ith * 8 + k as idx, cast([label, region_size, confidence, aspect_ratio, normalized_x, normalized_y, page_width_fraction, page_height_fraction][k + 1] as double) as value
from r cross join (select cast(unnest(range(8)) as int) as k) where value <> 0""")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector's places that are not zero, as rows."""
    rows = _vectors(spark, sf_dir).select("page_key", F.posexplode("vec").alias("idx", "value"))
    return rows.where("value <> 0")


@answers(f"""select page_key, label, ith, page_width_fraction / nullif(page_height_fraction, 0) as aspect, [2 * x0, 2 * y0, 2 * x1, 2 * y1]::string as box,
 array_to_string([x0, y0, x1, y0, x1, y1, x0, y1], ',') as quad from ({fx.TOP_REGIONS})""")
def region_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    box = F.concat(F.lit("["), F.array_join(F.transform(F.array(x0, y0, x1, y1), lambda v: (2 * v).cast("string")), ", "), F.lit("]"))
    quad = F.array(F.array(x0, y0), F.array(x1, y0), F.array(x1, y1), F.array(x0, y1))
    return _regions(spark, sf_dir).select("page_key", "label", "ith", F.try_divide("page_width_fraction", "page_height_fraction").alias("aspect"), box.alias("box"), tx.quad_text(quad).alias("quad"))


_PIXELS = "select user_id as page_key, cast(event_id % 40 as int) as x, cast(event_id % 30 as int) as y, cast(event_id % 4 as int) as label, cast(cast(event_id % 8 as int) as double) / 8 as prob from events"


@answers(f"""with p as ({_PIXELS}), top as (select page_key, max(label) as top from p group by page_key)
select t.page_key, l.label, count(p.label) as n from top t join (select cast(unnest(range(4)) as int) as label) l on l.label <= t.top left join p on p.page_key = t.page_key and p.label = l.label group by all""")
def label_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.label_pixels(fx.query(spark, sf_dir, _PIXELS), PAGE)


@answers(f"""with p as ({_PIXELS}), r as (select distinct page_key, label, 0 as ith, 5 as a, 5 as b, 20 as c, 25 as d from p)
select r.page_key, r.label, r.ith, coalesce(sum(prob), 0) / ((c - a) * (d - b)) as confidence
from r left join p on p.page_key = r.page_key and p.label = r.label and x between a and c and y between b and d group by r.page_key, r.label, r.ith, a, b, c, d""")
def region_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = fx.query(spark, sf_dir, _PIXELS)
    boxes = pixels.select("page_key", "label").distinct().selectExpr("page_key", "label", "0 as ith", "5 as a", "5 as b", "20 as c", "25 as d")
    return regions.region_confidence(pixels, boxes, PAGE)


def _in_box(words: str, prefix: str) -> str:
    """Text of a region's box, for every page and region that a sub-query names `q` with columns page_key, ith and a box."""
    return f"""(select q.page_key, q.label, q.ith, regexp_replace(string_agg(lt, chr(10) order by line_no), {_sql_re(f'^[{tx.SPACE}]+|[{tx.SPACE}]+$')}, '', 'g') as text from
 (select q.page_key, q.label, q.ith, w.line_no, coalesce(string_agg(case when 2 * q.x0 <= w.x0 and 2 * q.x1 >= w.x1 and 2 * q.y0 <= w.y0 and 2 * q.y1 >= w.y1 then w.text || ' ' end, '' order by word_no), '') as lt
  from {prefix} q join {words} w on w.page_key = q.page_key group by all) q group by all)"""


_CLEAN = lambda c: f"trim(regexp_replace(regexp_replace(regexp_replace({c}, {_sql_re(tx.AFTER_COMMA)}, ', ', 'g'), {_sql_re(tx.NO_AUTHOR_CHAR)}, '', 'g'), ' +', ' ', 'g'), ' ')"


@answers(f"""with {_BEST}, w as ({fx.WORDS}), bx as {_in_box("w", "r")},
x as (select r.*, coalesce(bx.text, '') as text from r left join bx on bx.page_key = r.page_key and bx.label = r.label and bx.ith = r.ith),
o as (select page_key, page_number, case when u = 3 and page_number > 20 then 0 else u end as wanted from
  (select *, case when model_type = 1 and best_label = 4 and width > 0.6 and page_number < 10 and best_confidence > 0.48 then 3 else model_type end as u from best)),
t as (select * from (select *, row_number() over (partition by page_key order by confidence desc, ith) as k from x where label = 1) where k = 1),
c as (select * from (select *, row_number() over (partition by page_key order by confidence desc, ith) as k from x where label = 4) where k = 1),
au as (select x.page_key, list({_CLEAN("x.text")} order by x.normalized_y, x.ith) as a from x join t on t.page_key = x.page_key
  where x.label = 2 and x.confidence >= 0.4 and x.normalized_y >= t.normalized_y group by x.page_key),
rf as (select page_key, max(case when k = 1 then confidence end) as c1, max(case when k = 1 then text end) as t1, max(case when k = 2 then confidence end) as c2, max(case when k = 2 then text end) as t2
  from (select *, row_number() over (partition by page_key order by normalized_x, ith) as k from x where label = 3 and page_width_fraction >= 0.35 and confidence >= 0.4) where k <= 2 group by page_key),
f as (select o.page_key, o.wanted, o.wanted = 1 and coalesce(t.confidence, 0) >= 0.5 and t.normalized_y <= 0.5 as art,
  case when o.wanted = 2 then case when c1 > 0.48 and c2 > 0.48 then t1 || chr(10) || t2 when c1 > 0.48 then t1 else '' end else '' end as refs,
  o.wanted > 2 and coalesce(c.page_width_fraction, 0) > 0.6 and coalesce(c.confidence, 0) > 0.5 as con, t.text as tt, c.text as ct, au.a
  from o left join t on t.page_key = o.page_key left join c on c.page_key = o.page_key left join rf on rf.page_key = o.page_key left join au on au.page_key = o.page_key)
select page_key, cast(case when art then 1 when length(refs) > 0 then 2 when con then wanted else 0 end as int) as page_type,
 case when art then trim(regexp_replace(replace(tt, '\\n', ' '), {_sql_re(f'[{tx.SPACE}]+')}, ' ', 'g'), ' ') else '' end as title,
 case when art then coalesce(list_reduce(list_prepend('', a), lambda s, v: case when length(s) > 0 then s || '\\n' || v else v end), '') else '' end as authors,
 refs, case when con then ct else '' end as toc from f""")
def page_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from regions, words and predicted types to excerpts."""
    r = _regions(spark, sf_dir)
    pages = r.select("page_key", "page_number", "model_type").distinct()
    # boxes are twice the regions' size; the bounds of all of them are one small scan
    bounds = _found(spark, sf_dir).agg(*[(2 * f(c)).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
    lines = ocr.nested_lines(ocr.near(fx.words(spark, sf_dir), bounds), PAGE)
    return rules.excerpts(pages, r.drop("page_number", "model_type"), lines, PAGE).select("page_key", "page_type", "title", "authors", "refs", "toc")


# --- scores


def _ratio(a: str, b: str) -> str:
    """Indel similarity in DuckDB's SQL: common subsequence by rows of a table, for short texts."""
    rows = f"""list_reduce(list_prepend([0 for z in range(length({b}))], list_transform(string_split({a}, ''), lambda ch: [ord(ch)])),
 lambda prev, ca: list_transform(range(1, length({b}) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(prev[k],
  case when ord(substr({b}, k, 1)) = ca[1] then (case when k > 1 then prev[k - 1] else 0 end) + 1 else 0 end)))))[-1]"""
    return f"(case when {a} = {b} then 1.0 when {a} = '' or {b} = '' then 0.0 else 2.0 * {rows} / (length({a}) + length({b})) end)"


_PAIRS = f"""pairs as (select coalesce(g.issue_id, c.issue_id) as issue_id, coalesce(g.page_number, c.page_number) as page_number, g.page_type as gt, c.page_type as ct,
 g.title as g1, c.title as c1, g.authors as g2, c.authors as c2, g.refs as g3, c.refs as c3, g.toc as g4, c.toc as c4
 from ({fx.GOLDEN}) g full join ({fx.CHECK}) c on g.issue_id = c.issue_id and g.page_number = c.page_number),
scored as (select *, cast(case when gt is null or ct is null or gt <> ct then 0 when gt = 0 then 1 when gt = 1 then {_ratio("g1", "c1")} * {_ratio("g2", "c2")}
 when gt = 2 then {_ratio("g3", "c3")} else {_ratio("g4", "c4")} end as double) as score from pairs)"""


@answers(f"with {_PAIRS} select issue_id, page_number, round(score, 9) as score, gt is not null and ct is not null as matched from scored")
def excerpt_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.page_scores(fx.query(spark, sf_dir, fx.GOLDEN), fx.query(spark, sf_dir, fx.CHECK), ["issue_id"])
    return rows.select("issue_id", "page_number", F.round("score", 9).alias("score"), "matched")


@answers(f"""with {_PAIRS}, s as (select issue_id, avg(score) as score, count(gt) as n_pages, count(ct) as n_other, count(case when gt is null or ct is null then 1 end) as n_missing,
 count(case when gt = 1 then 1 end) as n_article, count(case when gt = 2 then 1 end) as n_refs, count(case when gt = 3 then 1 end) as n_toc, count(case when gt = 0 then 1 end) as n_blank,
 max(case when gt is not null then page_number end) + 1 = count(gt) as w1, max(case when ct is not null then page_number end) + 1 = count(ct) as w2 from scored group by issue_id)
select issue_id, round(score, 9) as score, n_pages, n_missing, n_article, n_refs, n_toc, n_blank,
 case when n_pages = n_other and coalesce(w1, false) = coalesce(w2, false) and n_missing = 0
 then cast(n_pages as string) || ' pages;  articles=' || cast(n_article as string) || ' refs=' || cast(n_refs as string) || ' toc=' || cast(n_toc as string) || ' blank=' || cast(n_blank as string)
 else case when n_pages <> n_other then ' differing page count; ' else '' end || case when coalesce(w1, false) <> coalesce(w2, false) then ' only one file non-contiguous; ' else '' end
 || case when n_missing > 0 then ' ' || cast(n_missing as string) || ' missing counterpart pages' else '' end end as explanation from s""")
def issue_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.issue_scores(fx.query(spark, sf_dir, fx.GOLDEN), fx.query(spark, sf_dir, fx.CHECK), ["issue_id"])
    return rows.withColumn("score", F.round("score", 9))


# --- golden data and data sets


def _annotations(spark, sf_dir):
    rows = fx.query(spark, sf_dir, fx.ANNOTATIONS)
    v = F.col("value")
    return rows.select("image_id", "issue_no", "page_number", "n", "label", tx.full_box(v, v / 2, v / 3, F.lit(10.5)).alias("box"), F.concat(F.lit("t"), (F.col("n") % 97).cast("string")).alias("text"))


_ANN = f"""a as (select *, 't' || cast(n % 97 as string) as text from ({fx.ANNOTATIONS})),
pt as (select issue_no, page_number, count(*) as n_annotations, max_by(case when label <= 2 then 1 when label = 3 then 2 else 3 end, n) as page_type from a group by all)"""


@answers(f"""with {_ANN} select issue_no, page_number, n_annotations, page_type, coalesce(max_by(text, n) filter (label = 1), '') as title, coalesce(string_agg(text, ', ' order by n) filter (label = 2), '') as authors,
 coalesce(string_agg(text, '' order by n) filter (label = 3), '') as refs, coalesce(max_by(text, n) filter (label = 4), '') as toc from a join pt using (issue_no, page_number) group by all""")
def golden_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _annotations(spark, sf_dir)
    page = ["issue_no", "page_number"]
    return golden.page_types(a, page, "n").join(golden.page_texts(a, page, "n"), page)


@answers(f"""select n, 2 * cast(round_even(value, 0) as bigint) as x0, 2 * cast(round_even(value / 2, 0) as bigint) as y0,
 2 * (cast(round_even(value, 0) as bigint) + cast(round_even(value / 3, 0) as bigint)) as x1, 2 * (cast(round_even(value / 2, 0) as bigint) + 10) as y1 from ({fx.ANNOTATIONS})""")
def annotation_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotations(spark, sf_dir).select("n", "box.*")


_STATS = f"""with {_ANN}, s as (select 'issue_' || cast(issue_no as string) as issue_id, count(distinct page_number) as image_annotated_count, count(*) as annotation_count,
 count(case when label = 1 then 1 end) as title_article, count(case when label = 2 then 1 end) as authors_article, count(case when label = 3 then 1 end) as refs_article, count(case when label = 4 then 1 end) as toc from a group by all),
st as (select s.issue_id, cast(60 as bigint) as image_count, image_annotated_count, annotation_count, title_article, authors_article, refs_article, toc from s)"""


def _stats(spark, sf_dir):
    a = _annotations(spark, sf_dir).withColumn("issue_id", F.concat(F.lit("issue_"), F.col("issue_no").cast("string")))
    images = a.select("issue_id").distinct().select("issue_id", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("page_number"))
    return golden.stats(images, a, "issue_id", ["page_number"])


@answers(f"{_STATS} select * from st")
def label_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(spark, sf_dir)


@answers(f"""{_STATS}, sp as (select * from (values ('issue_0', 'training'), ('issue_1', 'eval'), ('issue_1', 'training'), ('issue_2', 'withheld')) v(issue_id, split)),
j as (select split, st.* from st join sp using (issue_id)), u as (select * from j union all select 'combined', * exclude (split) from j where split in ('training', 'eval'))
select split, string_agg(issue_id, ' ' order by issue_id) as task_names, cast(sum(image_count) as bigint) as image_count, cast(sum(image_annotated_count) as bigint) as image_annotated_count, cast(sum(annotation_count) as bigint) as annotation_count,
 cast(sum(title_article) as bigint) as title_article, cast(sum(authors_article) as bigint) as authors_article, cast(sum(refs_article) as bigint) as refs_article, cast(sum(toc) as bigint) as toc from u group by split""")
def split_union_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = spark.sql("select * from values ('issue_0', 'training'), ('issue_1', 'eval'), ('issue_1', 'training'), ('issue_2', 'withheld') as v(issue_id, split)")
    return datasets.split_stats(_stats(spark, sf_dir), splits)


@answers(f"select file_basename from ({fx.NAMES}) n where file_basename not in (select file_basename from ({fx.GROUND}) g)")
def ground_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.missing_ground(fx.query(spark, sf_dir, fx.NAMES), fx.query(spark, sf_dir, fx.GROUND))


@answers(f"select n.file_basename, coalesce(g.page_type, 0) as page_type from ({fx.NAMES}) n left join ({fx.GROUND}) g using (file_basename)")
def ground_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.with_ground(fx.query(spark, sf_dir, fx.NAMES), fx.query(spark, sf_dir, fx.GROUND))


@answers(f"select date, seq, identifier from ({fx.CATALOG}) c where date >= timestamp '1997-01-01' and date < timestamp '1998-01-01'")
def catalog_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.in_range(fx.query(spark, sf_dir, fx.CATALOG), "1997-01-01", "1998-01-01")


@answers(f"select date, min(seq) as first_seen, max_by(identifier, seq) as identifier from ({fx.CATALOG}) c group by date")
def catalog_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.by_date(fx.query(spark, sf_dir, fx.CATALOG))


@answers(f"""with {_SCAN}, img as (select page_id, '/debug/' || page_id || '__boxes.jpg' as path from e where title < 'F')
select art.issue_id as issue, case when length(art.title) > 150 then substr(art.title, 1, 150) || '...' else art.title end as title, art.authors, art.page, '{tx.BASE_URL}/' || art.issue_id || '/page/n' || cast(art.page as string) || '/mode/1up?admin=1' as url, coalesce(img.path, 'NotFound') as image_path
from art left join img using (page_id)""")
def debug_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _excerpts(spark, sf_dir)
    images = pages.where("title < 'F'").select("page_id", F.concat(F.lit("/debug/"), "page_id", F.lit("__boxes.jpg")).alias("path"))
    found = datasets.with_images(issues.articles(pages), images)
    rows = writers.debug_rows(found.withColumn("page_no", F.col("page")))
    return rows.join(found.select(F.col("issue_id").alias("issue"), "page", "image_path"), ["issue", "page"])


@answers(f"with {_BEST} select avg(cast(case when best_label <= 2 then 1 else best_label - 1 end = model_type as int)) as accuracy from best")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("b.label") <= 2, 1).otherwise(F.col("b.label") - 1)
    return scoring.accuracy(_judged(spark, sf_dir).withColumn("guess", kind), "guess", "model_type")


# --- the page model


def _training(spark, sf_dir):
    """Vectors with the type that their strongest label stands for, so that there is something to learn."""
    kind = F.coalesce(tx.page_type_of_label(regions.best_label(F.col("regions"))["label"]), F.lit(0))
    return _measured(spark, sf_dir).select("page_key", "page_number", regions.vector(F.col("regions")).alias("vec"), kind.alias("page_type"))


@answers()
def post_model_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = page_model.weighted(_training(spark, sf_dir))
    return scoring.accuracy(page_model.predict(page_model.train(rows), rows), "model_type", "page_type", "weight")


@answers()
def post_model_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_model.cross_validation(_training(spark, sf_dir), "page_key")


# --- streaming


def _finished(spark: SparkSession, sf_dir: str, start, each=None) -> str:
    """Messages as a stream of files: pages, then finish messages, then late pages, then a last look after the latency.

    start(stream, where) starts the query of a round; each(query) is called when it has ended. Gives the folder of all.
    """
    from foliant.streaming.finisher import MESSAGE

    shared = spark.conf.get("spark.checkpoint.dir", "") or "file:///tmp/foliant-checkpoints"
    where = f"{shared.rstrip('/')}/finisher-{uuid.uuid4().hex}"
    issue = F.concat(F.lit("sim_u_"), F.col("user_id").cast("string"))
    empty = [F.lit("").alias(c) for c in ("title", "authors", "refs", "toc")]
    page = F.when(F.col("page") >= 0, F.col("page"))
    rows = fx.query(spark, sf_dir, fx.MESSAGES).select(
        F.lit("sim_u").alias("journal_id"), issue.alias("issue_id"), "state", "page_count", "seq", F.concat(issue, F.lit("_"), page.cast("string")).alias("page_id"),
        page.alias("page_number"), F.lit(0).alias("page_type"), *empty, F.floor(F.col("seq") / 100000000).cast("int").alias("part"),
    )

    def run() -> None:
        idle = "spark.sql.streaming.noDataMicroBatches.enabled"  # a timeout asks for batches without end, also when there is nothing to read
        before = spark.conf.get(idle)
        spark.conf.set(idle, "false")
        query = start(spark.readStream.schema(MESSAGE).json(f"{where}/in"), where)
        try:
            query.awaitTermination()  # it ends when all there is has been read, however much that is, and a failure is raised here
        finally:
            query.stop()
            spark.conf.set(idle, before)
        if each:
            each(query)

    for part in (0, 1, 2):
        rows.where(F.col("part") == part).drop("part").write.mode("append").json(f"{where}/in")
        run()
    time.sleep(1.5)
    rows.where("part = 1").drop("part").withColumn("state", F.lit("tick")).write.mode("append").json(f"{where}/in")
    run()
    return where


@answers("""with p as (select user_id, count(*) as n from events group by user_id)
select 'sim_u_' || cast(user_id as string) as issue_id, case when user_id % 10 = 0 and user_id % 70 <> 0 then 'timeout' else 'count' end as reason,
 n + case when user_id % 70 = 0 then 1 else 0 end as n_pages from p""")
def finisher_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each issue and why it was closed, over four starts from one checkpoint."""
    from foliant.streaming.finisher import closed_pages

    def start(stream: DataFrame, where: str):
        out = closed_pages(stream, latency=1.0).writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint")
        return out.trigger(availableNow=True).start()

    where = _finished(spark, sf_dir, start)
    return spark.read.parquet(f"{where}/out").groupBy("issue_id", "reason").agg(F.count("*").alias("n_pages"))


@answers("""with p as (select user_id, count(*) as n from events group by user_id)
select count(*) as n_issues, cast(sum(n + case when user_id % 70 = 0 then 1 else 0 end) as bigint) as n_pages,
 cast(sum(case when user_id % 7 = 0 and user_id % 10 <> 0 then 1 else 0 end) as bigint) as n_unused from p""")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues, pages and late messages as a listener counts them while issues are closed and written."""
    from foliant.streaming.finisher import write_results
    from foliant.streaming.progress import Progress

    progress = Progress.of(spark)
    try:
        _finished(spark, sf_dir, lambda stream, where: write_results(stream, f"{where}/out", f"{where}/checkpoint", 1.0, availableNow=True), progress.wait)
    finally:
        spark.streams.removeListener(progress)
    got = progress.totals()
    return spark.createDataFrame([tuple(int(got.get(f"issues.{c}", 0)) for c in ("n_issues", "n_pages", "n_unused"))], "n_issues long, n_pages long, n_unused long")


from foliant.plans import files, scans  # noqa: E402, F401 (they register further queries)

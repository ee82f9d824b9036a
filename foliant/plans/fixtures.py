"""Adapters: page, region, word and message tables made from the test tables, in SQL that Spark and DuckDB read alike.

Every number that is compared with a limit is cast to DOUBLE, since decimal literals differ between engines.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXCERPTS = """
with p as (select doc_id, source, text, n_chars,
             cast(row_number() over (partition by source order by doc_id) - 1 as int) as page_number from documents),
     q as (select *, case when page_number in (1, 2, 4) then 3 when (doc_id * 37 + n_chars) % 6 = 0 then 1
                          when (doc_id * 37 + n_chars) % 6 in (1, 2) then 2 else 0 end as page_type from p)
select 'sim_' || source as journal_id, 'sim_' || source || '_2004_fall_1' as issue_id,
       'sim_' || source || '_2004_fall_1_' || lpad(cast(page_number as string), cast(greatest(4, length(cast(page_number as string))) as int), '0') as page_id,
       page_number, page_type,
       case when page_type = 1 then split_part(text, chr(10), 1) else '' end as title,
       case when page_type = 1 then split_part(text, chr(10), 2) else '' end as authors,
       case when page_type = 2 then text else '' end as refs,
       case when page_type = 3 then text else '' end as toc from q
"""
#: Two extractions of the same pages, a page for each order, with short texts, since SQL compares those letter by letter.
SCORED = """
select 'sim_c' as journal_id, 'sim_c_' || cast(o_custkey as string) as issue_id, 'sim_c_' || cast(o_custkey as string) || '_' || cast(o_orderkey as string) as page_id,
       cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as int) as page_number, o_orderpriority as priority,
       case o_orderstatus when 'F' then 1 when 'O' then 2 when 'P' then 3 else 0 end as page_type,
       case when o_orderstatus = 'F' then o_orderpriority else '' end as title, case when o_orderstatus = 'F' then 'Order ' || cast(o_orderkey as string) else '' end as authors,
       case when o_orderstatus = 'O' then o_orderpriority || ' ' || cast(o_orderkey as string) else '' end as refs,
       case when o_orderstatus = 'P' then o_orderpriority || ' ' || cast(o_custkey as string) else '' end as toc from orders
"""
GOLDEN = f"select * from ({SCORED}) e where priority <> '2-HIGH'"
#: The second one lacks other pages, takes some for blank ones, and misreads some letters.
CHECK = f"""
select journal_id, issue_id, page_id, page_number, case when priority = '1-URGENT' then 0 else page_type end as page_type,
       replace(title, 'E', 'x') as title, replace(authors, '7', '1') as authors, replace(refs, 'I', 'l') as refs, replace(toc, 'O', '0') as toc
from ({SCORED}) e where priority <> '3-MEDIUM'
"""
REGION_ORDER = "l_extendedprice desc, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_shipdate"
REGIONS = f"""
select *, cast(row_number() over (partition by page_key, label order by {REGION_ORDER}) - 1 as int) as ith from
 (select l_orderkey as page_key, cast(l_orderkey % 40 as int) as page_number, cast(l_orderkey % 4 as int) as model_type, cast(1 + l_suppkey % 4 as int) as label,
         l_quantity / 50.0 as confidence, l_tax * 10 as normalized_x, cast(l_partkey % 100 as double) / 100 as normalized_y,
         cast(2 + l_partkey % 9 as double) / 10 as page_width_fraction, l_discount * 5 as page_height_fraction,
         cast(l_partkey % 60 as int) as x0, cast(l_suppkey % 40 as int) as y0, cast(l_partkey % 60 + 200 as int) as x1, cast(l_suppkey % 40 + 60 as int) as y1,
         l_extendedprice, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_shipdate from lineitem) t
"""
TOP_REGIONS = f"select * from ({REGIONS}) r where ith < 4"
CATALOG = "select o_orderdate as date, o_orderkey as seq, 'sim_item_' || cast(o_orderkey as string) as identifier from orders"
GROUND = "select 'page_' || cast(doc_id as string) as file_basename, cast(quality + 2 * toxic as int) as page_type from labels"
NAMES = "select 'page_' || cast(doc_id as string) as file_basename from documents"
ANNOTATIONS = """
select cast(user_id as bigint) as image_id, cast(floor(user_id / 50) as int) as issue_no, cast(user_id % 50 as int) as page_number, event_id as n,
       case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 else 4 end as label, value
from events where event_type <> 'error'
"""
MESSAGES = """
with p as (select user_id, cast(row_number() over (partition by user_id order by event_id) - 1 as int) as page, event_id from events)
select user_id, 'continue' as state, page, -1 as page_count, cast(event_id as bigint) as seq from p
union all select user_id, 'finish', -1, cast(count(*) + (case when user_id % 10 = 0 then 1 else 0 end) as int), 100000000 + user_id from p group by user_id
union all select user_id, 'continue', max(page) + 1000, -1, 200000000 + user_id from p where user_id % 7 = 0 group by user_id
"""
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run SQL that names the test tables."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\bfrom {t}\b", sql)}
    for t in used:
        sql = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", sql)
    return spark.sql(sql, **used) if used else spark.sql(sql)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR words of the documents as pages: a box for each word of each line."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_key"), "text")
    lines = docs.select("page_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    each = lines.select("page_key", "line_no", F.posexplode(F.split("line", " ")).alias("word_no", "text"))
    x0, y0 = F.col("word_no") * 60, F.col("line_no") * 30
    return each.select("page_key", "line_no", "word_no", "text", x0.alias("x0"), y0.alias("y0"), (x0 + F.length("text") * 10).alias("x1"), (y0 + 20).alias("y1"))


#: The same words in DuckDB's SQL.
WORDS = """
select page_key, line_no, word_no, ws[word_no + 1] as text, 60 * word_no as x0, 30 * line_no as y0,
       60 * word_no + 10 * length(ws[word_no + 1]) as x1, 30 * line_no + 20 as y1
from (select page_key, line_no, ws, cast(unnest(range(len(ws))) as int) as word_no
      from (select page_key, line_no, string_split(ls[line_no + 1], ' ') as ws
            from (select doc_id as page_key, string_split(text, chr(10)) as ls, cast(unnest(range(len(string_split(text, chr(10))))) as int) as line_no
                  from documents)))
"""

"""Physical plans that the operators are meant to have."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.operators import datasets, issues, ocr


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    texts = [F.lit("x").alias(c) for c in ("title", "authors", "refs", "toc")]
    number = F.col("id").cast("int")
    spark.range(100).select(F.lit("j").alias("journal_id"), (number % 5).cast("string").alias("issue_id"), F.col("id").cast("string").alias("page_id"), number.alias("page_number"), (number % 4).alias("page_type"), *texts, F.current_timestamp().alias("more")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_articles_move_rows_once(pages):
    p = plan(issues.articles(pages))
    assert p.count("Exchange hashpartitioning") == 1
    assert "more" not in p.split("ReadSchema")[1]


def test_contents_run_filters_before_it_moves_rows(pages):
    p = plan(issues.contents_run(pages))
    assert p.count("Exchange hashpartitioning") == 1
    assert "EqualTo(page_type,3)" in p


def test_ranges_and_columns_reach_the_scan(spark, tmp_path):
    spark.range(9).select(F.current_timestamp().alias("date"), F.col("id").alias("seq"), F.lit("i").alias("identifier"), F.lit("x").alias("other")).write.parquet(str(tmp_path / "c"))
    df = spark.read.parquet(str(tmp_path / "c"))
    p = plan(datasets.in_range(df, "1999-01-01", "2000-01-01").select("identifier"))
    assert "GreaterThanOrEqual(date" in p and "LessThan(date" in p and "seq" not in p.split("ReadSchema")[1]


def test_text_functions_stay_in_the_jvm(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("t"))
    p = plan(df.select(tx.tokens(F.col("t")), tx.clean_authors(F.col("t")), tx.one_line(F.col("t")), tx.page_id_parts(F.col("t"))))
    assert "Python" not in p and "Arrow" not in p and "Exchange" not in p


def test_boxes_join_no_words(spark):
    words = spark.createDataFrame([("p", 0, 0, "a", 0, 0, 1, 1)], "page string, line_no int, word_no int, text string, x0 int, y0 int, x1 int, y1 int")
    box = {k: F.lit(9) for k in ("x0", "y0", "x1", "y1")}
    p = plan(ocr.nested_lines(words, ["page"]).select(ocr.box_text(F.col("lines"), box)))
    assert "NestedLoop" not in p and "Cartesian" not in p

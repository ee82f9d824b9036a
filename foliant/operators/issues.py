"""Roll-up of an issue's pages: contents run, articles with their references, and the result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.functions.text import ARTICLE, BLANK, REFS, TOC, finished_authors, fold

KEYS = ["journal_id", "issue_id"]


def latest(pages: DataFrame, order: str, keys: list[str] = KEYS) -> DataFrame:
    """The last row of each page number by the order column. Minima and maxima combine before rows move."""
    rest = [c for c in pages.columns if c not in (*keys, "page_number", order)]
    return pages.groupBy(*keys, "page_number").agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "page_number", "x.*")


def contiguity(pages: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """page_count, max_page and whether all pages from 0 to the largest are there."""
    return pages.groupBy(*keys).agg(F.count_distinct("page_number").alias("page_count"), F.max("page_number").alias("max_page"), F.min("page_number").alias("m")).select(
        *keys, "page_count", "max_page", ((F.col("max_page") + 1 == F.col("page_count")) & (F.col("m") >= 0)).alias("contiguous")
    )


def contents_run(pages: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Pages of the first run of contents pages in a row; later ones are noise. Islands: page less rank is constant."""
    w = Window.partitionBy(*keys)
    toc = pages.where(F.col("page_type") == TOC)
    rank = F.row_number().over(w.orderBy("page_number"))
    return toc.withColumn("island", F.col("page_number") - rank).withColumn("first", F.min("page_number").over(w)).where(F.col("island") == F.col("first") - 1).drop("island", "first")


def attached(pages: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Article and reference pages that belong to an article, with its number in the issue as article_no.

    Every article page opens one. A page of references belongs to the open article, unless a blank page has come after
    earlier references of it; references before any article belong to none.
    """
    issue = Window.partitionBy(*keys).orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy(*keys, "article_no").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)
    kind = F.col("page_type")
    rows = pages.withColumn("article_no", F.sum(F.when(kind == ARTICLE, 1).otherwise(0)).over(issue))
    rows = rows.withColumn("seen", F.max(F.when(kind == REFS, 1).otherwise(0)).over(own))
    rows = rows.withColumn("closed", F.max(F.when((kind == BLANK) & (F.col("seen") == 1), 1).otherwise(0)).over(own))
    return rows.where((F.col("article_no") > 0) & ((kind == ARTICLE) | (kind == REFS) & (F.col("closed") == 0))).drop("seen", "closed")


def articles(pages: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row for each article: page, page_id, title, authors, n_refs and refs, its references' texts folded."""
    start = F.col("page_type") == ARTICLE
    rows = attached(pages, keys).groupBy(*keys, "article_no").agg(
        *[F.max(F.when(start, F.col(c))).alias(c) for c in ("page_number", "page_id", "title", "authors")],
        F.array_sort(F.collect_list(F.when(~start, F.struct("page_number", "refs")))).alias("r"),
    )
    texts = F.transform("r", lambda x: x["refs"])
    return rows.select(*keys, F.col("page_number").alias("page"), "page_id", "title", finished_authors(F.col("authors")).alias("authors"), F.size("r").alias("n_refs"), fold(texts, "\n").alias("refs"))


def contents_text(pages: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """The contents run's texts folded, for issues that have one."""
    return contents_run(pages, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("page_number", "toc"))).alias("t")).select(
        *keys, fold(F.transform("t", lambda x: x["toc"]), "\n").alias("toc_ocr")
    )


def results(pages: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row for each issue: articles by page as an array, toc_ocr, and counts."""
    each = articles(pages, keys).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("page", "page_id", "title", "authors", "refs", "n_refs"))).alias("a"), F.count("*").alias("n_articles"), F.count_if(F.col("n_refs") > 0).alias("n_articles_with_refs")
    )
    listed = F.transform(F.coalesce("a", F.array().cast(each.schema["a"].dataType)), lambda x: F.struct(x["title"].alias("title"), x["authors"].alias("authors"), x["page"].alias("page"), x["page_id"].alias("page_id"), x["refs"].alias("refs")))
    issues = pages.select(*keys).distinct()
    zero = F.lit(0).cast("long")
    return issues.join(each, keys, "left").join(contents_text(pages, keys), keys, "left").select(
        *keys, listed.alias("articles"), F.coalesce("toc_ocr", F.lit("")).alias("toc_ocr"), F.coalesce("n_articles", zero).alias("n_articles"), F.coalesce("n_articles_with_refs", zero).alias("n_articles_with_refs")
    )


def result_json(rows: DataFrame) -> DataFrame:
    """issue_id and the issue's result as JSON."""
    return rows.select("journal_id", "issue_id", F.to_json(F.struct("articles", "toc_ocr", "issue_id", "journal_id")).alias("json"))


def contents_lines(rows: DataFrame) -> DataFrame:
    """A line for people for each article, in order."""
    return rows.select("journal_id", "issue_id", F.posexplode("articles").alias("n", "a")).select(
        "journal_id", "issue_id", "n", F.concat(F.lit("'"), F.col("a.title"), F.lit("' BY "), F.col("a.authors"), F.lit("  PAGE "), F.col("a.page").cast("string")).alias("line")
    )

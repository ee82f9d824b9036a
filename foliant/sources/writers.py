"""Writers of results. Rows are dealt by issue, so no single task writes everything; a folder holds each issue's file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import LABEL_NAMES, issue_url, page_url, pretty, short_title
from foliant.operators.issues import contents_lines, result_json
from foliant.operators.regions import training_line
from foliant.sources import named_files
from foliant.sources.readers import EXCERPT

PER_ISSUE = ["journal_id", "issue_id"]


def _by_issue(lines: DataFrame, path: str, order: list[str]) -> None:
    ordered = lines.repartition(*PER_ISSUE).sortWithinPartitions(*PER_ISSUE, *order)
    ordered.select(*PER_ISSUE, "value").write.mode("overwrite").partitionBy(*PER_ISSUE).text(path)


def excerpts(pages: DataFrame, path: str) -> None:
    """Each issue's excerpts as JSON lines by page; pages before 0 are left out."""
    rows = pages.where("page_number >= 0")
    missing = {c: F.lit("") for c in EXCERPT.names if c not in pages.columns}
    _by_issue(rows.withColumns(missing).withColumn("value", F.to_json(F.struct(*EXCERPT.names))), path, ["page_number"])


def results(rows: DataFrame, path: str) -> None:
    """Each issue's result document."""
    _by_issue(result_json(rows).withColumnRenamed("json", "value"), path, [])


def contents(rows: DataFrame, path: str) -> None:
    """Each issue's articles as lines for people."""
    _by_issue(contents_lines(rows).withColumnRenamed("line", "value"), path, ["n"])


def pretty_lines(pages: DataFrame, path: str) -> None:
    _by_issue(pages.withColumn("value", pretty()).where("value is not null"), path, ["page_number"])


def training_vectors(rows: DataFrame, path: str) -> None:
    """vec and page_type as training lines, without a header."""
    rows.select(training_line(F.col("vec"), F.col("page_type")).alias("value")).write.mode("overwrite").text(path)


def csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def stats_text(stats: DataFrame, path: str, issue: str = "issue_id") -> None:
    """Each issue's counts as lines like key=value."""
    names = [c for c in stats.columns if c != issue]
    lines = F.array(F.concat(F.lit("task_name="), F.col(issue)), *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in names])
    stats.select(issue, F.array_join(lines, "\n").alias("value")).write.mode("overwrite").partitionBy(issue).text(path)


def classes_text() -> str:
    """The label colours as lines of red, green and blue, the background first."""
    from foliant.functions.text import LABEL_COLOURS

    return "".join(" ".join(map(str, c)) + "\n" for c in LABEL_COLOURS[: len(LABEL_NAMES) + 1])


def debug_rows(articles: DataFrame) -> DataFrame:
    """issue, title, authors, page and url of each article, for a table that people read."""
    return articles.select(
        F.col("issue_id").alias("issue"), short_title(F.col("title")).alias("title"), "authors", "page", page_url(F.col("issue_id"), F.col("page")).alias("url")
    )


def debug_page(articles: DataFrame) -> DataFrame:
    """issue_id and html, a table of its articles with links to pages and images; articles have image_path."""
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    link = lambda to, text: F.concat(F.lit('<a href="'), to, F.lit('">'), text, F.lit("</a>"))
    page = F.col("page").cast("string")
    row = F.concat(
        F.lit("<tr>"), cell(short_title(F.col("title"))), cell(F.col("authors")), cell(link(page_url(F.col("issue_id"), F.col("page")), page)), cell(link(F.col("image_path"), F.lit("bbox"))), F.lit("</tr>")
    )
    head = F.concat(F.lit("<h2>"), link(issue_url(F.col("issue_id")), F.col("issue_id")), F.lit("</h2>\n<table>\n<tr><th>Title</th><th>Authors</th><th>Page</th><th>Bbox</th></tr>\n"))
    rows = articles.groupBy("issue_id").agg(F.array_sort(F.collect_list(F.struct("page", row.alias("row")))).alias("rows"))
    return rows.select("issue_id", F.concat(head, F.array_join(F.transform("rows", lambda r: r["row"]), "\n"), F.lit("\n</table>\n")).alias("html"))


def masks(files: DataFrame, path: str) -> None:
    """Mask files (file_name, content) below a folder, all or none; a mask that could not be made fails the write."""
    made = F.when(F.col("error").isNull(), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("no mask for "), "file_name", F.lit(": "), "error")).cast("binary"))
    named_files.write(files.select("file_name", made.alias("content")) if "error" in files.columns else files, path, "file_name")

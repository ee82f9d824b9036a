"""From a page's regions, words and predicted type to its excerpt: overrides, qualifications and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import ARTICLE, AUTHORS_LABEL, BLANK, REFS, REFS_LABEL, TITLE_LABEL, TOC, TOC_LABEL, clean_authors, fold, one_line, title_line
from foliant.operators.ocr import box_text
from foliant.operators.regions import best_label, instances

#: Columns of a region that the rules read, besides label and ith; rect is on the half-size image.
REGION_FIELDS = ("confidence", "normalized_x", "normalized_y", "page_width_fraction", "x0", "y0", "x1", "y1")


def disagreement(model_type: Column, best: Column) -> Column:
    """Whether the best label speaks against the predicted type."""
    label, conf = best["label"], best["confidence"]
    against = F.when(model_type == BLANK, conf > 0.45).when(model_type == ARTICLE, ~label.isin(TITLE_LABEL, AUTHORS_LABEL))
    return (conf > 0.3) & against.when(model_type == REFS, label != REFS_LABEL).otherwise(label != TOC_LABEL)


def overridden(model_type: Column, best: Column, width: Column, page_number: Column) -> Column:
    """The type after both overrides: an early page led by a wide contents region is one; a late contents page is not."""
    as_toc = (model_type == ARTICLE) & (best["label"] == TOC_LABEL) & (width > 0.6) & (page_number < 10) & (best["confidence"] > 0.48)
    first = F.when(as_toc, F.lit(TOC)).otherwise(model_type)
    return F.when((first == TOC) & (page_number > 20), F.lit(BLANK)).otherwise(first).cast("int")


def _box(region: Column) -> dict[str, Column]:
    return {c: 2 * region[c] for c in ("x0", "y0", "x1", "y1")}


def refs_regions(regions: Column) -> Column:
    """At most two regions of references by x: wide and sure enough, the first surer still, the second only after it."""
    fit = F.slice(F.filter(instances(regions, REFS_LABEL, "normalized_x"), lambda r: (r["page_width_fraction"] >= 0.35) & (r["confidence"] >= 0.4)), 1, 2)
    sure = lambda i: F.coalesce(F.get(fit, F.lit(i))["confidence"] > 0.48, F.lit(False))
    return F.when(~sure(0), F.slice(fit, 1, 0)).when(sure(1), fit).otherwise(F.slice(fit, 1, 1))


def excerpts(pages: DataFrame, regions: DataFrame, ocr: DataFrame, page: list[str]) -> DataFrame:
    """One row for each page: its columns, page_type, title, authors, refs, toc and diagnostics.

    pages: page columns, page_number and model_type. regions: page columns, label, ith and REGION_FIELDS.
    ocr: page columns and lines, as nested_lines() gives. Pages without regions or without words are kept.
    """
    grouped = regions.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("label", "ith", *REGION_FIELDS))).alias("regions"))
    rows = pages.join(grouped, page, "left").join(ocr, page, "left")
    none = F.array().cast(grouped.schema["regions"].dataType)
    rows = rows.withColumn("regions", F.coalesce("regions", none)).withColumn("best", best_label(F.col("regions")))
    width = F.get(F.filter("regions", lambda r: (r["label"] == F.col("best.label")) & (r["ith"] == F.col("best.ith"))), F.lit(0))["page_width_fraction"]
    rows = rows.withColumn("wanted", overridden(F.col("model_type"), F.col("best"), F.coalesce(width, F.lit(0.0)), F.col("page_number")))

    title = F.get(instances(F.col("regions"), TITLE_LABEL, "confidence", False), F.lit(0))
    toc = F.get(instances(F.col("regions"), TOC_LABEL, "confidence", False), F.lit(0))
    rows = rows.withColumns({"t": title, "c": toc, "f": refs_regions(F.col("regions"))})
    sure = F.coalesce(F.col("t.confidence"), F.lit(0.0)) >= 0.5
    article = (F.col("wanted") == ARTICLE) & sure & (F.col("t.normalized_y") <= 0.5)
    own = F.filter(instances(F.col("regions"), AUTHORS_LABEL, "normalized_y"), lambda r: (r["confidence"] >= 0.4) & (r["normalized_y"] >= F.col("t.normalized_y")))
    authors = fold(F.transform(own, lambda r: clean_authors(box_text(F.col("lines"), _box(r)))), "\\n")
    refs_text = F.array_join(F.transform("f", lambda r: box_text(F.col("lines"), _box(r))), "\n")
    with_toc = (F.col("wanted") > REFS) & (F.coalesce(F.col("c.page_width_fraction"), F.lit(0.0)) > 0.6) & (F.coalesce(F.col("c.confidence"), F.lit(0.0)) > 0.5)

    rows = rows.withColumn("refs", F.when(F.col("wanted") == REFS, refs_text).otherwise(""))
    kind = F.when(article, ARTICLE).when(F.length("refs") > 0, REFS).when(with_toc, F.col("wanted")).otherwise(BLANK).cast("int")
    rows = rows.withColumns(
        {
            "page_type": kind,
            "title": F.when(article, title_line(one_line(box_text(F.col("lines"), _box(F.col("t")))))).otherwise(""),
            "authors": F.when(article, authors).otherwise(""),
            "toc": F.when(with_toc, box_text(F.col("lines"), _box(F.col("c")))).otherwise(""),
            "diagnostics": F.filter(
                F.array(
                    F.when(disagreement(F.col("model_type"), F.col("best")), F.lit("disagreement with best label")),
                    F.when(F.col("wanted") != F.col("model_type"), F.lit("type overridden")),
                    F.when((F.col("wanted") == ARTICLE) & ~sure, F.lit("title not sure enough")),
                    F.when((F.col("wanted") == ARTICLE) & sure & (F.col("t.normalized_y") > 0.5), F.lit("title in lower half")),
                    F.when((F.col("wanted") == REFS) & (F.length("refs") == 0), F.lit("no references found")),
                    F.when((F.col("wanted") > REFS) & ~with_toc, F.lit("contents not sure or wide enough")),
                ),
                lambda m: m.isNotNull(),
            ),
        }
    )
    return rows.select(*[c for c in pages.columns], "page_type", "title", "authors", "refs", "toc", "diagnostics")

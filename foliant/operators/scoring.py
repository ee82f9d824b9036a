"""Scores of one extraction of issues against another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.similarity import page_score
from foliant.functions.text import ARTICLE, BLANK, REFS, TOC
from foliant.operators.issues import contiguity

TEXTS = ("page_type", "title", "authors", "refs", "toc")


def page_scores(golden: DataFrame, check: DataFrame, keys: list[str]) -> DataFrame:
    """Score of each page of either side; a page without a counterpart scores 0."""
    side = lambda df, name: df.select(*keys, "page_number", F.struct(*TEXTS).alias(name))
    both = side(golden, "mine").join(side(check, "other"), [*keys, "page_number"], "full")
    met = F.col("mine").isNotNull() & F.col("other").isNotNull()
    return both.withColumn("matched", met).withColumn("score", F.when(met, page_score("mine", "other")).otherwise(0.0))


def issue_scores(golden: DataFrame, check: DataFrame, keys: list[str]) -> DataFrame:
    """Mean score of each issue's pages, counts by type of golden pages, and an explanation; issues of golden alone."""
    kinds = {"n_article": ARTICLE, "n_refs": REFS, "n_toc": TOC, "n_blank": BLANK}
    rows = page_scores(golden, check, keys).groupBy(*keys).agg(
        F.avg("score").alias("score"),
        F.count("mine").alias("n_pages"),
        F.count("other").alias("n_other"),
        F.count_if(~F.col("matched")).alias("n_missing"),
        *[F.count_if(F.col("mine.page_type") == k).alias(n) for n, k in kinds.items()],
    )
    own = contiguity(golden, keys).select(*keys, F.col("contiguous").alias("own_whole"))
    other = contiguity(check, keys).select(*keys, F.col("contiguous").alias("other_whole"))
    rows = rows.join(own, keys, "left").join(other, keys, "left")
    text = lambda c: F.col(c).cast("string")
    # an extraction without pages counts as not contiguous: nothing was put that could be
    differs = F.coalesce("own_whole", F.lit(False)) != F.coalesce("other_whole", F.lit(False))
    faults = F.concat(
        F.when(F.col("n_pages") != F.col("n_other"), " differing page count; ").otherwise(""),
        F.when(differs, " only one file non-contiguous; ").otherwise(""),
        F.when(F.col("n_missing") > 0, F.concat(F.lit(" "), text("n_missing"), F.lit(" missing counterpart pages"))).otherwise(""),
    )
    fine = F.concat(text("n_pages"), F.lit(" pages;  articles="), text("n_article"), F.lit(" refs="), text("n_refs"), F.lit(" toc="), text("n_toc"), F.lit(" blank="), text("n_blank"))
    return rows.withColumn("explanation", F.when(faults == "", fine).otherwise(faults)).drop("own_whole", "other_whole", "n_other")


def accuracy(rows: DataFrame, predicted: str, actual: str, weight: str | None = None) -> DataFrame:
    """Part of the rows that are predicted right; with a weight, each counts so many times."""
    right = (F.col(predicted) == F.col(actual)).cast("double")
    if weight is None:
        return rows.agg(F.avg(right).alias("accuracy"))
    return rows.agg((F.sum(right * F.col(weight)) / F.sum(F.when(right.isNotNull(), F.col(weight)))).alias("accuracy"))

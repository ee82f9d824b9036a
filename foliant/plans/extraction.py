"""The three ways through the engine: extraction of issues, building of golden data, and scoring of one against the other."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from foliant.functions.text import geometry, page_id_parts
from foliant.operators import golden, issues, ocr, page_model, regions, rules, scoring

PAGE = ["issue_id", "page_number"]


def segmenter(load: Callable[[], Callable[[np.ndarray], np.ndarray]], shape: list[int], batch: int = 8) -> Callable[[Column], Column]:
    """A column function that runs a network over images (flat arrays of the given shape) and gives flat label probabilities.

    load() is called once in each worker and returns the network: batches of images in, batches of probabilities out.
    """

    def make():
        net = load()
        return lambda images: np.asarray(net(images)).reshape(len(images), -1).astype(np.float32)

    return predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[shape])


def located(pages: DataFrame) -> DataFrame:
    """pages with journal_id, issue_id and page_number from their page_id; a page whose id tells none of them is left out."""
    return pages.withColumn("p", page_id_parts(F.col("page_id"))).select(*[c for c in pages.columns if c not in ("journal_id", *PAGE)], "p.*").where("page_number is not null")


def quarantined(pages: DataFrame, found: DataFrame) -> DataFrame:
    """page_id and reason of the pages that extraction cannot use whole, for each reason once.

    bad id: it tells no journal, issue and number, and the page is left out. bad place: a region's label or place does not fit
    the vector, and the region is left out. bad box: a region lacks a corner or has no area on its page; its ratios count as 0.
    """
    ids = pages.select("page_id").where(page_id_parts(F.col("page_id"))["page_number"].isNull()).withColumn("reason", F.lit("bad id"))
    _, misplaced = regions.checked(found)
    sized = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (F.col("width") > 0) & (F.col("height") > 0)
    flat = found.where(~F.coalesce(sized, F.lit(False)))
    named = [d.select("page_id", F.lit(r).alias("reason")) for d, r in ((misplaced, "bad place"), (flat, "bad box"))]
    return ids.unionByName(named[0]).unionByName(named[1]).distinct()


def measured(found: DataFrame) -> DataFrame:
    """Regions (corners and the page's width and height) with their features."""
    g = geometry(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1", "width", "height")])
    return found.withColumns(g)


def vectors(pages: DataFrame, found: DataFrame) -> DataFrame:
    """pages (page_id) with vec, the fixed-layout vector of their regions, all zeros for a page without."""
    good, _ = regions.checked(found)
    grouped = regions.by_page(good, ["page_id"], [f for f in regions.FIELDS if f != "label"])
    none = F.array().cast(grouped.schema["regions"].dataType)
    return pages.join(grouped, "page_id", "left").withColumn("vec", regions.vector(F.coalesce("regions", none))).drop("regions")


def extract(pages: DataFrame, found: DataFrame, words: DataFrame, model: DecisionTreeClassificationModel) -> DataFrame:
    """Excerpts of pages: the model's types, the rules, and the texts of the chosen regions.

    pages: page_id. found: page_id, label, ith, confidence, corners and page size. words: issue_id, page and words as the
    hOCR reader gives them.
    """
    measures = measured(found)
    typed = page_model.predict(model, vectors(located(pages), measures)).drop("vec")
    keyed = measures.join(typed.select("page_id", *PAGE), "page_id").select(*PAGE, "label", "ith", *rules.REGION_FIELDS)
    # words of other pages are not nested: both sides are dealt by the page, as the nesting is
    own = words.withColumnRenamed("page", "page_number").join(typed.select(*PAGE), PAGE, "left_semi")
    text = ocr.nested_lines(own, PAGE)
    return rules.excerpts(typed, keyed, text, PAGE).drop("model_type")


def summarise(excerpts: DataFrame) -> DataFrame:
    """Issues' articles, contents and counts from excerpts."""
    return issues.results(excerpts)


def training_rows(pages: DataFrame, found: DataFrame, ground: DataFrame) -> DataFrame:
    """page_id, vec and page_type for the page model; a page that the ground truth lacks counts as blank."""
    from foliant.operators.datasets import with_ground

    return with_ground(vectors(pages, measured(found)), ground, "page_id")


def golden_data(tasks: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Golden excerpts and statistics of annotated issues. tasks: annotation exports whose task is an issue id.

    Tasks with other categories than expected are left out; an annotation of an unknown image fails the query.
    """
    known = golden.same_categories(tasks)
    images, notes = golden.images_of(known), golden.annotations_of(known)
    numbered = known.select("task", F.explode("images.id").alias("image_id")).distinct().withColumn("known", F.lit(True))
    checked = notes.join(numbered, ["task", "image_id"], "left")
    checked = checked.where(F.when(F.col("known"), F.lit(True)).otherwise(F.raise_error(F.lit("an annotation of an unknown image")).cast("boolean"))).drop("known")
    page = ["task", "page_number"]
    placed = checked.join(images.select("task", "image_id", "page_number"), ["task", "image_id"]).select(*page, "n", "label", "box")
    text = ocr.nested_lines(words.select(F.col("issue_id").alias("task"), F.col("page").alias("page_number"), "line_no", "word_no", "text", "x0", "y0", "x1", "y1"), page)
    return golden.excerpts(images, placed, text, page), golden.stats(images, placed, "task", ["page_number"])


def compare(golden_excerpts: DataFrame, check: DataFrame) -> DataFrame:
    """Score and explanation of each issue."""
    return scoring.issue_scores(golden_excerpts, check, ["issue_id"])

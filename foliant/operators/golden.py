"""Golden excerpts and ground truth from annotated regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import (
    ARTICLE, AUTHORS_LABEL, LABEL_NAMES, REFS, REFS_LABEL, TITLE_LABEL, TOC, TOC_LABEL, clean_authors, fold, full_box, image_basename, image_page_number, is_image,
    one_line, page_type_of_label, title_line,
)
from foliant.operators.ocr import box_text


def same_categories(tasks: DataFrame, names: list[str] = LABEL_NAMES) -> DataFrame:
    """Tasks whose categories are the expected names numbered from 1, no more and no fewer. tasks: categories of structs(id, name)."""
    wanted = F.array_sort(F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(n).alias("name")) for i, n in enumerate(names, 1)]))
    have = F.array_sort(F.array_distinct(F.transform("categories", lambda c: F.struct(c["id"].cast("long").alias("id"), c["name"].alias("name")))))
    return tasks.where(have == wanted)


def completed(tasks: DataFrame) -> DataFrame:
    """Tasks whose annotation is finished, by their status."""
    return tasks.where(F.col("status") == "completed")


def images_of(tasks: DataFrame) -> DataFrame:
    """Images with a page number: task, image_id, file_name, page_number; of images of one page the last one counts."""
    rows = tasks.select("task", F.posexplode("images").alias("n", "i")).select("task", "n", F.col("i.id").alias("image_id"), F.col("i.file_name").alias("file_name"))
    rows = rows.withColumn("page_number", image_page_number(F.col("file_name"))).where("page_number is not null")
    last = rows.groupBy("task", "page_number").agg(F.max_by(F.struct("image_id", "file_name"), "n").alias("x"))
    return last.select("task", "x.image_id", "x.file_name", "page_number").where(is_image(F.col("file_name")))


def annotations_of(tasks: DataFrame) -> DataFrame:
    """Annotations in file order: task, n, image_id, label and the box on the full-size image."""
    b = lambda i: F.get(F.col("a.bbox"), F.lit(i))
    return tasks.select("task", F.posexplode("annotations").alias("n", "a")).select(
        "task", "n", F.col("a.image_id").alias("image_id"), F.col("a.category_id").alias("label"), full_box(b(0), b(1), b(2), b(3)).alias("box")
    )


def orphans(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations of an image that is not there."""
    return annotations.join(images.select("task", "image_id").distinct(), ["task", "image_id"], "left_anti")


def page_types(annotations: DataFrame, page: list[str], order: str) -> DataFrame:
    """Each page's number of annotations and its type, that of the last annotation with a known label, else 0."""
    kind = page_type_of_label(F.col("label"))
    last = F.max_by(F.when(kind.isNotNull(), kind), F.when(kind.isNotNull(), F.col(order)))
    return annotations.groupBy(*page).agg(F.count("*").alias("n_annotations"), F.coalesce(last, F.lit(0)).alias("page_type"))


def page_texts(annotations: DataFrame, page: list[str], order: str) -> DataFrame:
    """Each page's texts, folded in order: last title and contents, authors joined by ", ", references put together.

    annotations: page columns, the order, label and text.
    """
    text, label = F.col("text"), F.col("label")
    only = lambda k: F.transform(F.array_sort(F.collect_list(F.when(label == k, F.struct(order, "text")))), lambda x: x["text"])
    last = lambda k: F.coalesce(F.max_by(F.when(label == k, text), F.when(label == k, F.col(order))), F.lit(""))
    return annotations.groupBy(*page).agg(
        last(TITLE_LABEL).alias("title"), fold(only(AUTHORS_LABEL), ", ").alias("authors"), F.array_join(only(REFS_LABEL), "").alias("refs"), last(TOC_LABEL).alias("toc")
    )


def excerpts(images: DataFrame, annotations: DataFrame, ocr: DataFrame, page: list[str], order: str = "n") -> DataFrame:
    """A golden excerpt for each image: texts count only for the page's type; pages without annotations are blank.

    images: page columns and what else to keep. annotations: page columns, the order, label and box. ocr: page columns and lines.
    """
    read = annotations.join(ocr, page, "left").withColumn("text", box_text(F.col("lines"), {c: F.col(f"box.{c}") for c in ("x0", "y0", "x1", "y1")}))
    found = page_types(annotations, page, order).join(page_texts(read, page, order), page)
    rows = images.join(found, page, "left").withColumn("page_type", F.coalesce("page_type", F.lit(0)))
    kind = F.col("page_type")
    pick = lambda k, c: F.coalesce(F.when(kind == k, c), F.lit(""))
    return rows.withColumns(
        {
            "n_annotations": F.coalesce("n_annotations", F.lit(0)),
            "title": pick(ARTICLE, title_line(one_line(F.col("title")))),
            "authors": pick(ARTICLE, clean_authors(F.col("authors"))),
            "refs": pick(REFS, F.col("refs")),
            "toc": pick(TOC, F.col("toc")),
        }
    )


def ground(rows: DataFrame) -> DataFrame:
    """file_basename and page_type of each golden excerpt."""
    return rows.select(image_basename(F.col("file_name")).alias("file_basename"), "page_type")


def stats(images: DataFrame, annotations: DataFrame, issue: str, page: list[str], names: list[str] = LABEL_NAMES) -> DataFrame:
    """For each issue: images, images with annotations, annotations, and annotations of each label."""
    counts = images.groupBy(issue).agg(F.count("*").alias("image_count"))
    each = annotations.groupBy(issue).agg(
        F.count_distinct(*page).alias("image_annotated_count"),
        F.count("*").alias("annotation_count"),
        *[F.count_if(F.col("label") == i).alias(n) for i, n in enumerate(names, 1)],
    )
    return counts.join(each, issue, "left").na.fill(0)


def painted(annotations: DataFrame, page: list[str], order: str) -> DataFrame:
    """What a mask is painted with: boxes and colours in order; later ones cover earlier ones."""
    return annotations.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(order, "label", "box"))).alias("strokes"))

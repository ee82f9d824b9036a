"""Assembly, verification and listing of training data sets."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import LABEL_NAMES
from foliant.operators.ranks import checkpointed

COUNTS = ["image_count", "image_annotated_count", "annotation_count", *LABEL_NAMES]
#: Splits that training of the page model uses together.
COMBINED = ("training", "eval")


def assigned(rows: DataFrame, splits: DataFrame, issue: str = "issue_id") -> DataFrame:
    """rows with the split of their issue; an issue in two lists goes to both, one in none is left out."""
    return rows.join(splits, issue)


def combined(rows: DataFrame, splits: DataFrame, issue: str = "issue_id") -> DataFrame:
    """Rows of the splits that are used together, one after the other, copies included."""
    return assigned(rows, splits.where(F.col("split").isin(*COMBINED)), issue).drop("split")


def split_stats(stats: DataFrame, splits: DataFrame, issue: str = "issue_id") -> DataFrame:
    """Sums of the counts of each split and of both together, with the names of its issues; a missing count is 0."""
    rows = assigned(stats, splits, issue)
    both = rows.where(F.col("split").isin(*COMBINED)).withColumn("split", F.lit("combined"))
    names = F.array_join(F.array_sort(F.collect_list(issue)), " ")
    return rows.unionByName(both).groupBy("split").agg(names.alias("task_names"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS])


#: Letters of the pieces by which names are looked for in lines.
GRAM = 8


def missing_ground(names: DataFrame, ground: DataFrame, exact: bool = True) -> DataFrame:
    """Names that the ground truth lacks. exact=False: that no line of it contains, as a search by text would find."""
    if exact:
        return names.join(ground, names["file_basename"] == ground["file_basename"], "left_anti")
    found = contained(names.select("file_basename"), ground.select("file_basename"))
    return names.join(found, "file_basename", "left_anti")


def _pieces(text: Column, size) -> Column:
    """All different pieces of so many letters; none of a shorter text."""
    last = F.length(text) - size + 1
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))
    return F.when(last > 0, F.array_distinct(every))


def contained(names: DataFrame, lines: DataFrame, gram: int = GRAM) -> DataFrame:
    """The different names that lie in some line. Both have one column of text; nulls lie in nothing and hold nothing.

    Lines are indexed by their pieces of some letters. A name is looked up by the piece that
    the fewest lines hold, and then compared with those lines. Names of fewer letters are pieces themselves, looked up
    whole, the empty one too.
    """
    name, line = names.columns[0], lines.columns[0]
    names = names.where(F.col(f"`{name}`").isNotNull()).select(F.col(f"`{name}`").alias("name")).distinct()
    lines = lines.where(F.col(f"`{line}`").isNotNull()).select(F.col(f"`{line}`").alias("line")).distinct()
    size = F.length("name")
    long = names.where(size >= gram).select("name", F.explode(_pieces(F.col("name"), gram)).alias("piece"))
    held = lines.select("line", F.explode(_pieces(F.col("line"), gram)).alias("piece"))
    # counts are written, so that the join with the pieces of names can split a piece that many names have
    held_by = checkpointed(held.groupBy("piece").agg(F.count("*").alias("n")))
    rarest = long.join(held_by, "piece").groupBy("name").agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    # a name with a piece that no line has may still be looked up by another one; comparing tells
    by_piece = held.join(rarest, "piece").where(F.contains("line", "name")).select("name")
    short = names.where(size < gram)
    lengths = F.array(*[F.lit(k) for k in range(1, gram)])
    pieces = F.flatten(F.transform(lengths, lambda k: F.coalesce(_pieces(F.col("line"), k), F.array().cast("array<string>"))))
    pieces = F.concat(F.array(F.lit("")), pieces)
    whole = short.join(lines.select(F.explode(pieces).alias("name")).distinct(), "name", "left_semi")
    return by_piece.unionByName(whole).distinct().select(F.col("name").alias(name))


def with_ground(rows: DataFrame, ground: DataFrame, name: str = "file_basename", order: str = "seq") -> DataFrame:
    """rows with page_type; 0 where the ground truth has none.

    Of repeated names the last in the given order counts; without such a column, which has no last one, the largest type.
    """
    last = F.max_by("page_type", order) if order in ground.columns else F.max("page_type")
    known = ground.groupBy("file_basename").agg(last.alias("page_type"))
    return rows.join(known, rows[name] == known["file_basename"], "left").select(*[rows[c] for c in rows.columns], F.coalesce("page_type", F.lit(0)).alias("page_type"))


def blank_images(images: DataFrame, annotated: DataFrame) -> DataFrame:
    """Images that need a blank mask: without annotations."""
    return images.join(annotated.select("file_basename").distinct(), "file_basename", "left_anti")


def training_config(base_dir: str) -> str:
    """Configuration of the segmentation network's training over an assembled data set, as JSON."""
    # Fixed values of the training.
    params = {
        "learning_rate": 5e-5, "batch_size": 1, "make_patches": False, "training_margin": 0, "n_epochs": 30, "data_augmentation": True,
        "data_augmentation_max_rotation": 0.02, "data_augmentation_max_scaling": 0.02, "data_augmentation_flip_lr": True, "data_augmentation_flip_ud": False,
        "data_augmentation_color": False, "evaluate_every_epoch": 10,
    }
    config = {"training_params": params, "pretrained_model_name": "resnet50", "prediction_type": "CLASSIFICATION", "train_data": f"{base_dir}/training", "eval_data": f"{base_dir}/eval"}
    return json.dumps(config | {"classes_file": f"{base_dir}/classes.txt", "model_output_dir": f"{base_dir}/output", "gpu": "0"}, indent=2)


def in_range(catalog: DataFrame, begin: str | None, end: str | None, date: str = "date") -> DataFrame:
    """Items from begin on and before end; without both bounds, all items."""
    if begin is None or end is None:
        return catalog
    return catalog.where((F.col(date) >= F.lit(begin).cast("timestamp")) & (F.col(date) < F.lit(end).cast("timestamp")))


def by_date(catalog: DataFrame, order: str = "seq", date: str = "date") -> DataFrame:
    """One identifier for each date, the last one, numbered in the order in which dates were first seen."""
    return catalog.groupBy(date).agg(F.min(order).alias("first_seen"), F.max_by("identifier", order).alias("identifier"))


def with_images(articles: DataFrame, images: DataFrame) -> DataFrame:
    """Articles with the path of their page's debug image, or NotFound."""
    return articles.join(images.select("page_id", F.col("path").alias("image_path")), "page_id", "left").withColumn("image_path", F.coalesce("image_path", F.lit("NotFound")))

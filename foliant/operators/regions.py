"""Regions of pages: their choice and numbering, best label, sorted instances, and the fixed-layout vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Regions of a label that a page keeps, and labels besides the background.
MAX_REGIONS = 4
LABELS = 4
#: Fields of a region, in the order in which they lie in the vector.
FIELDS = ("label", "region_size", "confidence", "aspect_ratio", "normalized_x", "normalized_y", "page_width_fraction", "page_height_fraction")
#: Pixels that a label needs on a page to be looked at.
LEAST_PIXELS = 500


def numbered(regions: DataFrame, page: list[str], order: list[Column], most: int = MAX_REGIONS) -> DataFrame:
    """The first regions of each page and label in the given order, with their place as ith.

    Pages meet whole, so what groups them afterwards moves nothing.
    """
    regions = regions.repartition(*page)
    rank = F.row_number().over(Window.partitionBy(*page, "label").orderBy(*order)) - 1
    return regions.withColumn("ith", rank).where(F.col("ith") < most)


def label_pixels(pixels: DataFrame, page: list[str]) -> DataFrame:
    """Pixels of each label on each page, zero included up to the largest label of the page."""
    counted = pixels.groupBy(*page, "label").agg(F.count("*").alias("n"))
    top = counted.groupBy(*page).agg(F.max("label").alias("top"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by"))
    label = F.explode(F.sequence(F.lit(0), F.col("top"))).alias("label")
    return top.select(*page, "by", label).select(*page, "label", F.coalesce(F.try_element_at("by", F.col("label")), F.lit(0)).alias("n"))


def wanted_labels(histogram: DataFrame) -> DataFrame:
    return histogram.where((F.col("label") > 0) & (F.col("n") >= LEAST_PIXELS))


def region_confidence(pixels: DataFrame, regions: DataFrame, page: list[str]) -> DataFrame:
    """Summed probability inside each region, edges included, over its area without the far edges; null for no area.

    regions: page columns, label, ith and corners a, b, c, d. pixels: page columns, x, y, label and prob.
    """
    area = ((F.col("r.c") - F.col("r.a")) * (F.col("r.d") - F.col("r.b"))).cast("double")
    same = [F.col(f"r.{p}") == F.col(f"p.{p}") for p in [*page, "label"]]
    within = F.col("p.x").between(F.col("r.a"), F.col("r.c")) & F.col("p.y").between(F.col("r.b"), F.col("r.d"))
    on = within
    for s in same:
        on = on & s
    joined = regions.alias("r").join(pixels.alias("p"), on, "left")
    keys = [F.col(f"r.{c}").alias(c) for c in [*page, "label", "ith", "a", "b", "c", "d"]]
    return joined.groupBy(*keys).agg(F.coalesce(F.sum("p.prob"), F.lit(0.0)).alias("total"), F.first(area).alias("area")).select(
        *page, "label", "ith", F.try_divide("total", "area").alias("confidence")
    )


def by_page(regions: DataFrame, page: list[str], extra: list[str] = ()) -> DataFrame:
    """One row for each page with its regions as an array of structs, by label and ith."""
    r = F.struct("label", "ith", *extra)
    return regions.groupBy(*page).agg(F.array_sort(F.collect_list(r)).alias("regions"))


def best_label(regions: Column) -> Column:
    """struct(label, ith, confidence) of the region of most confidence above 0, the first such; zeros if there is none.

    regions: array of structs in order of label and ith.
    """
    keyed = F.transform(F.filter(regions, lambda r: r["confidence"] > 0), lambda r: F.struct((-r["confidence"]).alias("k"), r["label"].alias("label"), r["ith"].alias("ith"), r["confidence"].alias("confidence")))
    best = F.array_min(keyed)
    none = F.struct(F.lit(0).cast("int").alias("label"), F.lit(0).cast("int").alias("ith"), F.lit(0.0).alias("confidence"))
    found = F.struct(best["label"].cast("int").alias("label"), best["ith"].cast("int").alias("ith"), best["confidence"].alias("confidence"))
    return F.when(best.isNotNull(), found).otherwise(none)


def instances(regions: Column, label: int, key: str, ascending: bool = True) -> Column:
    """A label's regions ordered by a field and then by ith, without the unfilled places.

    Unfilled places hold zeros and no rule ever takes one, so leaving them out changes no result.
    """
    sign = 1 if ascending else -1
    own = F.filter(regions, lambda r: r["label"] == label)
    return F.transform(F.array_sort(F.transform(own, lambda r: F.struct((r[key] * sign).alias("k"), r["ith"].alias("ith"), r.alias("r")))), lambda x: x["r"])


def all_instances(regions: Column, label: int, key: str, ascending: bool = True) -> Column:
    """ith of all places of a label, unfilled ones (which hold zero) too, in the order that instances() has."""
    sign = 1 if ascending else -1
    place = lambda i: F.struct(
        (F.coalesce(F.get(F.filter(regions, lambda r: (r["label"] == label) & (r["ith"] == i)), F.lit(0))[key], F.lit(0.0)) * sign).alias("k"), i.alias("ith")
    )
    return F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(MAX_REGIONS - 1)), place)), lambda x: x["ith"])


def vector(regions: Column) -> Column:
    """The page's array of LABELS * MAX_REGIONS * len(FIELDS) doubles; unfilled places hold zeros.

    Each region becomes a list once, and places look their list up: a search for each place took nine times as long.
    """
    zeros = F.array(*[F.lit(0.0)] * len(FIELDS))
    place = F.transform(regions, lambda r: F.when(r["ith"].between(0, MAX_REGIONS - 1), r["label"] * MAX_REGIONS + r["ith"]))
    own = F.transform(regions, lambda r: F.array(*[F.coalesce(r[f].cast("double"), F.lit(0.0)) for f in FIELDS]))
    at = lambda k: F.get(own, (F.array_position(place, F.lit(k)) - 1).cast("int"))
    return F.flatten(F.array(*[F.coalesce(at(k), zeros) for k in range(MAX_REGIONS, (LABELS + 1) * MAX_REGIONS)]))


def vector_names() -> list[str]:
    """A name for each place of the vector."""
    return [f"label{label}_{i}_{f}" for label in range(1, LABELS + 1) for i in range(MAX_REGIONS) for f in FIELDS]


def training_line(vec: Column, y: Column) -> Column:
    """A vector and its page type as a line of a training file."""
    return F.array_join(F.transform(F.concat(vec, F.array(y.cast("double"))), lambda x: x.cast("string")), ", ")


def checked(regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions whose label and place fit the vector, and the others."""
    fits = F.coalesce(F.col("label").between(1, LABELS) & F.col("ith").between(0, MAX_REGIONS - 1), F.lit(False))
    return regions.where(fits), regions.where(~fits)

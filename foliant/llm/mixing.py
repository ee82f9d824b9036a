"""Mix sources to target weights: how many words of each document to take.

A source's target is its share by weight of all words, up to EPOCHS times its own; what is over is shared out anew among the
others. A source is first taken whole as often as its target holds it. For the rest its documents are sorted by exponential keys over
quality weights (Efraimidis-Spirakis: the least keys are a weighted sample without replacement), sizes are summed in that
order, and documents are taken up to the one whose end is nearest the target.

Keys are hashes of id and text, so runs agree whatever the partitions. Sums run over bins of keys that are refined twice around
the cut, and only rows of the last bin are sorted; no source is sorted whole or held by one task.

Null texts have no words and take none. Rows without a source are a source of their own, the last. Rows that repeat an id and a text
have one key: of those at the cut as many are taken as fit, no matter which. Of other equal keys the smaller document comes
first. An empty table gives an empty result. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm import quality
from foliant.llm.base import cut, drop_cut, table
from foliant.operators.ranks import ranked

#: Times that a document may be taken, and weights of sources in order, repeating.
EPOCHS, WEIGHTS = 3, (1, 2, 3)
#: Bits of a key's bin, and those of them that the second pass refines.
BIN_BITS, FINE_BITS = 24, 12


def _sources(points: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """s, source_size, target, and the whole epochs and the words that are left to take."""
    sizes = ranked(points.groupBy("s").agg(F.sum("size").alias("source_size")), [F.col("s").asc()], keep=lambda df: cut(df, "sources"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sizes = cut(sizes.withColumn("w", weight).drop("rank"), "weights")
    most = epochs * F.col("source_size")
    total = sizes.agg(F.sum("source_size").alias("n"), F.sum("w").alias("w")).first()
    unit, full = (total.n or 0) / (total.w or 1), None
    while True:  # each round fills sources up; the driver sees three sums
        over = most < unit * F.col("w")
        got = sizes.agg(F.sum(F.when(over, most)).alias("full"), F.sum(F.when(~over, F.col("w"))).alias("w"), F.count_if(over).alias("n")).first()
        if got.n == full or not got.w:
            break
        unit, full = ((total.n or 0) - (got.full or 0)) / got.w, got.n
    target = F.least(most.cast("double"), unit * F.col("w"))
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.floor(target / F.col("source_size")))).otherwise(0)
    rest = F.when(whole < epochs, F.greatest(F.lit(0.0), target - whole * F.col("source_size"))).otherwise(0.0)
    return sizes.select("s", "source_size", target.alias("target"), whole.cast("int").alias("epochs"), rest.alias("rest"))


def _crossing(sums: DataFrame, column: str, before: str, after: str) -> DataFrame:
    """For each source the bin in which its rest is reached, and the words before that bin. sums: s, rest, the bin, n and earlier words."""
    upto = Window.partitionBy("s").orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.withColumn("end", F.col(before) + F.sum("n").over(upto)).where(F.col("end") > F.col("rest"))
    first = run.groupBy("s").agg(F.min(F.struct(column, (F.col("end") - F.col("n")).alias(after))).alias("x"))
    return first.select("s", f"x.{column}", f"x.{after}")


def mix(docs: DataFrame, quality_weight: Column, size: Column, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target and taken. docs: doc_id, s (the source as text that sorts), h (the row's hash), and what the two columns need."""
    uniform = (F.shiftrightunsigned("h", 11) + 0.5) / float(1 << 53)
    key = -F.log(uniform) / F.greatest(quality_weight, F.lit(1e-6))
    points = docs.select("doc_id", "s", "h", size.cast("long").alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row"))
    place = F.least(F.lit((1 << BIN_BITS) - 1), F.floor((1 - F.exp(-F.col("key"))) * (1 << BIN_BITS)))
    points = cut(points.withColumn("fine", place.cast("int")).withColumn("coarse", F.shiftright("fine", FINE_BITS)), "points")
    sources = cut(_sources(points, weights, epochs), "targets")
    some = points.where("size > 0").join(sources.where("rest > 0").select("s", "rest"), "s")

    sums = some.groupBy("s", "rest", "coarse").agg(F.sum("size").alias("n")).withColumn("b0", F.lit(0).cast("long"))
    at = cut(_crossing(sums, "coarse", "b0", "b1"), "coarse")
    sums = some.join(at, ["s", "coarse"]).groupBy("s", "rest", "fine", "b1").agg(F.sum("size").alias("n"))
    at = cut(_crossing(sums, "fine", "b1", "b2"), "fine")
    # the last bin: rows of one hash and size are one entry of so many copies
    last = some.join(at, ["s", "fine"]).groupBy("s", "rest", "b2", "key", "h", "size").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("s").orderBy("key", "size", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("end", F.col("b2") + F.sum(F.col("size") * F.col("copies")).over(order)).where(F.col("end") > F.col("rest"))
    entry = last.groupBy("s").agg(F.min(F.struct("key", "size", "h", "copies", (F.col("rest") - F.col("end") + F.col("size") * F.col("copies")).alias("room"))).alias("e"))
    fit = F.least(F.col("e.copies"), F.floor(F.col("e.room") / F.col("e.size") + 0.5).cast("long"))  # to the nearest whole document
    entry = cut(entry.select("s", F.col("e.key").alias("k"), F.col("e.size").alias("z"), F.col("e.h").alias("x"), fit.alias("fit")), "cuts")

    ends = points.join(entry, "s").where("key = k and size = z and h = x").select("s", "row", "fit")
    ends = ranked(ends, [F.col("row").asc()], ["s"], keep=lambda df: cut(df, "ends"))
    ends = ends.where(F.col("rank") <= F.col("fit")).select("row", F.lit(True).alias("fits"))
    before = F.struct("key", "size", "h") < F.struct(F.col("k").alias("key"), F.col("z").alias("size"), F.col("x").alias("h"))
    out = points.join(sources.join(entry, "s", "left"), "s").join(ends, "row", "left")
    more = F.when((F.col("rest") > 0) & (F.col("k").isNull() | before | F.coalesce("fits", F.lit(False))), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + more)).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mix of documents (doc_id, text, source); a document's quality weight is one over one plus the quality rules it fails."""
    text, source = docs["text"], docs["source"]
    rows = docs.select(
        docs["doc_id"].alias("doc_id"), text.alias("text"),
        F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("s"), F.xxhash64(docs["doc_id"].cast("string"), text).alias("h"),
    )
    judged = quality.ledger(rows, carry=["doc_id", "s", "h"])
    return mix(judged, 1.0 / (1 + F.bit_count("failed_rules")), F.col("n_words"), weights, epochs)


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))

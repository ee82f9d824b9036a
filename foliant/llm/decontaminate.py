"""Benchmark decontamination by a prefix-filtered set join of shingles, with DataFrame functions alone.

A window is WINDOW consecutive words of an item (a shorter item is one window). It is a set of shingles with their places.
For exact containment the prefix that a join needs is one shingle, so each window is joined by the one that is rarest in
the documents; length and position then bound where the window can stand, and the shingles that cover it are verified
there. Only shingles that some item has are kept of the documents, so what is shuffled grows with the hits.

Null and wordless texts have no words, no hits and the digest of an empty list; wordless items have no window. Very long
texts are read whole. Rows that repeat an id and a text get the same result each; repeated items count once by item_id and a
null item_id counts for hits but is in no list. Empty documents give an empty result; an empty benchmark gives no hits.
Only ids and texts are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.base import count_words, cut, normal_words, table

WINDOW = 13
SHINGLE = 5
#: Benchmark rows (shingles or windows) up to which that side of a join is broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it is small enough. df must be a table that is cheap to count."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shingles(normal, size: int):
    """All runs of so many words, overlapping, of a text that normal_words() made."""
    return F.regexp_extract_all(normal, F.lit("(?=((?:[^ ]++ ){%d}[^ ]++))[^ ]++" % (size - 1)), F.lit(1))


def windows_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, window, n_window, size, shingles): each window of each item once, as its words and as its shingles."""
    items = benchmark.select(benchmark[f"`{item_id}`"].cast("string").alias("item_id"), normal_words(benchmark[f"`{text}`"]).alias("normal"))
    items = items.where("normal <> ''").withColumn("words", F.split("normal", " "))
    n = F.size("words")
    start = F.explode(F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1))))
    found = items.select("item_id", "words", start.alias("s")).select("item_id", F.slice("words", F.col("s"), window).alias("w"))
    size = F.least(F.size("w"), F.lit(shingle))
    parts = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))
    return found.select("item_id", F.array_join("w", " ").alias("window"), F.size("w").alias("n_window"), size.alias("size"), parts.alias("shingles")).distinct()


def occurrences(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, item_id: str = "item_id") -> tuple[DataFrame, DataFrame]:
    """Where windows stand: (k1, k2, start, window, n_window), and (window, item_id). k1 and k2 are a document's id and hash."""
    whole = cut(windows_of(benchmark, item_id, "text", window, shingle), "windows")
    distinct = cut(whole.select("window", "n_window", "size", "shingles").distinct(), "windows")
    sought = cut(distinct.select("size", F.explode("shingles").alias("shingle")).distinct().withColumn("h", F.xxhash64("shingle")), "shingles")

    base = docs.select(docs[f"`{doc_id}`"].alias("k1"), F.xxhash64(docs[f"`{text}`"]).alias("k2"), count_words(docs[f"`{text}`"]).alias("n_words"), normal_words(docs[f"`{text}`"]).alias("normal"))
    hits = None
    for (size,) in sorted(distinct.select("size").distinct().collect()):  # at most `shingle` different sizes
        places = base.select("k1", "k2", "n_words", F.posexplode(shingles(F.col("normal"), size)).alias("pos", "shingle"))
        part = places.withColumn("h", F.xxhash64("shingle")).join(_small(sought.where(F.col("size") == size)), ["h", "shingle"])
        part = part.select("k1", "k2", "n_words", "pos", "size", "shingle")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        empty = base.select("k1", "k2", F.lit(0).alias("start"), F.lit("").alias("window"), F.lit(0).alias("n_window")).limit(0)
        return empty, whole.select("window", "item_id")
    hits = cut(hits.distinct(), "hits")

    # the prefix: of each window the shingle in the fewest places; one that is nowhere rules its window out
    rarity = hits.groupBy("size", "shingle").agg(F.count("*").alias("n"))
    each = distinct.select("window", "n_window", "size", F.size("shingles").alias("n_shingles"), F.posexplode("shingles").alias("offset", "shingle"))
    by_window = Window.partitionBy("window")
    prefix = (
        each.join(_small(cut(rarity, "rarity")), ["size", "shingle"])
        .withColumn("present", F.count("*").over(by_window))
        .withColumn("rank", F.row_number().over(by_window.orderBy("n", "shingle", "offset")))
        .where("rank = 1 and present = n_shingles")
        .select("window", "n_window", "size", "shingle", "offset")
    )
    prefix = cut(prefix, "prefix")
    start = (F.col("pos") - F.col("offset")).alias("start")
    candidates = hits.join(_small(prefix), ["size", "shingle"]).select("k1", "k2", "n_words", "window", "n_window", "size", start)
    candidates = candidates.where("start >= 0 and start + n_window <= n_words")

    # verify: the shingles at every `size` words and at the end cover the window
    cover = each.where((F.col("offset") % F.col("size") == 0) | (F.col("offset") == F.col("n_shingles") - 1))
    cover = cut(cover.select("window", "size", "offset", "shingle", F.count("*").over(by_window).alias("n_cover")), "cover")
    wanted = candidates.join(_small(cover), ["window", "size"]).withColumn("pos", F.col("start") + F.col("offset"))
    there = hits.select("k1", "k2", "pos", "size", "shingle")
    same = [wanted[c].eqNullSafe(there[c]) for c in ("k1", "k2", "pos", "size", "shingle")]
    found = (
        wanted.join(there, same, "left_semi")
        .groupBy("k1", "k2", "start", "window", "n_window", "n_cover")
        .agg(F.count("*").alias("n_there"))
        .where("n_there = n_cover")
        .select("k1", "k2", "start", "window", "n_window")
    )
    return cut(found, "occurrences"), whole.select("window", "item_id")


def _verdicts(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, **how) -> DataFrame:
    """The columns of contamination() and h, the hash of the text, for every row of docs."""
    found, items = occurrences(docs, benchmark, doc_id, text, **how)
    order = Window.partitionBy("k1", "k2").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("k1", "k2", "start", (F.col("start") + F.col("n_window")).alias("end")).distinct()
    fresh = F.col("end") - F.greatest("start", F.least("end", F.coalesce(F.max("end").over(order), F.lit(0))))
    hit = spans.withColumn("fresh", fresh).groupBy("k1", "k2").agg(F.sum("fresh").cast("long").alias("n_hit"))
    named = found.select("k1", "k2", "window").join(_small(items), "window").where("item_id is not null").select("k1", "k2", "item_id").distinct()
    named = named.groupBy("k1", "k2").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("items"))
    per_doc = cut(hit.join(named, [hit.k1.eqNullSafe(named.k1), hit.k2 == named.k2], "left").select(hit.k1, hit.k2, "n_hit", "n_items", "items"), "contamination")

    base = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), F.xxhash64(docs[f"`{text}`"]).alias("h"), count_words(docs[f"`{text}`"]).alias("n_words"))
    out = base.join(per_doc, base.doc_id.eqNullSafe(per_doc.k1) & (base.h == per_doc.k2), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        "h",
    )


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, for every row of docs."""
    return _verdicts(docs, benchmark, doc_id, text, **how).drop("h")


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of docs that are not contaminated, with the columns of docs; rows that share an id, or have none, are judged each by its text."""
    found = _verdicts(docs, benchmark, doc_id, text, **how)
    bad = cut(found.where("contaminated").select(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).distinct(), "contaminated")
    same = docs[f"`{doc_id}`"].eqNullSafe(bad["__id"]) & (F.xxhash64(docs[f"`{text}`"]) == bad["__h"])
    return docs.join(bad, same, "left_anti")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

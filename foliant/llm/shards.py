"""Shards of near equal bytes by k-d tree partitioning over metadata.

Each node is split at the weighted median (weight: bytes) of its widest dimension until the leaves hold the target. Medians
are found for all nodes of a level at once by distributed histograms that are refined around the cut; the driver sees a
bounded number of bins. Rows are ordered by (dimension, group, row), where a group is all rows of one text: so equal
texts share a shard, unless the cut falls into a group so heavy that keeping it whole would make the shards uneven.

Only metadata is moved, never texts. Null texts have no bytes (size 1) and the checksum of the empty text; null metadata
counts as 0. Rows may repeat, each takes a slot of its own; with fewer rows than shards some shards stay empty; an
empty table gives an empty result. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.base import cut, drop_cut, table

#: Histogram bins of a pass, over all nodes of a level.
BINS = 16_384
#: Parts of a shard's bytes by which a cut may miss the median; and up to which a group is kept whole.
MISS, WHOLE_GROUP = 0.0005, 0.01
#: Rows that are ranked together to number slots.
SLOT_ROWS = 20_000


def _points(docs: DataFrame, doc_id: str, text: str, metadata: tuple[str, ...]) -> DataFrame:
    """doc_id, size, crc, g (group), r (row) and d0, d1, ...: the group's size and the least code of each metadata column."""
    t = docs[f"`{text}`"]
    code = [F.crc32(F.coalesce(docs[f"`{m}`"].cast("string"), F.lit("")).cast("binary")) if m in docs.columns else F.lit(0).cast("long") for m in metadata]
    rows = docs.select(
        docs[f"`{doc_id}`"].alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("crc"),
        F.shiftrightunsigned(F.xxhash64(t), 2).alias("g"),
        F.shiftrightunsigned(F.xxhash64(docs[f"`{doc_id}`"], F.lit("row")), 2).alias("r"),
        *[c.alias(f"c{i}") for i, c in enumerate(code)],
    )
    rows = cut(rows, "points")
    groups = rows.groupBy("g").agg(F.count("*").alias("n"), *[F.min(f"c{i}").alias(f"d{i + 1}") for i in range(len(code))])
    # a text that comes once needs no group: its own metadata serve
    # as a table, so that the join can split the rows of a text that a third of them may have
    more = cut(groups.where("n > 1").drop("n"), "groups")
    joined = rows.join(more, "g", "left")
    return joined.select("doc_id", "size", "crc", "g", "r", F.col("size").alias("d0"), *[F.coalesce(f"d{i + 1}", f"c{i}").alias(f"d{i + 1}") for i in range(len(code))])


def _pick(values: list, kind: str):
    """A column that gives, by node, one of the values."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("node"))


def _medians(rows: DataFrame, shares: list[float], dims: list[int], miss: float, whole: float) -> list[tuple | None]:
    """For each node the least (dimension, group, row) of its right side, near the given share of its weight."""
    n_dims = max(dims) + 1
    axis = F.lit(None).cast("long")
    for k in range(n_dims):
        axis = F.when(_pick(dims, "int") == k, F.col(f"d{k}")).otherwise(axis)
    keyed = rows.withColumn("v", axis)
    bounds = {x["node"]: x for x in keyed.groupBy("node").agg(F.sum("size").alias("w"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()}
    nodes = len(shares)
    state = []
    for i in range(nodes):
        b = bounds.get(i)
        state.append({"part": 0, "fixed": [], "lo": b["lo"], "hi": b["hi"], "before": 0, "want": shares[i] * b["w"], "at": None} if b else None)
    while any(s and s["at"] is None for s in state):
        live = [s and s["at"] is None for s in state]
        bins = max(16, BINS // sum(map(bool, live)))
        for s, on in zip(state, live, strict=True):
            if on:
                s["width"] = -(-(s["hi"] - s["lo"] + 1) // bins)
        get = lambda f, kind="long", live=live: _pick([f(s) if on else None for s, on in zip(state, live, strict=True)], kind)
        part = get(lambda s: s["part"], "int")
        value = F.when(part == 0, F.col("v")).when(part == 1, F.col("g")).otherwise(F.col("r"))
        inside = (part < 1) | (F.col("v") == get(lambda s: s["fixed"][0] if s["part"] > 0 else None))
        inside = inside & ((part < 2) | (F.col("g") == get(lambda s: s["fixed"][1] if s["part"] > 1 else None)))
        seen = keyed.where(part.isNotNull()).where(inside).withColumn("x", value)
        seen = seen.where((F.col("x") >= get(lambda s: s["lo"])) & (F.col("x") <= get(lambda s: s["hi"])))
        seen = seen.withColumn("lo", get(lambda s: s["lo"])).withColumn("width", get(lambda s: s["width"])).withColumn("bin", F.expr("(x - lo) div width"))
        got = seen.groupBy("node", "bin").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min("g").alias("g0"), F.max("g").alias("g1")).collect()
        by: dict[int, list] = {}
        for x in got:
            by.setdefault(x["node"], []).append(tuple(x)[1:])
        for i, s in enumerate(state):
            if not live[i]:
                continue
            before = s["before"]
            for number, weight, rows_in, least, most in sorted(by[i]):
                if before + weight >= s["want"]:
                    break
                before += weight
            else:  # the share is reached by the last bin alone, if at all
                before -= weight
            lo = s["lo"] + number * s["width"]
            hi = min(s["hi"], lo + s["width"] - 1)
            done = weight <= miss or rows_in == 1 or least == most and weight <= whole
            exact = lo == hi
            if done or exact and s["part"] == 2:
                after = s["want"] - before > weight / 2  # the nearer side of the bin
                s["at"] = (*s["fixed"], lo if not after else hi + 1)
            elif exact:
                s |= {"fixed": [*s["fixed"], lo], "part": s["part"] + 1, "lo": 0, "hi": (1 << 62) - 1, "before": before}
            else:
                s |= {"lo": lo, "hi": hi, "before": before}
    return [s and tuple([*s["at"], 0, 0][:3]) for s in state]


def leaves(points: DataFrame, n_dims: int, shards: int) -> DataFrame:
    """points with shard, from 0 to shards - 1, by a tree of depth ceil(log2(shards))."""
    sums = points.agg(F.sum("size").alias("w"), *[F.min(f"d{k}").alias(f"lo{k}") for k in range(n_dims)], *[F.max(f"d{k}").alias(f"hi{k}") for k in range(n_dims)]).first()
    rows = cut(points.withColumn("node", F.lit(0)), "nodes")
    if not sums["w"]:
        return rows.withColumnRenamed("node", "shard")
    spread = [max(1, sums[f"hi{k}"] - sums[f"lo{k}"]) for k in range(n_dims)]
    target = sums["w"] / shards
    sizes = [shards]  # of each node, the leaves below it
    while max(sizes) > 1:
        found = rows.groupBy("node").agg(*[F.min(f"d{k}").alias(f"lo{k}") for k in range(n_dims)], *[F.max(f"d{k}").alias(f"hi{k}") for k in range(n_dims)])
        extent = {x["node"]: [(x[f"hi{k}"] - x[f"lo{k}"]) / spread[k] for k in range(n_dims)] for x in found.collect()}
        dims = [max(range(n_dims), key=lambda k, e=extent.get(i): e[k] if e else 0) for i in range(len(sizes))]
        shares = [(n // 2) / n for n in sizes]
        at = _medians(rows, shares, dims, MISS * target, WHOLE_GROUP * target)
        axis = F.lit(None).cast("long")
        for k in range(n_dims):
            axis = F.when(_pick(dims, "int") == k, F.col(f"d{k}")).otherwise(axis)
        v, g, r = (_pick([a[j] if a else None for a in at], "long") for j in range(3))
        split = _pick([n > 1 for n in sizes], "boolean")
        right = split & ((axis > v) | (axis == v) & ((F.col("g") > g) | (F.col("g") == g) & (F.col("r") >= r)))
        first = list(accumulate((2 if n > 1 else 1 for n in sizes), initial=0))[:-1]  # a node's left child; a leaf has no other
        after = cut(rows.withColumn("node", _pick(first, "int") + F.when(right, 1).otherwise(0)), "nodes")
        drop_cut(rows)
        rows, sizes = after, [m for n in sizes for m in ((n // 2, n - n // 2) if n > 1 else (n,))]
    return rows.withColumnRenamed("node", "shard")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with slot: gapless from 0 in each shard, ranked in buckets of bounded size whose offsets are added up."""
    buckets = max(1, rows.count() // SLOT_ROWS)
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("r", "g"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "r", "g"))
    ranked = dealt.withColumn("rank", rank - 1)
    return ranked.join(offsets, ["shard", "bucket"]).withColumn("slot", (F.col("offset") + F.col("rank")).cast("long"))


def partition(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", metadata: tuple[str, ...] = ("lang", "source"), target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row. target_bytes, if given, sets the number of shards."""
    points = cut(_points(docs, doc_id, text, metadata), "points")
    if target_bytes:
        shards = max(1, -(-(points.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    rows = leaves(points, 1 + len(metadata), shards)
    return numbered(rows).select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = partition(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""One document of each group of near copies: texts whose sets of word shingles have a Jaccard similarity of LEAST or more.

Texts with the same set are one node. Each has a SimHash fingerprint of its shingles, and fingerprints within the radius,
which simhash compares exactly in tiles, are candidates. So narrow a radius finds few of the pairs at the least similarity,
whose fingerprints differ in some ten bits, and a radius that finds them all has no buckets to compare within; candidates of
the rest come from bands of MinHash values: a pair at the least similarity shares none with a chance of (1 - LEAST ** ROWS)
** BANDS, 3 in a million. Candidates only say which nodes may be linked, as components of stars; the sets of each such
component are then compared exactly, in tiles of which every two meet as a task of their own. Only verified pairs make the
links of a group.

Null and wordless texts have the empty set and are copies of each other. Very long texts are read whole. Of each group the
row with the least id stays, rows without an id after all others and the least hash of id and text among equals; of rows that
agree in id and text one stays; an empty table gives an empty result. Input columns keep their names and values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import simhash
from foliant.llm.base import annotate, bound_batches, cut, drop_cut, field, release
from foliant.llm.graph import components

WORDS = 5
LEAST = 0.8
ROWS, BANDS = 5, 32
SEED = 42
#: Bits of the filter that keeps texts that are no candidates from moving: 4 MB.
FILTER_BITS = 1 << 25
#: Sets of a component that one task compares with each other or with as many more.
TILE = 1024

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the text's shingles, each once; a text of fewer words is one shingle."""
    return np.unique(simhash.shingle_hashes(text, words))


def bands(shingles: np.ndarray) -> list[int]:
    """A hash of each band of MinHash values, as signed longs; none for the empty set."""
    if not len(shingles):
        return []
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 256):
        np.minimum(least, (shingles[i : i + 256, None] * _FACTORS).min(axis=0), out=least)
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[b].tobytes(), seed=b) for b in range(BANDS)], np.uint64).view(np.int64).tolist()


def similar(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two sorted sets have the least Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int(np.count_nonzero(a[at] == b))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def tile_links(nodes: list[int], sides: list[int], sets: list[np.ndarray], least: float = LEAST) -> list[tuple[int, int]]:
    """A forest of the verified links; where there are two sides, of links between them."""
    order = sorted(range(len(nodes)), key=lambda i: len(sets[i]))
    root = list(range(len(nodes)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    two, out = len(set(sides)) > 1, []
    for k, i in enumerate(order):
        for j in reversed(order[:k]):
            if len(sets[j]) < least * len(sets[i]) - 1e-9:
                break  # earlier sets are smaller still
            if two and sides[i] == sides[j]:
                continue
            a, b = top(i), top(j)
            if a != b and similar(sets[i], sets[j], least):
                root[a] = b
                out.append((nodes[i], nodes[j]))
    return out


def _verify(least: float):
    def run(batches):
        held, nodes, sides, sets = None, [], [], []

        def links():
            got = tile_links(nodes, sides, sets, least)
            u, v = [a for a, _ in got], [b for _, b in got]
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            keys, ids, parts = (batch.column(c).to_pylist() for c in range(3))
            lists = batch.column(3)
            values, ends = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            for r, key in enumerate(keys):
                if key != held:
                    if nodes:
                        yield links()
                    held, nodes, sides, sets = key, [], [], []
                nodes.append(ids[r])
                sides.append(parts[r])
                sets.append(values[ends[r] : ends[r + 1]].copy())
        if nodes:
            yield links()
        nodes, sides, sets, batch, lists, values = [], [], [], None, None, None
        release()

    return run


def near_links(members: DataFrame, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """Links (u, v) that join every two nodes of a component of candidates that are similar enough, directly or by others.

    members: node, root and shingles (sorted hashes), in a table that can be read again.
    """
    tiles = members.groupBy("root").agg(F.ceil(F.count("*") / tile).cast("int").alias("t"))
    own = F.pmod(F.xxhash64("node"), F.col("t")).cast("int")
    dealt = members.join(tiles, "root").select("root", "node", "shingles", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("j"))
    keyed = dealt.select(F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "node", "i", "shingles")
    bound_batches(members.sparkSession)
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_verify(least), "u long, v long")


def one_of_each(docs: DataFrame, least: float = LEAST, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies, with the columns of docs."""
    row = F.xxhash64(F.isnull(docs[f"`{doc_id}`"]), docs[f"`{doc_id}`"], docs[f"`{text}`"])
    base = docs.select(row.alias("row"), docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"))

    def signatures():
        def run(texts):
            sets = [shingle_set(t, words) for t in texts]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), seed=SEED) for s in sets], np.uint64).view(np.int64)
            prints = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
            return [nodes, prints, [bands(s) for s in sets]]

        return run

    def sets():
        return lambda texts: [[shingle_set(t, words).view(np.int64) for t in texts]]

    kinds = [field("node", "long"), field("fingerprint", "long"), field("bands", "array<long>")]
    signed = cut(annotate(base, signatures, kinds, carry=["row", "doc_id"]), "signatures")
    # structs compare by their first fields, so rows without an id come last
    first = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("first")
    first = cut(signed.groupBy("node").agg(F.min("fingerprint").alias("fingerprint"), first), "nodes")
    prints = cut(first.groupBy("fingerprint").agg(F.min("node").alias("m")), "prints")
    buckets = cut(signed.select("node", F.explode("bands").alias("bucket")).distinct(), "buckets")
    candidates = components(_like_prints(first, prints).unionByName(_like_bands(buckets)))
    members = cut(candidates.join(first, "node").select("node", "root", F.col("first.row").alias("row")), "members")
    for written in (prints, buckets):
        drop_cut(written)
    texts = _likely(base.select("row", "text"), members).join(members, "row").dropDuplicates(["node"])
    texts = cut(annotate(texts, sets, [field("shingles", "array<long>")], carry=["node", "root"]), "sets")
    linked = components(near_links(texts, least))
    groups = first.join(linked, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("first").alias("first"))
    kept = cut(groups.select(F.col("first.row").alias("__row")), "kept")
    left = docs.withColumn("__row", row).join(kept, "__row", "left_semi")
    # rows that agree in id and text
    again = cut(signed.groupBy("row").count().where("count > 1").select(F.col("row").alias("__row")), "again")
    for written in (signed, first, members, texts):
        drop_cut(written)
    if not again.isEmpty():
        left = left.join(again, "__row", "left_anti").unionByName(left.join(again, "__row", "left_semi").dropDuplicates(["__row"]))
    return left.select(*[f"`{c}`" for c in docs.columns])


def _like_prints(nodes: DataFrame, leasts: DataFrame, radius: int = simhash.RADIUS) -> DataFrame:
    """Links (u, v) of nodes whose fingerprints lie within the radius, directly or by way of others; leasts: a node m of each."""
    near = simhash.near_links(leasts.select("fingerprint"), radius)
    one, other = (leasts.select(F.col("fingerprint").alias(k), F.col("m").alias(n)) for k, n in (("u", "a"), ("v", "b")))
    across = near.join(one, "u").join(other, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    same = nodes.select("fingerprint", "node").join(leasts, "fingerprint").where("node <> m").select(F.col("node").alias("u"), F.col("m").alias("v"))
    return across.unionByName(same)


def _like_bands(buckets: DataFrame) -> DataFrame:
    """Links (u, v) of nodes that share a band, as a star in each bucket."""
    stars = buckets.groupBy("bucket").agg(F.min("node").alias("m"), F.max("node").alias("x")).where("m <> x").select("bucket", "m")
    return buckets.join(stars, "bucket").where("node <> m").select(F.col("node").alias("u"), F.col("m").alias("v"))


def _likely(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Rows that may be among the members: all of these and few others, so that other texts need not move for a join.

    A set of FILTER_BITS bits of the members' hashes is broadcast, in 4096 bytes a row: its size does not grow with them.
    """
    bit = F.pmod(F.xxhash64("row", F.lit("bit")), F.lit(FILTER_BITS))
    bits = members.select(F.bitmap_bucket_number(bit).alias("__bucket"), F.bitmap_bit_position(bit).alias("__at"))
    bits = bits.groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    there = rows.withColumns({"__bucket": F.bitmap_bucket_number(bit), "__at": F.bitmap_bit_position(bit)}).join(F.broadcast(bits), "__bucket")
    byte = F.expr("cast(conv(hex(substring(__bits, cast(__at div 8 as int) + 1, 1)), 16, 10) as int)")
    return there.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(__at % 8 as int))")) != 0).select(rows.columns)

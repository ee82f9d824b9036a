"""Near-duplicate documents by 64-bit SimHash fingerprints, compared exactly in tiles.

Texts that agree share a fingerprint, so only distinct fingerprints are compared. A pair within the radius agrees in
some blocks of its bits (the pigeonhole principle): fingerprints meet in the buckets of each choice of blocks, and a
bucket of more than TILE fingerprints is dealt into tiles, of which every two meet as a task of their own. Inside,
fingerprints are ordered by population count; squares of rows whose counts differ by more than the radius are skipped and
the rest is compared exactly with numpy's exclusive-or and bit counts. Buckets of SMALL fingerprints or fewer, which would
make squares of a few rows each, are laid side by side in one tile, ordered by bucket and count, and compared along its
diagonals, with the same skip. A tile gives a forest of its links, not all pairs.

Null and wordless texts have the fingerprint zero and are linked like any other. Very long texts are read whole. Rows
with the same id are one document for component ids; repeated rows come back each. An empty table gives an empty result.
Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.base import annotate, cut, field, release, table
from foliant.llm.graph import components

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Fingerprints of a bucket that one task compares with each other or with as many more.
TILE = 4096
#: Rows and columns of the squares inside a tile.
SQUARE = 1024
#: Fingerprints up to which buckets share a tile.
SMALL = 64
#: Links kept in a task before they are reduced to a forest.
REDUCE_AT = 1_000_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's shingles in their order; a text of fewer words is one shingle."""
    words = text.encode().lower().split() if text else []  # of bytes: A-Z alone, and the six ASCII separators
    if not words:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return np.array([digest(line, seed=SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return np.fromiter([digest(line[a:b], seed=SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """Bit b is set if it is set in over half of the hashes."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        bits += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of the hashes of the text's shingles, repeats included; zero without a word."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, text: str = "text", carry: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """Add fingerprint, the 64 bits as a signed long."""

    def make():
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    return annotate(docs, make, [field("fingerprint", "long")], text, carry)


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of the bits that a pair within the radius shares for at least one of them, as signed longs."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    each = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(c) for c in combinations(each, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(count: int, radius: int) -> int:
    """More blocks make smaller buckets but more copies of a row: enough for some hundred rows in a random bucket."""
    blocks = radius + 1
    while blocks < radius + 5 and count >> round(64 * (blocks - radius) / blocks) > 256:
        blocks += 1
    return blocks


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each value to the least one of its component, for values linked by u and v."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = label != np.arange(len(names))
    return names[own], names[label[own]]


def tile_links(values: np.ndarray, radius: int):
    """Index pairs of a bucket's fingerprints within the radius, in squares of rows ordered by population count."""
    count = np.bitwise_count(values)
    order = np.argsort(count, kind="stable")
    values, count = values[order], count[order].astype(np.int64)
    n = len(values)
    for i in range(0, n, SQUARE):
        last = count[min(i + SQUARE, n) - 1]
        for j in range(i, n, SQUARE):
            if count[j] - last > radius:
                break  # later rows have as many bits or more
            near = np.bitwise_count(values[i : i + SQUARE, None] ^ values[None, j : j + SQUARE]) <= radius
            a, b = np.nonzero(near)
            keep = a + i < b + j
            yield order[a[keep] + i], order[b[keep] + j]


def _compare(radius: int):
    names = ["u", "v"]

    def links(key: np.ndarray, values: np.ndarray):
        """Pairs within the radius among rows of the same key; rows are ordered by key."""
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        small = np.repeat(sizes <= SMALL, sizes)
        k, x = key[small], values[small]
        count = np.bitwise_count(x).astype(np.int64)
        order = np.lexsort((count, k))
        k, x, count = k[order], x[order], count[order]
        for step in range(1, SMALL):
            # counts rise along a diagonal's distance, so if no pair is left here, none is beyond
            close = np.flatnonzero((k[:-step] == k[step:]) & (count[step:] - count[:-step] <= radius)) if len(k) > step else ()
            if not len(close):
                break
            hit = close[np.bitwise_count(x[close] ^ x[close + step]) <= radius]
            yield x[hit], x[hit + step]
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            part = values[s : s + n]
            for a, b in tile_links(part, radius):
                yield part[a], part[b]

    def run(batches):
        left_key, left = np.empty(0, np.int64), np.empty(0, np.uint64)
        us, vs, held = [], [], 0

        def reduced():
            return _forest(np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.uint64),) * 2

        for batch, last in _with_last(batches):
            key = left_key if batch is None else np.concatenate([left_key, batch.column(0).to_numpy(zero_copy_only=False)])
            values = left if batch is None else np.concatenate([left, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            cut_at = len(key) if last else int(np.searchsorted(key, key[-1])) if len(key) else 0
            left_key, left = key[cut_at:], values[cut_at:]  # the last key may go on in the next batch
            if not cut_at:
                continue
            for u, v in links(key[:cut_at], values[:cut_at]):
                if len(u):
                    us.append(u)
                    vs.append(v)
                    held += len(u)
                    if held > REDUCE_AT:
                        u, v = reduced()
                        us, vs, held = [u], [v], len(u)
        u, v = reduced()
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=names)
        us = vs = u = v = key = values = left_key = left = batch = None
        release()

    return run


def _with_last(batches):
    for b in batches:
        yield b, False
    yield None, True


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """Links (u, v) that join every two distinct fingerprints within the radius, directly or by way of others.

    prints: distinct fingerprints, in a table that can be read again.
    """
    masks = block_masks(radius, blocks or blocks_for(prints.count(), radius))
    buckets = prints.select(
        "fingerprint",
        F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("x")) for i, m in enumerate(masks)])).alias("b"),
    ).select("fingerprint", F.xxhash64("b.c", "b.x").alias("bucket"))
    tiles = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / tile).cast("int").alias("t"))
    met = buckets.join(tiles, "bucket")
    own = F.pmod(F.xxhash64("fingerprint"), F.col("t")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("j")
    dealt = met.select("bucket", "fingerprint", own.alias("i"), other)
    keyed = dealt.select(F.xxhash64("bucket", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "fingerprint")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(radius), "u long, v long")


def groups(prints: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id") -> DataFrame:
    """(fingerprint, component_id) for the fingerprints that link to another; prints has an id and a fingerprint each."""
    distinct = cut(prints.groupBy("fingerprint").agg(F.min(doc_id).alias("first_id")), "fingerprints")
    roots = components(near_links(distinct.select("fingerprint"), radius))
    named = roots.join(distinct, roots.node == distinct.fingerprint).select("fingerprint", "root", "first_id")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = named.join(least, "root").select("fingerprint", "component_id")
    found = distinct.select("fingerprint", "first_id").join(linked, "fingerprint", "left")
    # as a table, so that a join of all documents with it can split the fingerprint that a third of them may have
    return cut(found.select("fingerprint", F.coalesce("component_id", "first_id").alias("component_id")), "components")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; component_id is the least id that links reach.

    A null id takes part like any other; a component has a null component_id only if all its ids are null.
    """
    prints = cut(fingerprints(docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text")), "text", ["doc_id"], shingle), "prints")
    return prints.join(groups(prints, radius), "fingerprint")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")

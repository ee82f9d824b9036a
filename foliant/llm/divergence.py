"""How far the sources of one language differ in their words, and by which words.

Terms are counted where the texts are, so that counts move, not texts. A language's kept terms are dealt into blocks; a task
fills one block's matrix of groups by terms, takes shares as whole numbers, and compares all pairs of groups by broadcasting.
Sums of a block's pairs, and the highest terms of each group in it, are then added up and merged. All arithmetic is in whole
numbers, so results do not depend on the order of anything.

Null texts, languages and sources count as empty. A group without terms is compared too, as one that has none of the kept
terms; a language without kept terms has pairs of value 0. Of equal values the item whose UTF-8 bytes are less comes first. Repeated
rows count each. An empty table gives an empty result. Only the named columns are read, so others cannot clash. Counts of a
language may go up to 9e15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.base import bound_batches, cut, drop_cut, release, table

#: Documents that a kept term is in, at least; ranks of terms that a group keeps.
LEAST_DOCS, TOP = 10, 10
#: Terms of a block and cells of its matrix, at most; groups that are compared with each other at a time.
BLOCK_TERMS, BLOCK_CELLS, GROUP_TILE = 2048, 1 << 20, 256
#: Counted terms that a task holds before it hands them on, and bytes of a text that are split at a time.
HELD_TERMS, SLICE_BYTES = 200_000, 1 << 20
SCALE = 1_000_000_000

#: By byte: letters of A-Z in lower case, everything from 0x80 on and a-z as they are, the rest a space.
_LETTERS = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    data = (text or "").encode()
    at = 0
    while at < len(data):
        part = data[at : at + SLICE_BYTES].translate(_LETTERS)
        if at + SLICE_BYTES < len(data) and (end := part.rfind(b" ")) >= 0:
            part = part[: end + 1]
        elif at + SLICE_BYTES < len(data):  # no separator in a whole slice: go on to the next one
            rest = data[at:].translate(_LETTERS)
            end = rest.find(b" ")
            part = rest if end < 0 else rest[: end + 1]
        at += len(part)
        yield part.split()


COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term, by group, and a row without a term for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def hand_on():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for i in range(0, len(terms) + 1, 50_000):
                some = terms[i : i + 50_000]
                first = [None] if i == 0 else []  # the group itself
                k = len(some) + len(first)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * k), pa.array([source] * k), pa.array(first + [t.decode() for t in some], pa.string()),
                    pa.array([0] * len(first) + [n[t] for t in some], pa.int64()), pa.array([0] * len(first) + [docs[t] for t in some], pa.int64()),
                ], schema=COUNTS)
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before, seen = len(n), set()
            for some in words(text):
                n.update(some)
                seen.update(some)
            docs.update(seen)
            size += len(n) - before
            if size > HELD_TERMS:
                yield from hand_on()
                size = 0
    yield from hand_on()
    release()


def count_terms(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs; one row a group has no term."""
    empty = lambda c: F.coalesce(docs[c], F.lit("")).alias(c)
    bound_batches(docs.sparkSession)
    part = docs.select(empty("lang"), empty("source"), empty("text")).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * count / total) for counts up to total, without a product over 64 bits: three digits at a time."""
    rest, out = count, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = p - q
    return gap * gap // (p + q)


PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _block(terms: pa.Table, groups: pa.Table) -> pa.Table:
    """Values of one block: of each pair of groups once, and of the highest terms of each group."""
    groups, terms = groups.sort_by("source"), terms.sort_by("term").combine_chunks()
    lang, sources, kept = groups["lang"][0].as_py(), groups["source"].combine_chunks(), groups["kept"][0].as_py()
    n_groups, n_terms = len(sources), terms.num_rows
    size = groups["size"].to_numpy()
    out = {"source": [], "part": [], "item": [], "value": []}

    def add(part, source, item, value):
        out["source"] += source
        out["item"] += item
        out["value"] += value
        out["part"] += [part] * len(source)

    names = sources.to_pylist()
    if n_terms:
        at = terms["at"].combine_chunks() if isinstance(terms["at"], pa.ChunkedArray) else terms["at"]
        at = at.chunk(0) if isinstance(at, pa.ChunkedArray) else at
        row = np.repeat(np.arange(n_terms), pc.list_value_length(at).to_numpy())
        cells = pc.list_flatten(at)
        column = pc.index_in(cells.field("source"), value_set=sources).to_numpy()
        counts = np.zeros((n_groups, n_terms), np.int64)
        counts[column, row] = cells.field("n").to_numpy()
        p = share(counts + 2, (size + 2 * kept)[:, None])
        whole = terms["n"].to_numpy()
        q = share(whole + 2, int(groups["whole"][0].as_py()) + 2 * kept)
        label = terms["term"].to_pylist()
        own = distance(p, q[None, :])
        own[(counts == 0) | (p <= q[None, :])] = -1
        for g in range(n_groups):
            best = np.argsort(-own[g], kind="stable")[:TOP]  # terms are in order, so equal values are too
            best = best[own[g, best] >= 0]
            add("term", [names[g]] * len(best), [label[t] for t in best], own[g, best].tolist())
    for i in range(0, n_groups, GROUP_TILE):
        for j in range(i, n_groups, GROUP_TILE):
            a, b = slice(i, i + GROUP_TILE), slice(j, j + GROUP_TILE)
            left, right = names[a], names[b]
            total = np.zeros((len(left), len(right)), np.int64)
            step = max(1, BLOCK_CELLS // max(1, total.size))
            for t in range(0, n_terms, step):
                total += distance(p[a, None, t : t + step], p[None, b, t : t + step]).sum(axis=2)
            x, y = np.nonzero(np.arange(i, i + len(left))[:, None] < np.arange(j, j + len(right))[None, :])
            add("pair", [left[k] for k in x], [right[k] for k in y], total[x, y].tolist())
    return pa.table([pa.array([lang] * len(out["value"]), pa.string()), *(pa.array(out[c], PARTS.field(c).type) for c in ("source", "part", "item", "value"))], schema=PARTS)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: every other source of the language by distance, and the group's own highest terms."""
    counts = cut(count_terms(docs), "term-counts")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("at")
    )
    terms = cut(terms.where(F.col("docs") >= least_docs).select("lang", "term", "n", "at"), "kept-terms")
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("whole"))
    sizes = terms.select("lang", F.explode("at").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("size"))
    groups = counts.where("term is null").select("lang", "source")
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_groups")).join(kept, "lang", "left").na.fill(0, ["kept", "whole"])
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK_TERMS), F.expr(f"{BLOCK_CELLS} div n_groups")))
    langs = cut(langs.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") / room)).cast("int")).drop("n_groups"), "languages")
    drop_later = counts
    groups = groups.join(sizes, ["lang", "source"], "left").na.fill(0, ["size"]).join(langs, "lang")
    groups = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    blocks = terms.join(langs.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int")).drop("blocks")
    parts = blocks.groupBy("lang", "block").cogroup(groups.groupBy("lang", "block")).applyInArrow(_block, "lang string, source string, part string, item string, value long")
    parts = cut(parts, "block-values")
    for t in (drop_later, terms, langs):
        drop_cut(t)
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("item").alias("b")), F.struct(F.col("item").alias("a"), F.col("source").alias("b"))))
    pairs = pairs.select("lang", "value", both.alias("x")).select("lang", F.col("x.a").alias("source"), F.lit("pair").alias("part"), F.col("x.b").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order).cast("int"))
    own = ranked(parts.where("part = 'term'")).where(F.col("rank") <= top)
    return ranked(pairs).unionByName(own).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))

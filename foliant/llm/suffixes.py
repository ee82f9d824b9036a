"""Removal of repeated passages by a column-wise suffix construction over many strings.

A passage counts as repeated if LENGTH bytes of it start anywhere else too. Every window of LENGTH bytes has an anchor: the
leftmost of its GRAM-byte strings of least hash. Windows in a row that share an anchor form a piece, and equal windows
have equal anchors at equal places, so only pieces of the same anchor need comparing, aligned at the anchor.

Pieces that are equal as a whole are found by 128-bit digest. Where pieces of one anchor differ, they are sorted column by
column: each round inserts one symbol of every string, from the last column to the first, and updates the order of the
suffixes that start there and the common prefixes of neighbours. After each round, a suffix that shares LENGTH symbols with
a neighbour starts a repeated window. Suffixes of different anchors or columns can share no window, so the transform of
the collection is held as one column at a time, and a round costs the strings' number and not the text so far.

A task sorts GROUP strings of an anchor at most. Where more share one, as around a passage that many documents hold, the
columns where a window can start are halved again and again. The strings of a half are grouped by the bytes that all windows
of that half hold, and those that have become equal count as one, so a passage's inside falls together and its edges part.

Null and empty texts, and texts shorter than LENGTH, lose nothing. Very long texts are read in blocks that overlap by a
window, whole. Rows may repeat: each is a text, so such rows are copies of each other. There are no ties to break: every
one of several equal windows is removed. An empty table gives an empty result. Only the id and the text are read, so other
columns cannot clash.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.base import annotate, bound_batches, cut, drop_cut, field, release, table

LENGTH = 400
GRAM = 64
#: Windows of a text that are hashed at a time.
BLOCK = 1 << 18
#: Strings of one group that a task sorts at most; a group of more is parted.
GROUP = 256
#: Bytes of pieces that a task sorts at a time; whole groups stay together, so there may be GROUP strings more.
SORTED_BYTES = 4 << 20

_U = np.uint64


class Hasher:
    """Polynomial hashes modulo 2 ** 64 of any stretch of a block, from sums of prefixes; odd bases have inverses."""

    def __init__(self, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.symbols = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + rng.integers(0, 2, 256, dtype=np.uint64)
        base = (int(rng.integers(1 << 61, 1 << 62)) << 1) | 1
        self.power = self._powers(base, size)
        self.inverse = self._powers(pow(base, -1, 1 << 64), size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def sums(self, block: np.ndarray) -> np.ndarray:
        out = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(self.symbols[block] * self.power[: len(block)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (sums[end] - sums[start]) * self.inverse[start]
        h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
        return h ^ (h >> _U(29))


_HASHER: list[Hasher] = []


def hasher() -> Hasher:
    """The hash that chooses anchors. Strings that it confuses only meet in a group; they are told apart by their bytes."""
    if not _HASHER:
        _HASHER.append(Hasher(BLOCK + 4 * LENGTH, 11))
    return _HASHER[0]


def digests(strings: list[bytes]) -> np.ndarray:
    """128-bit digests as two longs each."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), np.int64).reshape(-1, 2)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every stretch of so many."""
    n, step, out = len(values) - width + 1, 1, values
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[:n], out[width - step : width - step + n])


def pieces(text: bytes, length: int = LENGTH, gram: int = GRAM):
    """Arrays (anchor, start, size, offset of the anchor) of a text's pieces, block by block."""
    first = hasher()
    for at in range(0, len(text) - length + 1, BLOCK):
        block = np.frombuffer(text, np.uint8)[at : at + BLOCK + length - 1]
        sums = first.sums(block)
        places = np.arange(len(block) - gram + 1)
        grams = first.of(sums, places, places + gram)
        # ordered by the hash's upper bits and then by place, so that the leftmost of equals is least
        least = sliding_least((grams & ~_U(0xFFFFFF)) | places.astype(np.uint64), length - gram + 1)
        anchor_at = (least & _U(0xFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], anchor_at[1:] != anchor_at[:-1]]))
        end = np.append(start[1:], len(anchor_at)) - 1 + length
        where = anchor_at[start]
        yield grams[where].view(np.int64), start + at, end - start, where - start


def _pieces_of(rows, length: int, gram: int):
    """Of several texts: the text's row, anchor, digest, size and offset of each piece, equal ones of a text once; and
    how many of a piece there are, with their starts."""
    out = [[] for _ in range(8)]
    for i, text in enumerate(rows):
        if not text or len(text) * 4 < length or len(raw := text.encode()) < length:
            continue
        anchor, start, size, offset = (np.concatenate(c) for c in zip(*pieces(raw, length, gram), strict=True))
        d = digests([raw[a:b] for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)])
        order = np.lexsort((d[:, 1], d[:, 0]))  # stable, so starts rise among equals
        d = d[order]
        first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]).any(axis=1)]))
        one = order[first]
        columns = np.full(len(first), i), anchor[one], d[first, 0], d[first, 1], size[one], offset[one], np.diff(np.append(first, len(d))), start[order]
        for column, c in zip(out, columns, strict=True):
            column.append(c)
    return [np.concatenate(c) if c else np.empty(0, np.int64) for c in out]


def _cut_texts(length: int, gram: int):
    names = ["k1", "k2", "anchor", "d1", "d2", "size", "offset", "starts"]

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                batch = whole.slice(i, 128)
                row, anchor, d1, d2, size, offset, count, starts = _pieces_of(batch.column(2).to_pylist(), length, gram)
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(starts.astype(np.int32)))
                at = pa.array(row.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(anchor), pa.array(d1), pa.array(d2), pa.array(size.astype(np.int32)), pa.array(offset.astype(np.int32)), listed],
                    names=names,
                )
        release()

    return run


class ColumnSort:
    """Suffixes of many strings, aligned by column, sorted within groups: one symbol of each string is inserted a round."""

    def __init__(self, group: np.ndarray):
        self.group = group
        self.order = np.argsort(group, kind="stable")
        #: Common prefix of each suffix with the one before it in the order; 0 at a group's first.
        self.common = np.zeros(len(group), np.int32)

    def insert(self, symbols: np.ndarray) -> None:
        """Put a symbol before each string's suffix; -1 leaves a string without a suffix in this column."""
        at, n = self.order, len(self.order)
        key = self.group[at] * 257 + symbols[at] + 1
        moved = np.argsort(key, kind="stable")
        new = key[moved]
        same = np.concatenate([[False], (new[1:] == new[:-1]) & (new[1:] % 257 != 0)])
        common = np.zeros(n, np.int32)
        if same.any():
            after = moved[same]
            before = moved[np.flatnonzero(same) - 1]
            common[same] = 1 + self._least(before + 1, after)
        self.order, self.common = at[moved], common

    def _least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least common prefix over each range of places, both ends in it: by minima over powers of two."""
        span = last - first + 1
        out = np.empty(len(span), np.int32)
        level = np.int64(np.log2(span.max())) if len(span) else 0
        power = np.floor(np.log2(span)).astype(np.int64)
        table = self.common
        for k in range(int(level) + 1):
            own = power == k
            if own.any():
                out[own] = np.minimum(table[first[own]], table[last[own] - (1 << k) + 1])
            if k < level:
                table = np.minimum(table[: -(1 << k)], table[1 << k :])
        return out

    def longest(self) -> np.ndarray:
        """For each string, the longest common prefix of its suffix with any other of its group."""
        both = np.maximum(self.common, np.append(self.common[1:], 0))
        out = np.empty(len(both), np.int32)
        out[self.order] = both
        return out


def repeated_windows(group: np.ndarray, strings: list[bytes], offset: np.ndarray, length: int, gram: int) -> np.ndarray:
    """matrix[i, c]: whether the window that starts c columns after the leftmost possible place repeats in i's group."""
    reach = length - gram
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    low = reach - offset  # columns: the anchor stands at column `reach` of all strings
    high = low + sizes
    columns = np.full((2 * reach + gram, len(strings)), -1, np.int16)
    for i, (s, a) in enumerate(zip(strings, low.tolist(), strict=True)):
        columns[a : a + len(s), i] = np.frombuffer(s, np.uint8)
    out = np.zeros((len(strings), reach + 1), bool)
    sort = ColumnSort(group)
    for c in range(2 * reach + gram - 1, -1, -1):
        sort.insert(columns[c].astype(np.int64))
        if c <= reach:
            out[:, c] = (sort.longest() >= length) & (c >= low) & (c + length <= high)
    return out


def _spans(flags: np.ndarray, low: int, length: int) -> list[dict]:
    """Stretches of a string that its repeated windows cover; flags by column, low the string's first column."""
    starts = np.flatnonzero(flags) - low
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > length)
    return [{"a": int(a), "b": int(b) + length} for a, b in zip(starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)], strict=True)]


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _sort_strings(length: int, gram: int):
    """Strings (keys, column of the first byte, bytes) ordered by their group in; spans that others of the group repeat out."""

    def done(rows):
        group = np.unique([r[:2] for r in rows], axis=0, return_inverse=True)[1].ravel()
        low = np.array([r[5] for r in rows], np.int64)
        flags = repeated_windows(group, [r[6] for r in rows], length - gram - low, length, gram)
        # spans of the piece that the string is of, from the place in it where the string starts
        spans = [[{k: v + r[4] for k, v in s.items()} for s in _spans(f, int(r[5]), length)] for f, r in zip(flags, rows, strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3)), pa.array(spans, _SPANS)], names=["d1", "d2", "spans"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size > SORTED_BYTES and r[:2] != held[-1][:2]:
                    yield done(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield done(held)
        held = batch = r = None
        release()

    return run


def _halve(length: int):
    """Strings with the range of columns [a, b] where their windows start in; those of the two halves of the range out."""
    names = [*STRING, "a", "b", "s1", "s2"]

    def run(batches):
        for batch in batches:
            out = []
            for _, _, d1, d2, shift, low, raw, a, b in zip(*(batch.column(c).to_pylist() for c in [*STRING, "a", "b"]), strict=True):
                middle = (a + b) // 2
                for x, y in ((a, middle), (middle + 1, b)):
                    start, end = max(x, low), min(y, low + len(raw) - length)  # of windows
                    if start <= end:
                        part = raw[start - low : end - low + length]
                        core = raw[y - low : x + length - low]  # in every window that starts from x to y
                        out.append((core, d1, d2, shift + start - low, start, part, x, y))
            core, d1, d2, shift, low, part, x, y = zip(*out, strict=True) if out else [()] * 8
            # a group is a range and its core; the digest of a part includes where it starts
            g = digests([b"%d %d " % (p, q) + c for p, q, c in zip(x, y, core, strict=True)])
            s = digests([b"%d " % p + c for p, c in zip(low, part, strict=True)])
            arrays = [g[:, 0], g[:, 1], d1, d2, shift, low, part, x, y, s[:, 0], s[:, 1]]
            types = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()] + [pa.int32()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(arrays, types, strict=True)], names=names)
        release()

    return run


#: Of a string to sort: its group, the piece that it is of, where it starts there, the column of its first byte, its bytes.
STRING = ["g1", "g2", "d1", "d2", "shift", "low", "raw"]
_STRING = "g1 bigint, g2 bigint, d1 bigint, d2 bigint, shift int, low int, raw binary"


def _sorted(strings: DataFrame, length: int, gram: int) -> DataFrame:
    dealt = strings.select(STRING).repartition("g1", "g2").sortWithinPartitions("g1", "g2")
    return dealt.mapInArrow(_sort_strings(length, gram), "d1 bigint, d2 bigint, spans array<struct<a:int,b:int>>").where(F.size("spans") > 0)


def _partly_repeated(strings: DataFrame, length: int, gram: int, group: int) -> list[DataFrame]:
    """Tables (d1, d2, spans) of pieces that share windows with others; strings: STRING and kinds, how many share the group."""
    found = [cut(_sorted(strings.where(F.col("kinds") <= group), length, gram), "spans")]
    more = strings.where(F.col("kinds") > group).withColumns({"a": F.lit(0), "b": F.lit(length - gram)})
    written = None
    while not more.isEmpty():  # a range of one column has equal strings alone, so this ends
        parts = cut(more.mapInArrow(_halve(length), f"{_STRING}, a int, b int, s1 bigint, s2 bigint"), "parts")
        alike = ["g1", "g2", "s1", "s2"]
        distinct = cut(parts.groupBy(alike).agg(F.count("*").alias("n"), F.min(F.struct("d1", "d2")).alias("one")), "distinct")
        groups = cut(distinct.groupBy("g1", "g2").agg(F.count("*").alias("kinds")).where("kinds > 1"), "groups")
        # a part that several pieces have is repeated whole in all of them
        end = (F.col("shift") + F.octet_length("raw")).cast("int")
        span = F.array(F.struct(F.col("shift").alias("a"), end.alias("b"))).alias("spans")
        whole = parts.join(distinct.where("n > 1").select(alike), alike).select("d1", "d2", span)
        # one piece of each such part stands for all of them from here on
        ones = cut(distinct.join(groups, ["g1", "g2"]).select(*alike, "one.d1", "one.d2", "kinds"), "ones")
        left = cut(parts.join(ones, [*alike, "d1", "d2"]).select(*STRING, "a", "b", "kinds"), "strings")
        found.append(cut(whole.unionByName(_sorted(left.where(F.col("kinds") <= group), length, gram)), "spans"))
        for old in (parts, distinct, groups, ones, *([written] if written else [])):
            drop_cut(old)
        written, more = left, left.where(F.col("kinds") > group)
    if written:
        drop_cut(written)
    return found


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(k1, k2, spans): the stretches of each text to remove, as [{a, b}] in bytes, not yet merged; k1, k2 are id and hash."""
    bound_batches(docs.sparkSession)
    keyed = docs.select(docs[f"`{doc_id}`"].alias("k1"), F.xxhash64(docs[f"`{text}`"]).alias("k2"), docs[f"`{text}`"].alias("text"))
    kind = keyed.schema["k1"].dataType.simpleString()
    schema = f"k1 {kind}, k2 bigint, anchor bigint, d1 bigint, d2 bigint, size int, offset int, starts array<int>"
    found = cut(keyed.mapInArrow(_cut_texts(length, gram), schema), "pieces")

    one = F.struct("k1", "k2", F.get("starts", F.lit(0)).alias("start"), "size", "offset").alias("one")
    distinct = found.select("anchor", "d1", "d2", F.size("starts").alias("n"), one)
    distinct = cut(distinct.groupBy("anchor", "d1", "d2").agg(F.sum("n").alias("n"), F.min("one").alias("one")), "distinct")
    mixed = distinct.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    sought = cut(distinct.join(mixed, "anchor").select("anchor", "d1", "d2", "n", "kinds", "one.*"), "sought")

    # the bytes of one of each of the different pieces that share an anchor; the anchor is at column `reach` of all
    wanted = F.struct("anchor", "d1", "d2", "offset", "kinds", "start", "size")
    by_text = sought.groupBy("k1", "k2").agg(F.collect_list(wanted).alias("wanted"))
    same = keyed["k1"].eqNullSafe(by_text["k1"]) & (keyed["k2"] == by_text["k2"])
    strings = keyed.join(by_text, same).select("text", F.explode("wanted").alias("w"))
    raw = F.expr("substring(cast(text as binary), w.start + 1, w.size)").alias("raw")
    low = (F.lit(length - gram) - F.col("w.offset")).alias("low")
    strings = strings.select(F.col("w.anchor").alias("g1"), F.lit(0).cast("long").alias("g2"), "w.d1", "w.d2", F.lit(0).alias("shift"), low, raw, "w.kinds")
    strings = cut(strings.dropDuplicates(["d1", "d2"]), "strings")
    drop_cut(sought)

    partly = _partly_repeated(strings, length, gram, group)
    whole = distinct.where("n > 1").select("d1", "d2", F.array(F.struct(F.lit(0).alias("a"), F.col("one.size").alias("b"))).alias("spans"))
    once = reduce(DataFrame.unionByName, partly).join(distinct.where("n = 1").select("d1", "d2"), ["d1", "d2"], "left_semi")
    # a span or a few for each round and column range of a piece, so a piece's list is bounded by its length
    once = once.groupBy("d1", "d2").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    bad = cut(whole.unionByName(once), "bad")
    for written in (strings, *partly, distinct):
        drop_cut(written)

    met = found.join(bad, ["d1", "d2"]).select("k1", "k2", F.explode("starts").alias("start"), "spans")
    moved = F.transform("spans", lambda s: F.struct((F.col("start") + s["a"]).alias("a"), (F.col("start") + s["b"]).alias("b")))
    # a span for each piece of a text, so a text's list is bounded by its length
    return met.select("k1", "k2", moved.alias("spans")).groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def removal(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row; and kept, the remaining bytes, if asked for."""
    spans = repeats(docs, doc_id, text, length, gram, group)
    keyed = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), F.xxhash64(docs[f"`{text}`"]).alias("h"), docs[f"`{text}`"].alias("text"))
    joined = keyed.join(spans, keyed["doc_id"].eqNullSafe(spans["k1"]) & (keyed["h"] == spans["k2"]), "left")
    rows = joined.select("doc_id", F.struct("text", "spans").alias("work"))

    def make():
        def run(work):
            out = [[], [], [], [], []]
            for w in work:
                raw, cuts, at, left = (w["text"] or "").encode(), merged(w["spans"]), 0, []
                for a, b in cuts:
                    left.append(raw[at:a])
                    at = b
                kept = b"".join([*left, raw[at:]])
                for column, v in zip(out, (len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(v)
            return out if keep_text else out[:4]

        return run

    fields = [field("n_bytes", "long"), field("n_removed", "long"), field("n_spans", "long"), field("kept_sha256", "string")]
    return annotate(rows, make, fields + [field("kept", "binary")] * keep_text, "work", ["doc_id"])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents"))

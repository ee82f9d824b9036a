"""Two tables dealt into the same buckets by a key, one sorted Parquet file for each table and bucket.

A row becomes one byte string that compares as the row sorts, behind the number of the run it goes to. An RDD partitioner
on that number and repartitionAndSortWithinPartitions sort rows in the shuffle; each task then streams its sorted rows into
one Parquet writer after the other. A bucket (or starting file) of more rows than a run is cut into runs at sampled rows, so
that a hot key or a hot group of equal rows is sorted by many tasks; one task streams the runs into the file, which has to be whole.

The second table is matched while it is written: rows of a bucket and the first table's file of that bucket have the same
order, so one pass over both tells rows without a partner and counts the join. No key is broadcast or sent to the driver, which
sees a bounded number of counts: one for each starting file and bucket, and samples of runs.

Order: the key descending, then the other columns left to right ascending; nulls first everywhere, strings by their UTF-8
bytes, NaN last, -0.0 as 0.0. Rows without a key go to the bucket of nulls, in both tables. Repeated rows are all kept. An
empty table has no files. Other columns may have any names. Columns of nested types and decimals raise a ValueError.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.base import release, shared_dir, table

BUCKETS = 150
#: Rows of a run: what a task sorts of one bucket, at least and at most; between them twice the mean bucket. A bucket has so
#: many runs at most; their cuts come from so many samples each.
LEAST_RUN, RUN_ROWS, RUNS, SAMPLES = 20_000, 250_000, 64, 20
#: Rows that are decoded together, and rows of a Parquet row group.
BLOCK_ROWS, GROUP_ROWS = 8192, 65_536

#: Types of columns: Arrow's type, and the unsigned integer that sorts alike.
KINDS = {
    "boolean": (pa.bool_(), "u1"), "tinyint": (pa.int8(), "u1"), "smallint": (pa.int16(), "u2"), "int": (pa.int32(), "u4"), "bigint": (pa.int64(), "u8"),
    "float": (pa.float32(), "u4"), "double": (pa.float64(), "u8"), "date": (pa.date32(), "u4"), "timestamp": (pa.timestamp("us", "UTC"), "u8"),
    "timestamp_ntz": (pa.timestamp("us"), "u8"), "string": (pa.string(), ""), "binary": (pa.binary(), ""),
}


class RowCodec:
    """Rows as bytes: a number of 4 bytes, the columns in order of sorting, then a tail that only decoding needs and a tag of 2 bytes."""

    def __init__(self, kinds: list[str], first: int):
        if bad := [k for k in kinds if k not in KINDS]:
            raise ValueError(f"columns of these types cannot be sorted as bytes: {', '.join(bad)}")
        if kinds[first] not in ("tinyint", "smallint", "int", "bigint", "date", "timestamp", "timestamp_ntz"):
            raise ValueError("the key must be a whole number, a date or a time")
        self.kinds = kinds
        self.order = [first, *(i for i in range(len(kinds)) if i != first)]
        self.floats = [i for i in self.order if kinds[i] in ("float", "double")]
        self.texts = [i for i in self.order if not KINDS[kinds[i]][1]]
        self.mask_bytes = -(-len(self.floats) // 8)
        self.tail = self.mask_bytes + 4 * len(self.texts) + 2

    def _bits(self, i: int, values: pa.Array, n: int):
        """The column as unsigned integers that sort as it does; for floats also where it was -0.0."""
        kind, width = self.kinds[i], KINDS[self.kinds[i]][1]
        if kind in ("float", "double"):
            x = np.array(pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False), copy=True)
            minus = (x == 0) & np.signbit(x)
            x[x == 0] = 0.0
            x[np.isnan(x)] = np.nan
            bits = x.view(width)
            top = np.array(1, width) << np.array(8 * x.itemsize - 1, width)
            return np.where(bits & top, ~bits, bits | top), minus
        if kind == "boolean":
            return pc.fill_null(values, False).to_numpy(zero_copy_only=False).astype("u1"), None
        whole = pa.int64() if width == "u8" else pa.int32() if width == "u4" else values.type
        x = pc.fill_null(values.cast(whole), 0).to_numpy(zero_copy_only=False)
        bits = x.view(width) ^ (np.array(1, width) << np.array(8 * x.itemsize - 1, width))
        return (~bits if i == self.order[0] else bits), None

    def encode(self, columns: list[pa.Array], tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all rows, with the number left 0, and where each row ends."""
        n = len(tags)
        byte = lambda x: np.asarray(x, "u1").reshape(n, 1)
        parts: list = [np.zeros((n, 4), "u1")]
        minus, sizes = [], []
        for i in self.order:
            values = columns[i]
            there = byte(pc.is_valid(values).to_numpy(zero_copy_only=False))
            width = KINDS[self.kinds[i]][1]
            if width:
                bits, zero = self._bits(i, values, n)
                if zero is not None:
                    minus.append(zero)
                parts.append(np.hstack([there, bits.astype(f">{width}").view("u1").reshape(n, -1) * there]))
                continue
            raw = pc.fill_null(values.cast(pa.large_binary()), b"")
            ends = np.frombuffer(raw.buffers()[1], "i8")[raw.offset : raw.offset + n + 1]
            flat = np.frombuffer(raw.buffers()[2] or b"", "u1")[ends[0] : ends[-1]]
            lengths = np.diff(ends)
            if not flat.all():  # a zero byte ends a text, so one inside is followed by 255
                rows = [x.replace(b"\0", b"\0\xff") for x in raw.to_pylist()]
                flat, lengths = np.frombuffer(b"".join(rows), "u1"), np.fromiter(map(len, rows), "i8", n)
            parts += [there, (flat, lengths), np.zeros((n, 1), "u1")]
            sizes.append(lengths.astype(">u4").view("u1").reshape(n, 4))
        if minus:
            parts.append(np.packbits(np.stack(minus, 1), axis=1))
        parts += [*sizes, tags.astype(">u2").view("u1").reshape(n, 2)]
        lengths = sum((p[1] if isinstance(p, tuple) else np.full(n, p.shape[1], "i8")) for p in parts)
        ends = np.cumsum(lengths)
        out, at = np.empty(int(ends[-1]) if n else 0, "u1"), ends - lengths
        for p in parts:
            if isinstance(p, tuple):
                out[_spread(at, p[1])] = p[0]
                at = at + p[1]
            else:
                out[at[:, None] + np.arange(p.shape[1])] = p
                at = at + p.shape[1]
        return out, ends

    def decode(self, keys: list[bytes]) -> tuple[np.ndarray, list[pa.Array], np.ndarray]:
        """The numbers, the columns and the tags of rows."""
        n = len(keys)
        data = np.frombuffer(b"".join(keys), "u1")
        ends = np.cumsum(np.fromiter(map(len, keys), "i8", n))
        start = np.concatenate([[0], ends[:-1]]).astype("i8")
        take = lambda at, w: np.ascontiguousarray(data[at[:, None] + np.arange(w)])
        number = lambda at, kind: take(at, int(kind[1])).view(f">{kind}").ravel().astype(kind)
        tail = ends - self.tail
        minus = np.unpackbits(take(tail, self.mask_bytes), axis=1).astype(bool) if self.floats else None
        at, columns, done = start + 4, [None] * len(self.kinds), {"f": 0, "t": 0}
        for i in self.order:
            kind, width = KINDS[self.kinds[i]]
            gone = data[at] == 0
            if width:
                bits = number(at + 1, width)
                top = np.array(1, width) << np.array(8 * bits.itemsize - 1, width)
                if i in self.floats:
                    x = np.where(bits & top, bits & ~top, ~bits).astype(width).view("f" + width[1])
                    x = np.where(minus[:, done["f"]], np.array(-0.0, x.dtype), x)
                    done["f"] += 1
                    columns[i] = pa.array(x, type=kind, mask=gone)
                elif kind == pa.bool_():
                    columns[i] = pa.array(bits.astype(bool), type=kind, mask=gone)
                else:
                    x = ((~bits if i == self.order[0] else bits) ^ top).astype(width).view("i" + width[1])
                    columns[i] = pa.array(x, mask=gone).cast(kind)
                at = at + 1 + int(width[1])
                continue
            lengths = number(tail + self.mask_bytes + 4 * done["t"], "u4").astype("i8")
            done["t"] += 1
            flat = data[_spread(at + 1, lengths)]
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            got = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype("i8")), pa.py_buffer(flat)])
            if not flat.all():
                got = pa.array([x.replace(b"\0\xff", b"\0") for x in got.to_pylist()], pa.large_binary())
            columns[i] = pc.if_else(pa.array(~gone), got.cast(pa.binary()).cast(kind), pa.scalar(None, kind))
            at = at + lengths + 2
        return number(start, "u4").astype("i8"), columns, number(ends - 2, "u2").astype("i8")


def _spread(at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all bytes of pieces that begin at the given places."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(at - before, lengths) + np.arange(int(lengths.sum()))


def _pack(out: np.ndarray, ends: np.ndarray) -> bytes:
    return len(ends).to_bytes(4, "big") + ends.astype("u8").tobytes() + out.tobytes()


def _unpack(block: bytes) -> list[bytes]:
    n = int.from_bytes(block[:4], "big")
    ends = (np.frombuffer(block, "u8", n, 4) + 4 + 8 * n).tolist()
    return [block[a:b] for a, b in zip([4 + 8 * n, *ends], ends, strict=False)]


@dataclass
class Written:
    """One file, as the task that wrote it reports it."""

    number: int
    path: str
    rows: int = 0
    joined: int = 0
    tags: dict[int, int] = field(default_factory=dict)
    digest: str = ""


class _File:
    """A Parquet file that appears under its name when it is whole, so that a task that runs again or twice does no harm."""

    def __init__(self, number: int, path: str, schema: pa.Schema, key: int):
        self.files, self.path = fs.FileSystem.from_uri(path)
        folder, name = self.path.rsplit("/", 1)
        self.files.create_dir(folder, recursive=True)
        self.hidden, self.key, self.first = f"{folder}/_{uuid.uuid4().hex}-{name}", key, True
        self.writer, self.kept, self.sha = pq.ParquetWriter(self.hidden, schema, filesystem=self.files), [], hashlib.sha256()
        self.about = Written(number, path)

    def add(self, rows: pa.RecordBatch) -> None:
        self.kept.append(rows)
        self.about.rows += rows.num_rows
        text = ",".join(pc.fill_null(rows.column(self.key).cast(pa.string()), "").to_pylist())
        self.sha.update((text if self.first else "," + text).encode())
        self.first = False
        if sum(x.num_rows for x in self.kept) >= GROUP_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.kept:
            self.writer.write_table(pa.Table.from_batches(self.kept), row_group_size=2 * GROUP_ROWS)
            self.kept = []

    def close(self) -> Written:
        self._flush()
        self.writer.close()
        self.files.move(self.hidden, self.path)
        self.about.digest = self.sha.hexdigest()
        return self.about


class _Partners:
    """The keys of a sorted file of the first table, read once from the top beside sorted rows of the second."""

    def __init__(self, path: str | None, key: str):
        self.chunks = self._read(path, key) if path else iter(())
        self.keys, self.counts, self.more = np.empty(0, "i8"), np.empty(0, "i8"), True

    @staticmethod
    def _read(path: str, key: str) -> Iterator[np.ndarray]:
        files, name = fs.FileSystem.from_uri(path)
        with files.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=GROUP_ROWS, columns=[key]):
                yield batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """How often the first table has each of the keys, which descend from call to call."""
        least = keys[-1]
        while self.more and (not len(self.keys) or self.keys[0] >= least):
            chunk = next(self.chunks, None)
            self.more = chunk is not None
            if self.more:
                got, n = np.unique(np.concatenate([chunk, self.keys]), return_inverse=True)
                self.counts = np.bincount(n, np.concatenate([np.ones(len(chunk), "i8"), self.counts])).astype("i8")
                use = (got <= least) | np.isin(got, keys)
                self.keys, self.counts = got[use], self.counts[use]
        if not len(self.keys):
            return np.zeros(len(keys), "i8")
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = np.where(self.keys[at] == keys, self.counts[at], 0)
        self.keys, self.counts = self.keys[self.keys <= least], self.counts[self.keys <= least]
        return found


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system, as both Spark and Arrow take it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(where).toUri()
    return f"{full.getScheme()}://{full.getAuthority() or ''}{full.getPath()}"


def _blocks(rows: DataFrame, codec: RowCodec, first: dict[int, int], cuts: dict[int, list[bytes]]) -> DataFrame:
    """Blocks of encoded rows. rows: the table's columns, then the place a row goes to and its tag. first: the number of
    a place's first run; cuts: the rows at which a place with several runs is cut. Equal rows at equal cuts are dealt in turn."""
    tail = codec.tail

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(i, BLOCK_ROWS)
                *columns, place, tag = batch.columns
                place = place.to_numpy(zero_copy_only=False)
                out, ends = codec.encode(columns, tag.to_numpy(zero_copy_only=False))
                start = np.concatenate([[0], ends[:-1]]).astype("i8")
                number = np.array([first[p] for p in place.tolist()], "i8")
                for k in np.flatnonzero(np.isin(place, list(cuts))).tolist() if cuts else ():
                    row, at = out[start[k] + 4 : ends[k] - tail].tobytes(), cuts[int(place[k])]
                    low, high = bisect_left(at, row), bisect_right(at, row)
                    if low < high:
                        turn += 1
                        low += turn % (high - low + 1)
                    number[k] += low
                out[start[:, None] + np.arange(4)] = number.astype(">u4").view("u1").reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array([_pack(out, ends)], pa.binary())], names=["block"])
        release()

    return rows.toDF(*_places(len(rows.columns))).mapInArrow(run, "block binary")


def _places(n: int) -> list[str]:
    """Names for columns by their place, since a table's own may clash with any other."""
    return [f"c{i}" for i in range(n)]


@dataclass
class _Layout:
    columns: list[str]
    kinds: list[str]
    key: int
    struct: T.StructType

    @staticmethod
    def of(df: DataFrame, key: str) -> _Layout:
        return _Layout(df.columns, [t for _, t in df.dtypes], [c.lower() for c in df.columns].index(key.lower()), df.schema)

    def select(self, df: DataFrame, place: Column, tag: Column) -> DataFrame:
        """The table's columns, the place that a row goes to, and its tag."""
        own = [F.col("`" + c.replace("`", "``") + "`") for c in self.columns]
        return df.select(*own, place.cast("int").alias("__place"), tag.cast("int").alias("__tag"))

    @property
    def schema(self) -> pa.Schema:
        return pa.schema([pa.field(c, KINDS[k][0]) for c, k in zip(self.columns, self.kinds, strict=True)])


def sorted_files(
    rows: DataFrame, layout: _Layout, counts: dict[int, int], folder: str, name: str, partners: dict[int, str] | None = None, partner_key: str = "", strays: str = ""
) -> tuple[list[Written], list[Written]]:
    """Write rows (the columns, the place, the tag) as one sorted file for each place, and tell what was written.

    counts: the rows of each place. partners: files of the first table by place; rows whose key none has then go to files of
    their own in the folder strays, which the second list tells.
    """
    if not counts:
        return [], []
    spark, codec = rows.sparkSession, RowCodec(layout.kinds, layout.key)
    length = min(RUN_ROWS, max(LEAST_RUN, 2 * sum(counts.values()) // len(counts)))
    runs = {p: min(RUNS, -(-n // length)) for p, n in counts.items()}
    first, number = {}, 0
    for p in sorted(runs):
        first[p], number = number, number + runs[p]
    place_of = [p for p in sorted(runs) for _ in range(runs[p])]
    cuts = {}
    if large := [p for p in runs if runs[p] > 1]:
        rows = rows.toDF(*_places(len(rows.columns)))
        place = F.col(rows.columns[-2])
        share = F.element_at(F.create_map(*[F.lit(x) for p in large for x in (p, min(1.0, runs[p] * SAMPLES / counts[p]))]), place)
        found: dict[int, list[bytes]] = {p: [] for p in large}
        some = _blocks(rows.where(place.isin(large)).where(F.rand(7) < share), codec, {p: p for p in large}, {})
        for block in some.collect():  # some RUNS * SAMPLES rows for each large place at most
            for row in _unpack(bytes(block[0])):
                found[int.from_bytes(row[:4], "big")].append(row[4 : -codec.tail])
        for p, got in found.items():
            got.sort()
            cuts[p] = [got[len(got) * j // runs[p]] for j in range(1, runs[p])] if got else []
    # numbers are dealt to partitions, the heaviest first
    parts = max(1, min(number, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(counts.values()) // RUN_ROWS))))
    heap, partition = [(0, i) for i in range(parts)], [0] * number
    for k in sorted(range(number), key=lambda k: -counts[place_of[k]] / runs[place_of[k]]):
        weight, i = heapq.heappop(heap)
        partition[k] = i
        heapq.heappush(heap, (weight + counts[place_of[k]] / runs[place_of[k]], i))
    schema, key = layout.schema, layout.key
    at = lambda p: f"{folder}/{name}-{p:05d}.parquet"

    def write(pairs: Iterable[tuple[bytes, None]]) -> Iterator[tuple[bool, Written]]:
        now = file = stray = partner = None

        def close():
            for kind, f in ((False, file), (True, stray)):
                if f:
                    yield kind, f.close()

        rest = iter(pairs)
        while keys := [k for k, _ in islice(rest, BLOCK_ROWS)]:
            numbers, columns, tags = codec.decode(keys)
            batch = pa.RecordBatch.from_arrays(columns, schema=schema)
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:], strict=False):
                if numbers[a] != now:
                    yield from close()
                    now, file, stray = int(numbers[a]), None, None
                    p = place_of[now]
                    partner = _Partners(partners[p], partner_key) if partners and p in partners else None
                part, tag = batch.slice(a, b - a), tags[a:b]
                if partners is not None and p < BUCKETS:
                    n = partner.count(part.column(key).cast(pa.int64()).to_numpy(zero_copy_only=False)) if partner else np.zeros(b - a, "i8")
                    if not n.all():
                        stray = stray or _File(now, f"{strays}/{now:05d}.parquet", schema, key)
                        _count(stray, part.filter(pa.array(n == 0)), tag[n == 0])
                        part, tag, n = part.filter(pa.array(n > 0)), tag[n > 0], n[n > 0]
                    joined = int(n.sum())
                else:
                    joined = 0
                if part.num_rows:
                    file = file or _File(now, at(p) if runs[p] == 1 else f"{folder}/runs/{name}-{now:05d}.parquet", schema, key)
                    file.about.joined += joined
                    _count(file, part, tag)
        yield from close()
        release()

    sorted_rows = (
        _blocks(rows, codec, first, cuts).rdd.flatMap(lambda block: [(k, None) for k in _unpack(bytes(block[0]))])
        .repartitionAndSortWithinPartitions(parts, lambda k: partition[int.from_bytes(k[:4], "big")])
    )
    told = sorted_rows.mapPartitions(write).collect()  # as many rows as files
    stray = [w for is_stray, w in told if is_stray]
    whole = [w for is_stray, w in told if not is_stray]
    pieces: dict[int, list[Written]] = {}
    for w in sorted(whole, key=lambda w: w.number):
        pieces.setdefault(place_of[w.number], []).append(w)
    ready = [_named(p, ws[0]) for p, ws in pieces.items() if runs[p] == 1]
    if long := [(p, ws) for p, ws in pieces.items() if runs[p] > 1]:
        ready += spark.sparkContext.parallelize(long, len(long)).map(lambda x: _joined(x[0], x[1], at(x[0]), schema, key)).collect()
    return ready, stray


def _count(file: _File, rows: pa.RecordBatch, tags: np.ndarray) -> None:
    file.add(rows)
    for t, n in zip(*np.unique(tags, return_counts=True), strict=True):
        file.about.tags[int(t)] = file.about.tags.get(int(t), 0) + int(n)


def _named(place: int, w: Written) -> Written:
    w.number = place
    return w


def _joined(place: int, runs: list[Written], path: str, schema: pa.Schema, key: int) -> Written:
    """Runs of one place as one file, streamed."""
    out = _File(place, path, schema, key)
    for w in runs:
        files, name = fs.FileSystem.from_uri(w.path)
        with files.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=GROUP_ROWS):
                out.add(batch.cast(schema))
        out.about.joined += w.joined
        for t, n in w.tags.items():
            out.about.tags[t] = out.about.tags.get(t, 0) + n
    done = out.close()
    release()
    return done


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of a key; nulls have one of their own, behind that of rows without a partner."""
    return F.when(key.isNull(), buckets + 1).otherwise(F.crc32(F.concat(F.lit("pair"), key.cast("string")).cast("binary")) % buckets).cast("int")


def _start(df: DataFrame, layout: _Layout, bucket: Column, number: Column, folder: str) -> list[Written]:
    """The table's starting files: rows by number, each tagged with its bucket."""
    counts = {p: n for p, n in df.groupBy(number.cast("int")).count().collect()}
    return sorted_files(layout.select(df, number, bucket), layout, counts, folder, "start")[0]


def _again(spark: SparkSession, files: list[Written], layout: _Layout, place: Column) -> DataFrame:
    """Rows of starting files with their place and the number of their file as tag."""
    rows = spark.read.schema(layout.struct).parquet(*[w.path for w in files])
    return layout.select(rows, place, F.regexp_extract(F.input_file_name(), r"start-(\d+)\.parquet$", 1))


def _tally(files: list[Written]) -> tuple[dict[tuple[int, int], int], dict[int, int]]:
    """Rows by (starting file, bucket) and by bucket, from starting files."""
    pairs = {(w.number, b): n for w in files for b, n in w.tags.items()}
    totals: dict[int, int] = {}
    for (_, b), n in pairs.items():
        totals[b] = totals.get(b, 0) + n
    return pairs, totals


def _final(name: str, layout: _Layout, start: list[Written], final: list[Written], joined: dict[int, int], stays: dict[int, Written]) -> list[tuple]:
    out = []
    for w in sorted(final, key=lambda w: w.number):
        kept = stays.get(w.number)
        lineage = ",".join(f"{s}:{n}" for s, n in sorted(w.tags.items()) if n)
        path, digest = (kept.path, kept.digest) if kept else (w.path, w.digest)
        out.append((name, path, ",".join(layout.columns), w.number, w.rows, joined.get(w.number, 0), kept is None, digest, hashlib.sha256(lineage.encode()).hexdigest()))
    return out


RESULT = "table_name string, path string, columns string, bucket long, n_rows long, n_joined long, rewritten boolean, ids_sha256 string, lineage_sha256 string"


def co_bucket(first: DataFrame, second: DataFrame, key: str, first_start: Column, second_start: Column, names: tuple[str, str], folder: str) -> DataFrame:
    """Write both tables into starting files by the given numbers, then as bucket files; a row for each file that is left.

    A starting file that holds just a bucket's rows stays as that bucket's file. Whatever else was written is deleted.
    """
    spark = first.sparkSession
    a, b = _Layout.of(first, key), _Layout.of(second, key)
    folders = [f"{folder}/{n}" for n in names]
    bucket = bucket_of(F.col(f"`{key}`"))
    start_a = _start(first, a, bucket, first_start, folders[0])
    start_b = _start(second, b, bucket, second_start, folders[1])

    # the first table: which files stay is known from the starting files' counts alone
    pairs, totals = _tally(start_a)
    stays_a = {t: w for w in start_a for t, n in w.tags.items() if n == w.rows == totals[t]}
    moved = [w for w in start_a if not (len(w.tags) == 1 and next(iter(w.tags)) in stays_a)]
    counts = {t: n for t, n in totals.items() if t not in stays_a}
    done_a = sorted_files(_again(spark, moved, a, bucket), a, counts, folders[0], "bucket")[0] if moved else []
    done_a += [Written(t, w.path, w.rows, 0, {w.number: w.rows}, w.digest) for t, w in stays_a.items()]

    # the second: rows without a partner are known once a bucket has been matched, and are then a bucket of their own
    partners = {w.number: w.path for w in done_a if w.number < BUCKETS}
    _, totals = _tally(start_b)
    done_b, strays = sorted_files(_again(spark, start_b, b, bucket), b, totals, folders[1], "bucket", partners, a.columns[a.key], f"{folder}/strays") if start_b else ([], [])
    joined = {w.number: w.joined for w in done_b if w.number < BUCKETS}
    if strays:
        done_b += _strays(spark, strays, b, folders[1])
    by_number = {w.number: w for w in start_b}
    stays_b = {w.number: by_number[s] for w in done_b if len(w.tags) == 1 for s in w.tags if by_number[s].rows == w.rows}

    rows = _final(names[0], a, start_a, done_a, joined, stays_a) + _final(names[1], b, start_b, done_b, joined, stays_b)
    _clean(folder, {r[1] for r in rows})
    return spark.createDataFrame(rows, RESULT)


def _strays(spark: SparkSession, strays: list[Written], layout: _Layout, folder: str) -> list[Written]:
    """Rows without a partner, from the files that the buckets' tasks left, as the file of one more bucket."""
    tags: dict[int, int] = {}
    for w in strays:
        for t, n in w.tags.items():
            tags[t] = tags.get(t, 0) + n
    rows = layout.select(spark.read.schema(layout.struct).parquet(*[w.path for w in strays]), F.lit(BUCKETS), F.lit(0))
    done = sorted_files(rows, layout, {BUCKETS: sum(w.rows for w in strays)}, folder, "bucket")[0]
    for w in done:
        w.tags = tags
    return done


def _clean(folder: str, keep: set[str]) -> None:
    files, top = fs.FileSystem.from_uri(folder)
    known = {fs.FileSystem.from_uri(p)[1] for p in keep}
    if files.get_file_info(top).type == fs.FileType.NotFound:
        return
    found = files.get_file_info(fs.FileSelector(top, recursive=True))
    for x in found:
        if x.type == fs.FileType.File and x.path not in known:
            files.delete_file(x.path)
    for x in sorted((x.path for x in found if x.type == fs.FileType.Directory), key=len, reverse=True):
        if not files.get_file_info(fs.FileSelector(x, recursive=True)):
            files.delete_dir(x)


def op11_co_bucketed_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales, lines = table(spark, sf_dir, "sales"), table(spark, sf_dir, "sale_lines")
    bucket = bucket_of(F.col("sale_id"))
    item = F.coalesce(F.crc32(F.col("item_id").cast("string").cast("binary")) % BUCKETS, F.lit(0))
    folder = f"{qualified(spark, shared_dir(spark))}/pair-{uuid.uuid4().hex}"
    return co_bucket(sales, lines, "sale_id", F.when(bucket % 5 == 1, bucket - 1).otherwise(bucket), item, ("sales", "sale_lines"), folder)

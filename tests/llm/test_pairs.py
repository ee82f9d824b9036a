"""Operator 11 beside plain Python."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from datetime import date, datetime
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from foliant.llm import pairs

SALES = "sale_id long, status string, total double, at timestamp_ntz"
LINES = "sale_id long, item_id long, flag string, amount double, day date"
RANDOM = random.Random(5)
TIMES = [None, datetime(2024, 1, 1), datetime(2024, 5, 1, 3, 4, 5, 678901), datetime(1969, 1, 1)]


def sales():
    texts = [None, "", "a", "a\0b", "a\0", "é", "zz", "a b"]
    rows = [(RANDOM.randrange(-20, 300), RANDOM.choice(texts), RANDOM.choice([None, 0.0, 1.5, -2.0, math.inf]), RANDOM.choice(TIMES)) for _ in range(400)]
    return rows + rows[:9] + [(None, "x", 1.0, None), (2**62, "big", -0.5, None), (-(2**62), "small", 0.5, None)]


def lines():
    row = lambda k: (k, RANDOM.choice([None, *range(40)]), RANDOM.choice([None, "kept", "x"]), RANDOM.choice([None, 2.0, -3.25]), RANDOM.choice([None, date(2024, 2, 3)]))
    return [row(RANDOM.randrange(-20, 420)) for _ in range(1500)] + [row(7) for _ in range(900)] + [(7, 1, "same", 1.0, None)] * 700 + [row(None) for _ in range(20)]


def in_order(row):
    value = lambda v: v.encode() if isinstance(v, str) else v
    return ((0, 0) if row[0] is None else (1, -row[0]), *((0,) if v is None else (1, value(v)) for v in row[1:]))


def expect(first, second):
    """By table name and bucket: rows in order, rows by starting file, joined rows, whether a starting file stays."""
    known = Counter(r[0] for r in first if r[0] is not None)
    bucket = lambda k: pairs.BUCKETS + 1 if k is None else crc32(f"pair{k}".encode()) % pairs.BUCKETS
    start = lambda b: b - 1 if b % 5 == 1 else b
    joined, out = Counter(), {}
    for r in second:
        if r[0] in known:
            joined[bucket(r[0])] += known[r[0]]
    for name, rows in (("sales", first), ("sale_lines", second)):
        by, sizes = defaultdict(list), Counter()
        for r in rows:
            b = bucket(r[0]) if name == "sales" or r[0] is None or r[0] in known else pairs.BUCKETS
            s = start(bucket(r[0])) if name == "sales" else 0 if r[1] is None else crc32(str(r[1]).encode()) % pairs.BUCKETS
            by[b].append((r, s))
            sizes[s] += 1
        for b, got in by.items():
            tags = Counter(s for _, s in got)
            stays = len(tags) == 1 and sizes[next(iter(tags))] == len(got)
            out[name, b] = sorted((r for r, _ in got), key=in_order), tags, joined[b], stays
    return out


def run(spark, first, second, folder):
    bucket = pairs.bucket_of(F.col("sale_id"))
    item = F.coalesce(F.crc32(F.col("item_id").cast("string").cast("binary")) % pairs.BUCKETS, F.lit(0))
    return pairs.co_bucket(first, second, "sale_id", F.when(bucket % 5 == 1, bucket - 1).otherwise(bucket), item, ("sales", "sale_lines"), folder).collect()


@pytest.mark.parametrize("run_rows", [100, 250_000])
def test_files_rows_and_digests(spark, tmp_path, monkeypatch, run_rows):
    monkeypatch.setattr(pairs, "RUN_ROWS", run_rows)  # a hot sale and equal rows in many runs, or each bucket in one
    first, second = sales(), lines()
    got = run(spark, spark.createDataFrame(first, SALES).repartition(3), spark.createDataFrame(second, LINES).repartition(5), f"file://{tmp_path}")
    want = expect(first, second)
    assert {(r.table_name, r.bucket) for r in got} == set(want)
    for r in got:
        rows, tags, joined, stays = want[r.table_name, r.bucket]
        file = pq.read_table(r.path.removeprefix("file://"))
        assert list(zip(*(c.to_pylist() for c in file.columns), strict=True)) == rows
        assert r.columns == ",".join(file.column_names)
        assert r.ids_sha256 == hashlib.sha256(",".join("" if x[0] is None else str(x[0]) for x in rows).encode()).hexdigest()
        assert r.lineage_sha256 == hashlib.sha256(",".join(f"{s}:{n}" for s, n in sorted(tags.items())).encode()).hexdigest()
        assert (r.n_rows, r.n_joined, r.rewritten) == (len(rows), joined, not stays)
    files = {str(p) for p in tmp_path.rglob("*") if p.is_file()}
    assert files == {r.path.removeprefix("file://") for r in got}
    assert any(not r.rewritten for r in got)


def test_a_starting_file_stays_under_another_number(spark, tmp_path):
    """All rows of one bucket lie in one starting file, whatever its number, and nothing else does."""
    second = [(5, 3, "a", 1.0, None), (5, 3, "b", 1.0, None)]
    got = run(spark, spark.createDataFrame([(5, "s", 1.0, None)], SALES), spark.createDataFrame(second, LINES), f"file://{tmp_path}")
    line = next(r for r in got if r.table_name == "sale_lines")
    assert not line.rewritten and line.path.endswith(f"start-{crc32(b'3') % 150:05d}.parquet") and line.n_joined == 2


def test_empty_tables_and_odd_columns(spark, tmp_path):
    first, second = spark.createDataFrame([], SALES), spark.createDataFrame([(1, 2, "a", 1.0, None), (None, None, None, None, None)], LINES)
    assert run(spark, first, spark.createDataFrame([], LINES), f"file://{tmp_path}/a") == []
    odd = second.withColumns({"__place": F.lit("x"), "__tag": F.lit(True), "file.na`me": F.lit(b"\0\1"), "c0": F.lit("y"), "block": F.lit(3).cast("short")})
    got = run(spark, first, odd, f"file://{tmp_path}/b")
    assert {(r.bucket, r.n_rows, r.n_joined) for r in got} == {(150, 1, 0), (151, 1, 0)}
    with pytest.raises(ValueError, match="sorted as bytes"):
        run(spark, first, second.withColumn("list", F.array(F.lit(1))), f"file://{tmp_path}/c")


def test_codec_keeps_values_and_order():
    kinds = ["bigint", "double", "string", "boolean", "timestamp_ntz", "float", "binary", "smallint"]
    values = [
        [3, None, -(2**63), 2**63 - 1, 0, 3], [0.0, -0.0, math.inf, None, -1e300, -0.0], ["", "a\0", "a", None, "é", ""], [True, None, False, True, None, True],
        [0, None, -5, 10**15, 7, 0], [1.5, -0.0, None, 0.0, -2.5, 1.5], [b"", b"\0\0", b"\xff", None, b"x", b""], [1, -1, None, 2**15 - 1, -(2**15), 1],
    ]
    columns = [pa.array(v, pairs.KINDS[k][0]) for v, k in zip(values, kinds, strict=True)]
    codec = pairs.RowCodec(kinds, 0)
    out, ends = codec.encode(columns, np.arange(6))
    keys = [out[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    _, back, tags = codec.decode(keys)
    assert [c.to_pylist() for c in back] == [c.to_pylist() for c in columns] and tags.tolist() == list(range(6))
    assert [math.copysign(1, x) for x in back[1].to_pylist() if x == 0] == [1, -1, -1]
    assert sorted(range(6), key=lambda i: keys[i])[:2] == [1, 3]  # the row without a key, then the greatest


def test_partners_are_counted_over_chunks(monkeypatch):
    chunks = [np.array([9, 9, 8]), np.array([8, 8, 8]), np.array([8, 5]), np.array([1, 0])]
    monkeypatch.setattr(pairs._Partners, "_read", staticmethod(lambda path, key: iter(chunks)))
    partner = pairs._Partners("somewhere", "k")
    assert partner.count(np.array([10, 9, 8])).tolist() == [0, 2, 5]
    assert partner.count(np.array([8, 8, 6])).tolist() == [5, 5, 0]
    assert partner.count(np.array([5, 1, 1, -3])).tolist() == [1, 1, 1, 0]

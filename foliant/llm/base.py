"""Helpers that the training-data operators share: tables, written cuts, and Arrow passes over texts."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of an Arrow batch that are worked on at a time, so that long texts do not pile up in a Python worker.
SLICE_ROWS = 512
#: Rows of an Arrow batch at most. Spark's own bound of 10,000 lets whole texts fill some hundred MB outside the heap.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary folder where it is unset (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="foliant-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, so that a lost executor repeats none of what led to it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._foliant_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete a table written by cut() that nothing reads any more."""
    path = getattr(df, "_foliant_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound of rows in an Arrow batch to BATCH_ROWS, if it is higher."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Give what a Python worker has freed back to the system: it may idle beside other work of the executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def annotate(
    df: DataFrame,
    make: Callable[[], Callable[[list], Sequence]],
    fields: Iterable[T.StructField],
    text: str = "text",
    carry: Sequence[str] | None = None,
    done: Callable[[], None] | None = None,
) -> DataFrame:
    """Append columns that a Python function computes from the text column.

    make() is called once in each task and returns f(list of str or None) -> one list of values for each field; done() is
    called when the task has no more rows, to forget what only it needed.
    carry names the input columns to keep (all by default). A result column replaces an input column of the same
    name, in any case of letters; an empty table gives an empty result.
    """
    fields = list(fields)
    new = {f.name.lower() for f in fields}
    carry = [c for c in (df.columns if carry is None else carry) if c.lower() not in new]
    again = [] if text in carry else [df[f"`{text}`"].alias("__text")]  # a carried text is not sent twice
    at = carry.index(text) if text in carry else len(carry)
    source = df.select(*[df[f"`{c}`"] for c in carry], *again)
    schema = T.StructType([*(df.schema[c] for c in carry), *fields])
    target = pa.schema([_arrow_field(f) for f in fields])

    def run(batches):
        f = make()
        for whole in batches:
            for i in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(i, SLICE_ROWS)
                got = f(batch.column(at).to_pylist())
                arrays = [batch.column(k) for k in range(len(carry))]
                arrays += [pa.array(v, type=t.type) for v, t in zip(got, target, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*carry, *target.names])
        whole = batch = got = arrays = f = None
        if done:
            done()
        release()

    bound_batches(df.sparkSession)
    return source.mapInArrow(run, schema)


def _arrow_field(f: T.StructField) -> pa.Field:
    return pa.field(f.name, _arrow_type(f.dataType))


def _arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow_type(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([_arrow_field(f) for f in t.fields])
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[
        t.simpleString()
    ]


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if kind.startswith(("array", "struct")) else {
        "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(),
    }[kind])


def ascii_lower(text):
    """Lower-case A-Z and nothing else. lower() is the quick way and the same for texts of ASCII alone."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, upper, upper.lower())).otherwise(F.lower(text))


#: Characters that separate words for the operators that read words as [0-9a-z] and everything from U+0080 on.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def normal_words(text):
    """The words of a text, lower-cased in A-Z, with one space between; empty if null or without a word."""
    return F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))


#: A word in a text as it stands, before A-Z is lower-cased.
WORD = "[0-9A-Za-z\\x80-\\x{10FFFF}]+"


def count_words(text):
    """Words of a text, without making the text that normal_words() gives; 0 if null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fold(column, mod: int):
    """crc32 of the id as text, modulo mod; null ids count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % mod

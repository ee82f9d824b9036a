"""Work in Python on a row at a time, in which a row that fails becomes a row that says so, and the others stay as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of an error that are kept, and rows of a task where work on a row takes long.
ERROR_CHARS, TASK_ROWS = 500, 4000


def dealt(rows: DataFrame, key: list[str], per_task: int = TASK_ROWS) -> DataFrame:
    """rows dealt by key into tasks of some number of rows, for a table whose few bytes would make few tasks though each row is much work.

    The rows are counted first, which a scan does from its files' footers."""
    n = rows.count()
    return rows.repartition(max(1, -(-n // per_task)), *key)


def each(rows: DataFrame, work: Callable[[object], list[tuple]], schema: str, key: list[str]) -> DataFrame:
    """What work() gives for each row (tuples of the schema's columns), with error null; for a row that it fails on, one row with
    its key columns and the error, all else null. schema must have the key columns. Only a killed worker fails the query. Batches
    are bounded by Spark's spark.sql.execution.arrow.maxBytesPerBatch, whatever a row holds."""
    names = T.StructType.fromDDL(schema).names
    place = [names.index(k) for k in key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            out: list[tuple] = []
            for row in some.itertuples(index=False):
                try:
                    out += [(*x, None) for x in work(row)]
                except Exception as e:  # whatever it is, the other rows must not suffer from it
                    failed = [None] * len(names)
                    for k, i in zip(key, place, strict=True):
                        failed[i] = getattr(row, k)
                    out.append((*failed, f"{type(e).__name__}: {e}"[:ERROR_CHARS]))
            yield pd.DataFrame(out, columns=[*names, "error"], dtype=object)

    return rows.mapInPandas(run, f"{schema}, error string")


def parted(results: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write the results of each() once below path, and give what succeeded and the dead letters, both without empty columns.

    The work is done once, whatever is done with either table afterwards; dead letters stay below path/failed=true.
    """
    spark = results.sparkSession
    results.withColumn("failed", F.col("error").isNotNull()).write.mode("overwrite").partitionBy("failed").parquet(path)
    back = spark.read.schema(T.StructType([*results.schema.fields, T.StructField("failed", T.BooleanType())])).parquet(path)
    return back.where("failed = false").drop("error", "failed"), back.where("failed = true").drop("failed")

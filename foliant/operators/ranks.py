"""Ranks over a whole table, or over groups of any size, without one task that sorts them all."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(rows: DataFrame, order: Sequence[Column], within: Sequence[str] = (), name: str = "rank", keep=None) -> DataFrame:
    """rows with a rank from 1 in the given order, anew in each group of the columns within.

    Rows are sorted by range over (within, order), so a large group lies in many ranges; a rank is the rank in the range plus the
    rows that the ranges before hold of the group. Only counts by range and group meet. Ties get ranks of their own, in no
    stated order. keep(df) writes a table and reads it back, so that rows stay in the ranges they were counted in; by
    default a checkpoint in spark.checkpoint.dir does this.
    """
    part = f"__part_{uuid.uuid4().hex[:8]}"
    groups = [F.col(f"`{c}`") for c in within]
    dealt = rows.repartitionByRange(*[g.asc_nulls_first() for g in groups], *order).withColumn(part, F.spark_partition_id())
    dealt = (keep or checkpointed)(dealt)
    counts = dealt.groupBy(part, *groups).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    local = F.row_number().over(Window.partitionBy(part, *groups).orderBy(*order))
    local = dealt.withColumn("__local", local).alias("l")
    offsets = offsets.alias("o")
    same = F.col(f"l.{part}") == F.col(f"o.{part}")
    for c in within:
        same = same & F.col(f"l.`{c}`").eqNullSafe(F.col(f"o.`{c}`"))
    out = [F.col(f"l.`{c}`") for c in rows.columns]
    return local.join(offsets, same).select(*out, (F.col("l.__local") + F.col("o.__before")).cast("long").alias(name))


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table of its own in the folder that the session names: wide rows take less room there than in a checkpoint."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or "file:///tmp/foliant-checkpoints"
    where = f"{shared.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names; a folder of its own is set only where it names none."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "") or "/tmp/foliant-checkpoints"
        context.setCheckpointDir(where)
    return df.checkpoint()

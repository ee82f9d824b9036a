"""Indel similarity of strings (a substitution costs two) and the score of one excerpt against another."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from foliant.functions.text import ARTICLE, BLANK, REFS, TOC


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of the longer string at a time."""
    if len(a) < len(b):
        a, b = b, a
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        u = rows & places.get(c, 0)
        rows = (rows + u | rows - u) & full
    return len(a) - rows.bit_count()


def ratio(a: str, b: str) -> float:
    """2 * common_length / total length; 1 for two empty strings."""
    return 1.0 if a == b else 2.0 * common_length(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)


def page_score(mine: str, other: str) -> Column:
    """Score of two excerpts of one page, given as names of struct columns: 0 if their types differ.

    Only texts that count are compared: those of other types are empty on both sides, which costs nothing.
    """
    kind = F.col(f"{mine}.page_type")
    same = kind == F.col(f"{other}.page_type")

    def compared(name: str, of: int) -> Column:
        text = lambda side: F.when(same & (kind == of), F.coalesce(F.col(f"{side}.{name}"), F.lit(""))).otherwise("")
        return indel_ratio(text(mine), text(other))

    unknown = F.raise_error(F.concat(F.lit("unknown page type "), kind.cast("string"))).cast("double")
    return (
        F.when(~same, 0.0)
        .when(kind == BLANK, 1.0)
        .when(kind == ARTICLE, compared("title", ARTICLE) * compared("authors", ARTICLE))
        .when(kind == REFS, compared("refs", REFS))
        .when(kind == TOC, compared("toc", TOC))
        .otherwise(unknown)
    )


def register(spark: SparkSession) -> None:
    """Make indel_ratio(a, b) a function of the session's SQL."""
    spark.udf.register("indel_ratio", indel_ratio)

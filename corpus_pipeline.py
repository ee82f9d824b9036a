"""A corpus from raw documents to token digests: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs, in their order
and under their names, whatever these are beside doc_id, text, lang and n_chars. An empty table gives an empty table. Texts
are read whole. Rows may repeat and may have a null in any column; each stage says what becomes of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, decontaminate, langid, secrets, shingles
from foliant.llm.base import shared_dir, table

#: Near copies: texts whose sets of shingles of so many words have so large a Jaccard similarity at least.
NEAR_WORDS, NEAR_LEAST = 5, 0.8


def _as_before(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[f"`{c}`" for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the models are learned from these documents' own lang.

    Null and empty texts and texts without a letter have no language and go, and so does every text if no row has a lang.
    Of languages that score alike the first by name counts. Repeated rows are judged each, alike; a null doc_id or lang is kept.
    """
    found = langid.identify(docs, langid.fit(docs), prefix="__langid_")
    return _as_before(found.where(~F.col("__langid_rejected")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group that near copies link.

    Null, empty and wordless texts are copies of each other. Rows without a doc_id come after those with one, and of rows
    that tie the least hash of id and text stays; of rows that repeat an id and a text one stays.
    """
    return shingles.one_of_each(docs, NEAR_LEAST, NEAR_WORDS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate.

    Null and wordless texts stay. Rows that share a doc_id, or have none, are judged each by its text; repeated rows alike.
    """
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts replaced by a mark; n_chars, if there, follows the text.

    Null texts and their n_chars stay null; repeated rows are rewritten alike; spans that overlap become one mark.
    """
    clean = secrets.redacted(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))
    return _as_before(clean, docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of their decoding, a row for each document.

    Null texts count as empty; repeated rows and null ids come back each.
    """
    return bpe.digest(docs.select("doc_id", "text"), bpe.vocabulary(), carry=["doc_id"])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("encoding", encoding),
]

#: SQL cannot express the models, the hashes of shingles or the encoding; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    where = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{where}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

"""Pages as they come from the network, turned into messages for the finisher by the batch code."""

from __future__ import annotations

from pyspark.ml.classification import DecisionTreeClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.text import page_id_parts
from foliant.plans.extraction import extract, quarantined
from foliant.sources.hocr import WORD

#: A page and its regions, as the source of the stream holds them.
PAGE = "page_id string, found array<struct<label:int,ith:int,confidence:double,x0:int,y0:int,x1:int,y1:int,width:int,height:int>>"
#: Files of a batch at most, so that a backlog does not come all at once.
FILES = 8


def source(spark: SparkSession, path: str, files: int = FILES) -> DataFrame:
    """A stream of pages from a folder of JSON lines, so many files at a time."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", files).json(path)


def continued(excerpts: DataFrame, seq: int) -> DataFrame:
    """Excerpts as messages that the finisher reads."""
    page = [F.col(c) for c in ("page_id", "page_number", "page_type", "title", "authors", "refs", "toc")]
    return excerpts.select("journal_id", "issue_id", F.lit("continue").alias("state"), F.lit(-1).alias("page_count"), F.lit(seq).cast("long").alias("seq"), *page)


#: Folders over which words are laid out by their issue.
WORD_PARTS = 1024


class WordStore:
    """Words of issues on disk, laid out so that a batch reads only the folders of its own issues.

    Words lie in folders by the hash of their issue, sorted by issue and page in each, so that within a folder Parquet's own
    statistics leave out most of what other issues have.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = WORD_PARTS):
        self.spark, self.path, self.parts, self.table = spark, path, parts, None

    def _part(self):
        return F.pmod(F.xxhash64("issue_id"), F.lit(self.parts)).cast("int")

    def write(self, words: DataFrame) -> None:
        """Lay out words (as the hocr source gives them); what was there goes."""
        own = [c.split()[0] for c in WORD.split(", ")]
        dealt = words.select(*own, self._part().alias("part")).repartition("part").sortWithinPartitions("part", "issue_id", "page", "line_no")
        dealt.write.mode("overwrite").partitionBy("part").parquet(self.path)
        self.table = None

    def of(self, pages: DataFrame) -> DataFrame:
        """Words of the issues that pages (page_id) belong to. The driver sees numbers of folders, as many as there are at most."""
        issues = pages.select(page_id_parts(F.col("page_id"))["issue_id"].alias("issue_id")).where("issue_id is not null")
        parts = [r[0] for r in issues.select(self._part().alias("part")).distinct().collect()]
        if self.table is None:  # folders are listed once, not in each batch
            self.table = self.spark.read.schema(f"{WORD}, part int").parquet(self.path)
        return self.table.where(F.col("part").isin(parts)).drop("part").join(issues.distinct(), "issue_id", "left_semi")


def write_messages(pages: DataFrame, words: DataFrame | WordStore, model: DecisionTreeClassificationModel, path: str, checkpoint: str, rejects: str | None = None, **trigger):
    """Start a query that writes a message for each page below path. Progress counts pages and regions, as `pages`.

    words: a small table, or a store, of which each batch reads its own issues. Pages that cannot be used whole are named
    with the reason below rejects, if given.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        found = batch.select("page_id", F.explode("found").alias("r")).select("page_id", "r.*")
        own = words.of(batch) if isinstance(words, WordStore) else words
        out = continued(extract(batch.select("page_id"), found, own, model), epoch)
        out.write.mode("overwrite").json(f"{path}/epoch={epoch}")
        if rejects:
            quarantined(batch, found).write.mode("overwrite").json(f"{rejects}/epoch={epoch}")
        batch.unpersist()

    counted = pages.observe("pages", F.count("*").alias("n"), F.sum(F.size("found")).alias("n_regions"))
    return counted.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"processingTime": "1 second"}).start()

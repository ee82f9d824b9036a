import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import page_model
from foliant.plans import extraction as ex

ISSUE = "sim_j_2004_1"
WORD = "issue_id string, page int, line_no int, word_no int, text string, x0 int, y0 int, x1 int, y1 int"
FOUND = "page_id string, label int, ith int, confidence double, x0 int, y0 int, x1 int, y1 int, width int, height int"


def page_id(n):
    return f"{ISSUE}_{n:04d}"


@pytest.fixture(scope="module")
def inputs(spark):
    pages = spark.createDataFrame([(page_id(n),) for n in range(4)] + [("odd",)], "page_id string")
    found = [(page_id(0), 4, 0, 0.9, 0, 0, 90, 20, 100, 100), (page_id(1), 1, 0, 0.9, 0, 0, 90, 10, 100, 100), (page_id(1), 2, 0, 0.8, 0, 12, 90, 20, 100, 100), (page_id(2), 3, 0, 0.7, 0, 0, 90, 20, 100, 100)]
    words = [(ISSUE, p, i, 0, t, 2, 24 * i + 1, 20, 24 * i + 9) for p, i, t in [(0, 0, "Contents"), (1, 0, "Title"), (1, 1, "Author"), (2, 0, "Reference"), (3, 0, "Noise")]]
    return pages, spark.createDataFrame(found, FOUND), spark.createDataFrame(words, WORD)


def test_from_regions_to_issues(spark, inputs):
    pages, found, words = inputs
    ground = spark.createDataFrame([(page_id(0), 3), (page_id(1), 1), (page_id(2), 2)], "file_basename string, page_type int")
    rows = ex.training_rows(pages, found, ground)
    assert {r.page_id: r.page_type for r in rows.collect()} == {page_id(0): 3, page_id(1): 1, page_id(2): 2, page_id(3): 0, "odd": 0}
    model = page_model.train(rows)
    got = ex.extract(pages, found, words, model)
    seen = {r.page_number: (r.page_type, r.title, r.authors, r.refs, r.toc) for r in got.collect()}
    assert seen == {0: (3, "", "", "", "Contents"), 1: (1, "Title", "Author", "", ""), 2: (2, "", "", "Reference", ""), 3: (0, "", "", "", "")}
    issue = ex.summarise(got).first()
    assert (issue.toc_ocr, issue.n_articles, issue.articles[0].refs) == ("Contents", 1, "Reference")
    assert ex.compare(got, got).first().score == 1


def test_golden_data(spark, inputs):
    image, note = "struct<id:bigint,file_name:string>", "struct<image_id:bigint,category_id:int,bbox:array<double>>"
    schema = f"task string, images array<{image}>, annotations array<{note}>, categories array<struct<id:bigint,name:string>>"
    names = [(1, "title_article"), (2, "authors_article"), (3, "refs_article"), (4, "toc")]
    task = (ISSUE, [(7, f"{page_id(1)}.jpg")], [(7, 1, [0.0, 0.0, 45.0, 10.0])], names)
    rows, stats = ex.golden_data(spark.createDataFrame([task], schema), inputs[2])
    assert [(r.page_type, r.title) for r in rows.collect()] == [(1, "Title")]
    assert stats.first().title_article == 1
    wrong = spark.createDataFrame([(ISSUE, task[1], [(8, 1, [0.0, 0.0, 1.0, 1.0])], names)], schema)
    with pytest.raises(Exception, match="unknown image"):
        ex.golden_data(wrong, inputs[2])[0].collect()


def test_network_hook(spark):
    net = ex.segmenter(lambda: lambda images: images * 2, [4])
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "image array<float>")
    assert np.allclose(df.select(net(F.col("image")).alias("p")).first().p, [2, 4, 6, 8])


def test_pages_as_a_stream(spark, inputs, tmp_path):
    from foliant.streaming import pages as stream
    from foliant.streaming.finisher import MESSAGE

    pages, found, words = inputs
    ground = spark.createDataFrame([(page_id(0), 3), (page_id(1), 1), (page_id(2), 2)], "file_basename string, page_type int")
    model = page_model.train(ex.training_rows(pages, found, ground))
    nested = found.groupBy("page_id").agg(F.collect_list(F.struct(*found.columns[1:])).alias("found"))
    pages.join(nested, "page_id", "left").repartition(4).write.json(str(tmp_path / "in"))
    query = stream.write_messages(stream.source(spark, str(tmp_path / "in"), 2), words, model, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True)
    assert query.awaitTermination(120)
    got = spark.read.schema(MESSAGE).option("recursiveFileLookup", True).json(str(tmp_path / "out")).collect()
    want = ex.extract(pages, found, words, model).collect()
    assert sorted((r.page_id, r.page_type, r.title, r.refs, r.toc) for r in got) == sorted((r.page_id, r.page_type, r.title, r.refs, r.toc) for r in want)
    assert {r.state for r in got} == {"continue"}


def test_quarantine(spark):
    from foliant.plans.extraction import quarantined

    pages = spark.createDataFrame([("sim_j_1_0001",), ("cover",)], "page_id string")
    box = "page_id string, label int, ith int, x0 int, y0 int, x1 int, y1 int, width int, height int"
    found = spark.createDataFrame([("sim_j_1_0001", 1, 0, 0, 0, 5, 5, 9, 9), ("sim_j_1_0001", 9, 0, 0, 0, 5, 5, 9, 9), ("sim_j_1_0001", 1, 1, 0, 0, 5, 5, None, 9), ("cover", 1, 0, 3, 0, 3, 5, 9, 9)], box)
    got = sorted(tuple(r) for r in quarantined(pages, found).collect())
    assert got == [("cover", "bad box"), ("cover", "bad id"), ("sim_j_1_0001", "bad box"), ("sim_j_1_0001", "bad place")]


def test_a_batch_reads_only_its_issues_words(spark, tmp_path):
    """Folders of other issues are spoiled after the words are laid out: a batch that opened one would fail."""
    from foliant.streaming.pages import WordStore

    words = spark.createDataFrame([(f"sim_j_{i}_1", p, 0, 0, f"w{i}", 0, 0, 8, 8) for i in range(60) for p in range(3)], WORD)
    store = WordStore(spark, str(tmp_path / "words"), parts=32)
    store.write(words)
    batch = spark.createDataFrame([("sim_j_7_1_0001",), ("sim_j_8_1_0002",), ("odd",)], "page_id string")
    got = store.of(batch)
    folders = {str(r.part) for r in words.where("issue_id in ('sim_j_7_1', 'sim_j_8_1')").select(store._part().alias("part")).distinct().collect()}
    assert len(folders) <= 2 < len({f.parent.name for f in (tmp_path / "words").rglob("*.parquet")})
    assert re.search(r"PartitionFilters: \[[^\]]*part", got._jdf.queryExecution().executedPlan().toString())
    for f in (tmp_path / "words").rglob("*.parquet"):
        if f.parent.name.split("=")[1] not in folders:
            f.write_bytes(b"spoiled")
    assert sorted((r.issue_id, r.page, r.text) for r in got.collect()) == [(f"sim_j_{i}_1", p, f"w{i}") for i in (7, 8) for p in range(3)]
    assert store.of(batch.limit(0)).count() == 0


def test_the_page_stream_with_a_word_store(spark, inputs, tmp_path):
    from foliant.streaming import pages as stream
    from foliant.streaming.finisher import MESSAGE
    from foliant.streaming.progress import Progress

    pages, found, words = inputs
    ground = spark.createDataFrame([(page_id(0), 3), (page_id(1), 1), (page_id(2), 2)], "file_basename string, page_type int")
    model = page_model.train(ex.training_rows(pages, found, ground))
    nested = found.groupBy("page_id").agg(F.collect_list(F.struct(*found.columns[1:])).alias("found"))
    pages.join(nested, "page_id", "left").repartition(3).write.json(str(tmp_path / "in"))
    store = stream.WordStore(spark, str(tmp_path / "words"))
    store.write(words.unionByName(words.withColumn("issue_id", F.lit("sim_other_1"))))
    progress = Progress.of(spark)
    query = stream.write_messages(stream.source(spark, str(tmp_path / "in"), 1), store, model, str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True)
    assert query.awaitTermination(120)
    progress.wait(query)
    spark.streams.removeListener(progress)
    got = spark.read.schema(MESSAGE).option("recursiveFileLookup", True).json(str(tmp_path / "out")).collect()
    want = ex.extract(pages, found, words, model).collect()
    assert sorted((r.page_id, r.page_type, r.title, r.refs, r.toc) for r in got) == sorted((r.page_id, r.page_type, r.title, r.refs, r.toc) for r in want)
    assert (progress.totals()["pages.n"], progress.totals()["pages.n_regions"]) == (5, found.count())

import json

from pyspark.sql import functions as F

from foliant.operators import issues

KINDS = [2, 3, 3, 0, 3, 1, 2, 2, 0, 2, 1, 3, 0, 2, 1, 1, 0, 0, 2]
PAGE = "journal_id string, issue_id string, page_id string, page_number int, page_type int, title string, authors string, refs string, toc string"


def pages(spark, kinds=KINDS, issue="i"):
    rows = [("j", issue, f"{issue}_{n}", n, k, f"t{n}", f"a{n}&b\nc", f"r{n}", f"c{n}") for n, k in enumerate(kinds)]
    return spark.createDataFrame(rows, PAGE)


def test_articles_by_hand(spark):
    got = {r.page: r.refs for r in issues.articles(pages(spark)).collect()}
    assert got == {5: "r6\nr7", 10: "r13", 14: "", 15: "r18"}
    kept = [r.page_number for r in issues.attached(pages(spark)).where("page_type = 2").collect()]
    assert sorted(kept) == [6, 7, 13, 18]


def test_contents_run(spark):
    assert sorted(r.page_number for r in issues.contents_run(pages(spark)).collect()) == [1, 2]


def test_results_and_documents(spark):
    both = pages(spark).unionByName(pages(spark, [0, 2], "empty"))
    rows = {r.issue_id: json.loads(r.json) for r in issues.result_json(issues.results(both)).collect()}
    assert rows["empty"] == {"articles": [], "toc_ocr": "", "issue_id": "empty", "journal_id": "j"}
    first = rows["i"]["articles"][0]
    assert first == {"title": "t5", "authors": "a5 b, c", "page": 5, "page_id": "i_5", "refs": "r6\nr7"}
    assert rows["i"]["toc_ocr"] == "c1\nc2"
    counts = {r.issue_id: (r.n_articles, r.n_articles_with_refs) for r in issues.results(both).collect()}
    assert counts == {"i": (4, 3), "empty": (0, 0)}
    lines = [r.line for r in issues.contents_lines(issues.results(both)).orderBy("n").collect()]
    assert lines[0] == "'t5' BY a5 b, c  PAGE 5"


def test_contiguity_and_latest(spark):
    whole = issues.contiguity(pages(spark)).first()
    assert (whole.page_count, whole.max_page, whole.contiguous) == (19, 18, True)
    assert not issues.contiguity(pages(spark).where("page_number <> 4")).first().contiguous
    twice = pages(spark).withColumn("seq", F.col("page_number")).unionByName(pages(spark).withColumns({"seq": F.lit(99), "title": F.lit("new")}))
    got = issues.latest(twice, "seq").collect()
    assert len(got) == 19 and {r.title for r in got} == {"new"}


def test_empty(spark):
    none = pages(spark).limit(0)
    assert issues.results(none).count() == issues.articles(none).count() == issues.contiguity(none).count() == 0

import gzip
import json

import pytest

from foliant.operators import datasets, issues, ocr
from foliant.sources import readers, writers

HOCR = """<html><body><div class='ocr_page'><p class='ocr_par'>
<span class='ocr_line'><span class='ocrx_word' title='bbox 0 0 8 8; x_wconf 9'>a<em>b</em></span> <span class='ocrx_word' title='bbox 10 0 18 8'>c</span></span>
<span class='ocr_line'></span></p></div>
<div class='ocr_page'></div><div class='ocr_page'><span class='ocr_line'><span class='ocrx_word' title='bbox 1 2 3 4'>d</span></span></div></body></html>"""


def test_hocr(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "sim_x_1_hocr.html").write_text(HOCR)
    (tmp_path / "sim_x_1_chocr.html.gz").write_bytes(gzip.compress(b"<html></html>"))
    (tmp_path / "deep" / "sim_y_1_hocr.html.gz").write_bytes(gzip.compress(HOCR.encode()))
    chosen = {r.issue_id: r.path.rsplit("/", 1)[1] for r in readers.hocr_files(spark, str(tmp_path)).collect()}
    assert chosen == {"sim_x_1": "sim_x_1_hocr.html", "sim_y_1": "sim_y_1_hocr.html.gz"}
    rows = readers.hocr(spark, str(tmp_path)).where("issue_id = 'sim_x_1'")
    got = sorted((r.page, r.line_no, -1 if r.word_no is None else r.word_no, r.text or "", r.x0 or 0) for r in rows.collect())
    assert got == [(0, 0, 0, "ab", 0), (0, 0, 1, "c", 10), (0, 1, -1, "", 0), (2, 0, 0, "d", 1)]
    lines = ocr.nested_lines(rows, ["issue_id", "page"]).where("page = 0").first().lines
    assert [len(x.words) for x in lines] == [2, 0] and (lines[0].y0, lines[0].y1, lines[1].y0) == (0, 8, None)


def excerpt(n, kind):
    return {"journal_id": "j", "page_id": f"i_{n}", "page_number": n, "page_type": kind, "title": "té", "authors": "a", "refs": "", "toc": "", "explanation": ""}


def test_excerpts_round_trip(spark, tmp_path):
    src = tmp_path / "in.jsonl"
    src.write_text("".join(json.dumps(excerpt(n, 1)) + "\n" for n in (1, 0, -1)))
    rows = readers.excerpts(spark, str(src))
    assert rows.count() == 3
    writers.excerpts(rows.selectExpr("*", "'i' as issue_id"), str(tmp_path / "out"))
    files = list((tmp_path / "out").rglob("part-*.txt"))
    assert len(files) == 1 and "journal_id=j/issue_id=i" in str(files[0])
    back = [json.loads(x) for x in files[0].read_text().splitlines()]
    assert [x["page_number"] for x in back] == [0, 1]
    assert list(back[0])[0] == "page_id" or set(back[0]) >= {"page_id", "title"}
    src.write_text(json.dumps({k: v for k, v in excerpt(0, 1).items() if k != "refs"}) + "\n")
    with pytest.raises(Exception, match="lacks a key"):
        readers.excerpts(spark, str(src)).collect()


def test_vectors_and_tables(spark, tmp_path):
    df = spark.createDataFrame([([0.5, 1.0], 2), ([0.0, 3.0], 0)], "vec array<double>, page_type int")
    writers.training_vectors(df, str(tmp_path / "v"))
    assert sorted((r.vec, r.page_type) for r in readers.training_vectors(spark, str(tmp_path / "v")).collect()) == [([0.0, 3.0], 0), ([0.5, 1.0], 2)]
    (tmp_path / "a.csv").write_text("file_basename,page_type\nx,1\n")
    (tmp_path / "b.csv").write_text("file_basename,page_type\ny,2\n")
    ground = readers.ground(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(tuple(r)[:2] for r in ground.collect()) == [("x", 1), ("y", 2)]
    names = spark.createDataFrame([("x",), ("z",), ("q",)], "file_basename string")
    assert {r[0] for r in datasets.missing_ground(names, ground).collect()} == {"z", "q"}
    part = spark.createDataFrame([("long_x_name", 0)], "file_basename string, page_type int")
    assert {r[0] for r in datasets.missing_ground(names, part, exact=False).collect()} == {"z", "q"}
    assert sorted(tuple(r) for r in datasets.with_ground(names, ground).collect()) == [("q", 0), ("x", 1), ("z", 0)]
    (tmp_path / "c.csv").write_text("file_basename,page_type\nx,3\nz,2\nx,0\n")
    last = readers.ground(spark, [str(tmp_path / "a.csv"), str(tmp_path / "c.csv")])
    assert sorted(tuple(r) for r in datasets.with_ground(names, last).collect()) == [("q", 0), ("x", 0), ("z", 2)]
    last = readers.ground(spark, [str(tmp_path / "c.csv"), str(tmp_path / "a.csv")])
    assert sorted(tuple(r) for r in datasets.with_ground(names, last).collect()) == [("q", 0), ("x", 1), ("z", 2)]
    (tmp_path / "names").write_text("one\ntwo\n")
    assert [tuple(r) for r in readers.label_names(spark, str(tmp_path / "names")).collect()] == [(1, "one"), (2, "two")]
    (tmp_path / "stats.txt").write_text("task_name=i\n\nimage_count=3\n")
    assert sorted((r.key, r.value) for r in readers.key_values(spark, str(tmp_path / "stats.txt")).collect()) == [("image_count", "3"), ("task_name", "i")]
    assert json.loads(datasets.training_config("/d"))["train_data"] == "/d/training"


def test_images_and_catalog(spark, tmp_path):
    for n in ("b.png", "a.jpg", "c.txt", "sim_i_1__boxes.jpg"):
        (tmp_path / n).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[1] for r in readers.images(spark, str(tmp_path)).collect()] == ["a.jpg", "b.png", "sim_i_1__boxes.jpg"]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="no images"):
        readers.images(spark, str(tmp_path / "none"))
    assert [r.page_id for r in readers.debug_images(spark, str(tmp_path)).collect()] == ["sim_i_1"]
    (tmp_path / "c.json").write_text('{"date": "1999-01-02T00:00:00Z", "identifier": "a"}\n{"date": "1999-01-02T00:00:00Z", "identifier": "b"}\n{"date": "2001-01-02T00:00:00Z", "identifier": "c"}\n')
    items = readers.catalog(spark, str(tmp_path / "c.json"))
    assert datasets.in_range(items, "1999-01-01", "2000-01-01").count() == 2
    assert datasets.in_range(items, "1999-01-01", None).count() == 3
    assert [r.identifier for r in datasets.by_date(items).orderBy("first_seen").collect()] == ["b", "c"]


def test_coco_and_results(spark, tmp_path):
    doc = {"images": [{"id": 1, "width": 2, "height": 3, "file_name": "x_1.jpg"}], "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [0, 0, 1, 1]}], "categories": [{"id": 1, "name": "toc"}]}
    (tmp_path / "task7.json").write_text(json.dumps(doc, indent=1))
    r = readers.coco(spark, str(tmp_path / "task7.json")).first()
    assert r.task == "task7" and r.images[0].file_name == "x_1.jpg" and r.annotations[0].bbox == [0.0, 0.0, 1.0, 1.0]
    page = "journal_id string, issue_id string, page_id string, page_number int, page_type int, title string, authors string, refs string, toc string"
    pages = spark.createDataFrame([("j", "i", "i_0", 0, 1, "T" * 200, "A", "", ""), ("j", "i", "i_1", 1, 2, "", "", "r", "")], page)
    found = datasets.with_images(issues.articles(pages), spark.createDataFrame([("zz", "/x")], "page_id string, path string"))
    row = writers.debug_rows(found).first()
    assert row.title == "T" * 150 + "..." and row.url.endswith("/i/page/n0/mode/1up?admin=1")
    html = writers.debug_page(found).first().html
    assert "NotFound" in html and html.count("<tr>") == 2
    writers.results(issues.results(pages), str(tmp_path / "res"))
    assert json.loads(next((tmp_path / "res").rglob("part-*.txt")).read_text())["articles"][0]["refs"] == "r"

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import golden, images, ocr, page_model, regions, rules

WORDS = "page string, line_no int, word_no int, text string, x0 int, y0 int, x1 int, y1 int"
REGION = "page string, label int, ith int, confidence double, normalized_x double, normalized_y double, page_width_fraction double, x0 int, y0 int, x1 int, y1 int"


def words(spark, lines, page="p"):
    rows = [(page, i, j if w else None, w or None, *((10 * j, 10 * i, 10 * j + 8, 10 * i + 8) if w else (None,) * 4)) for i, line in enumerate(lines) for j, w in enumerate(line or [""])]
    return spark.createDataFrame(rows, WORDS)


def test_box_text(spark):
    df = words(spark, [["a", "b"], ["Z"], [], ["c"]])
    df = df.withColumn("x1", F.when(F.col("text") == "Z", 999).otherwise(F.col("x1")))
    lines = ocr.nested_lines(df, ["page"])
    box = {k: F.lit(v) for k, v in {"x0": 0, "y0": 0, "x1": 18, "y1": 38}.items()}
    r = lines.select(ocr.box_text(F.col("lines"), box).alias("t"), ocr.words_in(F.col("lines"), box).alias("n")).first()
    assert (r.t, r.n) == ("a b \n\n\nc", 3)
    empty = spark.range(1).select(ocr.box_text(F.lit(None).cast(lines.schema["lines"].dataType), box).alias("t")).first()
    assert empty.t == ""


def region(label, ith, conf, x=0.1, y=0.1, w=0.7, line=0):
    return ("p", label, ith, conf, x, y, w, 0, 5 * line, 100, 5 * line + 4)


def run(spark, model_type, rows, page_number=5):
    pages = spark.createDataFrame([("p", page_number, model_type)], "page string, page_number int, model_type int")
    text = ocr.nested_lines(words(spark, [["Big", "Title"], ["Ann", "Lee"], ["Bob"], ["ref"], ["more"]]), ["page"])
    return rules.excerpts(pages, spark.createDataFrame(rows, REGION), text, ["page"]).first()


def test_article(spark):
    r = run(spark, 1, [region(1, 0, 0.6, line=0), region(1, 1, 0.5, line=3), region(2, 0, 0.5, y=0.3, line=2), region(2, 1, 0.5, y=0.2, line=1), region(2, 2, 0.3, line=3), region(2, 3, 0.9, y=0.05, line=4)])
    assert (r.page_type, r.title, r.authors) == (1, "Big Title", "Ann Lee\\nBob")
    assert run(spark, 1, [region(1, 0, 0.49)]).page_type == 0
    assert run(spark, 1, [region(1, 0, 0.9, y=0.51)]).page_type == 0
    assert run(spark, 1, [region(2, 0, 0.9)]).page_type == 0


def test_refs(spark):
    r = run(spark, 2, [region(3, 0, 0.5, x=0.5, line=4), region(3, 1, 0.5, x=0.1, line=3)])
    assert (r.page_type, r.refs) == (2, "ref\nmore")
    assert run(spark, 2, [region(3, 0, 0.48, line=3), region(3, 1, 0.9, x=0.5, line=4)]).page_type == 0
    assert run(spark, 2, [region(3, 0, 0.9, w=0.34, line=3)]).page_type == 0
    far = run(spark, 2, [region(3, 0, 0.9, line=50), region(3, 1, 0.9, x=0.5, line=60)])
    assert (far.page_type, far.refs) == (2, "\n")  # two empty texts still make one


def test_contents_and_overrides(spark):
    toc = [region(4, 0, 0.6, line=0)]
    assert run(spark, 3, toc).toc == "Big Title"
    assert run(spark, 3, toc, 21).page_type == 0
    assert run(spark, 1, toc, 9).page_type == 3
    assert run(spark, 1, toc, 10).page_type == 0
    assert run(spark, 3, [region(4, 0, 0.6, w=0.6)]).page_type == 0
    assert run(spark, 0, toc).page_type == 0
    assert "disagreement with best label" in run(spark, 0, toc).diagnostics


def test_best_label_and_order(spark):
    df = spark.createDataFrame([region(2, 0, 0.5), region(1, 1, 0.5), region(1, 0, 0.4)], REGION)
    one = regions.by_page(df, ["page"], ["confidence", "normalized_y"])
    assert tuple(one.select(regions.best_label(F.col("regions")).alias("b")).first().b) == (1, 1, 0.5)
    assert one.select(regions.all_instances(F.col("regions"), 1, "confidence").alias("o")).first().o == [2, 3, 0, 1]
    assert one.select(regions.all_instances(F.col("regions"), 1, "confidence", False).alias("o")).first().o == [1, 0, 2, 3]
    none = regions.by_page(df.withColumn("confidence", F.lit(0.0)), ["page"], ["confidence"])
    assert tuple(none.select(regions.best_label(F.col("regions")).alias("b")).first().b) == (0, 0, 0.0)


def test_vector(spark):
    df = spark.createDataFrame([region(2, 1, 0.5)], REGION).withColumns({f: F.lit(0.25) for f in ("region_size", "aspect_ratio", "page_height_fraction")})
    one = regions.by_page(df, ["page"], [f for f in regions.FIELDS if f != "label"])
    vec = one.select(regions.vector(F.col("regions")).alias("v")).first().v
    assert len(vec) == 128 == len(set(regions.vector_names()))
    assert vec[40:48] == [2.0, 0.25, 0.5, 0.25, 0.1, 0.1, 0.7, 0.25] and sum(map(bool, vec)) == 8
    good, bad = regions.checked(df.unionByName(df.withColumn("label", F.lit(5))).unionByName(df.withColumn("ith", F.lit(-1))))
    assert (good.count(), bad.count()) == (1, 2)


def test_page_model(spark, tmp_path):
    rows = spark.range(80).select("id", (F.col("id") % 4).cast("int").alias("page_type"), F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: (F.col("id") % 4 * (i % 3)).cast("double")).alias("vec"))
    model = page_model.train(rows)
    assert page_model.predict(model, rows).where("model_type <> page_type").count() == 0
    page_model.save(model, str(tmp_path / "m"))
    assert page_model.load(str(tmp_path / "m")).numNodes == model.numNodes
    assert page_model.load(str(tmp_path / "none")) is None
    assert "label1_0" in page_model.described(model)
    sizes = [r["count"] for r in page_model.folds(rows, "id").groupBy("fold", "page_type").count().collect()]
    assert sizes == [4] * 20


def test_equal_pages_are_one_with_a_weight(spark):
    """A tree that is fitted on copies holds each page once, and tells what a tree on all of them does."""
    vec = F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: (F.col("id") * 7 % (i + 3)).cast("double"))
    rows = spark.range(40).select("id", ((F.col("id") * 5 + F.col("id") % 3) % 4).cast("int").alias("page_type"), vec.alias("vec"))
    many = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(6)))).where("copy <= 1 + id % 6").withColumn("key", F.col("id") * 10 + F.col("copy"))
    one = page_model.weighted(many)
    assert one.count() == 40 and one.agg(F.sum("weight")).first()[0] == many.count()
    a, b = (page_model.predict(page_model.train(r), rows).orderBy("id").select("model_type").collect() for r in (one, many))
    assert a == b == rows.orderBy("id").select(F.col("page_type").alias("model_type")).collect()
    got = page_model.cross_validation(many, "key").collect()
    assert sum(r.n for r in got) == many.count() and all(0 <= r.accuracy <= 1 for r in got)


def test_images():
    probs = np.zeros((100, 120))
    probs[10:40, 20:60] = 0.9
    probs[60:90, 70:110] = 0.8
    probs[5, 5] = 1.0
    assert images.boxes(images.binary_mask(probs)) == [(20, 10, 59, 39), (70, 60, 109, 89)]
    assert images.boxes(np.zeros((9, 9), bool)) == []
    mask = images.painted_mask(10, 8, [(1, (0, 0, 6, 4)), (2, (4, 2, 9, 9))])
    assert mask.shape == (8, 10, 3) and tuple(mask[0, 0]) == (255, 0, 0) and tuple(mask[3, 5]) == (0, 255, 0) and not mask[7, 0].any()
    assert images.png(mask)[:8] == b"\x89PNG\r\n\x1a\n"
    grey = np.full((1, 1), 255)
    assert images.mixed_mask([((200, 0, 1), grey), ((100, 0, 1), grey)]).tolist() == [[[44, 0, 2]]]


def test_regions_from_probs(spark):
    probs = np.zeros((50, 60, 5), np.float32)
    probs[:, :, 0] = 0.1
    probs[10:40, 20:50, 2] = 0.9
    df = spark.createDataFrame([("p", 1, 50, 60, bytearray(probs.tobytes()))], "page_id string, page_number int, height int, width int, probs binary")
    r = images.regions_from_probs(df).first()
    assert (r.label, r.ith, r.x0, r.y0, r.x1, r.y1) == (2, 0, 20, 10, 49, 39)
    assert r.confidence == pytest.approx(0.9 * 900 / 841, rel=1e-4)
    r = images.regions_from_probs(df.selectExpr("*", "100 as page_height", "180 as page_width")).first()
    assert (r.label, r.ith, r.x0, r.y0, r.x1, r.y1, r.width, r.height) == (2, 0, 60, 20, 149, 79, 180, 100)
    assert r.confidence == pytest.approx(0.9 * 90 * 60 / (89 * 59), rel=1e-4)
    assert images.upscaled(np.array([[1, 2, 3]]), 1, 2).tolist() == [[1, 2]]


def test_golden(spark):
    image = "struct<id:bigint,file_name:string>"
    note = "struct<image_id:bigint,category_id:int,bbox:array<double>>"
    task = [("t", [(1, "d/x_0001.jpg"), (2, "x_0002.PNG"), (3, "x_0003.png"), (4, "cover.jpg"), (5, "y_0001.jpg")], [(5, 1, [0.0, 0.0, 9.0, 4.0]), (5, 2, [0.0, 5.0, 9.0, 4.0]), (5, 2, [0.0, 10.0, 9.0, 4.0])], [(1, "title_article"), (2, "authors_article"), (3, "refs_article"), (4, "toc")])]
    tasks = spark.createDataFrame(task, f"task string, images array<{image}>, annotations array<{note}>, categories array<struct<id:bigint,name:string>>")
    assert golden.same_categories(tasks).count() == 1
    assert golden.same_categories(tasks, ["title_article"]).count() == 0
    shown = golden.images_of(tasks)
    assert sorted((r.page_number, r.image_id) for r in shown.collect()) == [(1, 5), (3, 3)]  # the last of a page; lower-case suffixes
    notes = golden.annotations_of(tasks)
    assert golden.orphans(notes, shown).count() == 0
    text = ocr.nested_lines(words(spark, [["Big"], ["Ann"], ["Bob"]]).withColumn("page_number", F.lit(1)), ["page_number"])
    on_page = notes.join(shown.select("task", "image_id", "page_number"), ["task", "image_id"]).select("task", "page_number", "n", "label", "box")
    rows = golden.excerpts(shown, on_page, text.withColumn("task", F.lit("t")), ["task", "page_number"])
    got = {r.page_number: (r.page_type, r.title, r.authors, r.n_annotations) for r in rows.collect()}
    assert got == {1: (1, "Big", "Ann, Bob", 3), 3: (0, "", "", 0)}
    assert sorted(tuple(r) for r in golden.ground(rows).collect()) == [("x_0003", 0), ("y_0001", 1)]
    s = golden.stats(shown, on_page, "task", ["page_number"]).first()
    assert (s.image_count, s.image_annotated_count, s.annotation_count, s.title_article, s.authors_article, s.toc) == (2, 1, 3, 1, 2, 0)

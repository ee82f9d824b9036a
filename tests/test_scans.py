"""The hOCR source, named files, exports read in pieces, masks, isolation, ranks, substrings, and what plans of them read."""

import gzip
import json
import random
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import datasets, images, isolation, ocr, page_model
from foliant.operators.ranks import ranked
from foliant.sources import exports, hocr, named_files, readers, writers


def page(*lines):
    word = lambda i, t: f"<span class='ocrx_word' title='bbox {9 * i} 0 {9 * i + 8} 8'>{t}</span>"
    return "<div class='ocr_page'>" + "".join(f"<span class='ocr_line'>{''.join(word(i, t) for i, t in enumerate(line))}</span>" for line in lines) + "</div>"


def body(*pages):
    return f"<html><body>{''.join(pages)}</body></html>".encode()


@pytest.fixture
def shelf(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "sim_a_1_hocr.html").write_bytes(body(page(["one"]), page(["two", "é&amp;"], [])))
    (tmp_path / "sim_b_1_hocr.html.gz").write_bytes(gzip.compress(body(page(["three"]))))
    (tmp_path / "sim_c_1_hocr.html.gz").write_bytes(b"\x1f\x8bthis is no gzip file")
    return str(tmp_path)


def test_filters_choose_files_before_they_are_opened(spark, shelf):
    words = readers.hocr(spark, shelf)
    with pytest.raises(Exception, match="gzip|zlib|OSError|codec"):
        words.collect()
    one = words.where("issue_id = 'sim_a_1'")
    assert sorted((r.page, r.line_no, r.word_no, r.text) for r in one.where("text is not null").collect()) == [(0, 0, 0, "one"), (1, 0, 0, "two"), (1, 0, 1, "é&")]
    assert one.rdd.getNumPartitions() == 1
    assert words.where("issue_id in ('sim_a_1', 'sim_b_1') and page = 0").count() == 2
    assert words.where("issue_id = 'sim_z_1'").count() == 0
    assert words.where(F.col("issue_id") == "sim_b_1").where(F.col("issue_id") == "sim_a_1").count() == 0
    reader = hocr.HocrReader(shelf)
    kept = list(reader.pushFilters([hocr.EqualTo(("issue_id",), "sim_b_1"), hocr.LessThan(("page",), 3), hocr.GreaterThanOrEqual(("page",), 1)]))
    assert [f for p in reader.partitions() for f in p.files] == [("sim_b_1", f"{shelf}/sim_b_1_hocr.html.gz")] and len(kept) == 2
    assert (reader.first, reader.last) == (1, 3)


def test_reading_stops_behind_the_last_page():
    seen = []

    def chunks():
        for n in range(1000):
            seen.append(n)
            yield page([f"w{n}"]).encode()

    assert [r[3] for r in hocr.parse(chunks(), 2, 4)] == ["w2", "w3", "w4"] and len(seen) < 10
    whole = body(*[page(["é" * 50, "x"], []) for _ in range(20)])
    pieces = [whole[i : i + 7] for i in range(0, len(whole), 7)]  # letters and tags in two pieces
    assert list(hocr.parse(pieces)) == list(hocr.parse([whole])) and len(list(hocr.parse([whole]))) == 60
    assert list(hocr.parse([])) == []


class Whole(hocr.HocrParser):
    """All of it by HTMLParser."""

    feed = HTMLParser.feed


def test_plain_words_beside_the_whole_parser(monkeypatch):
    r = random.Random(11)
    word = "<span class='ocrx_word' title='bbox {n} 2 -3 44; x_wconf 9'>"
    parts = [
        "<div class='ocr_page' id='p' title='image &quot;x&quot;; bbox 0 0 1 1'>", '<div class="ocr_page">', "</div>", "<span class='ocr_line'>", "<p class='ocr_par x'\n  lang=\"eng\" >", "<SPAN CLASS=ocr_header >", "</span>", "</span >", "</p>",
        word + "one</span>", word + "a&amp;b &lt;&#233; &copy </span>", word + "<strong>two</strong> three</span>", word + " </span>", word, "<span class=\"ocrx_word\" id='w' title=\"bbox 1 2 3 4\" lang='e'>é</span>",
        "<span class='ocrx_word' title='bbox 1 2 3'>none</span>", "<span class='ocrx_word x' title='x bbox 1 2 3 4'>four</span>", "<span title='bbox 5 6 7 8' class='ocrx_word'>five</span>", "<span class='ocrx_word' title='bbox 1 2 3 4' title='no'>six</span>",
        "<br/>", "<br>", "<img src='x'>", "<!-- <span class='ocr_line'> > -->", "<script>if (a > b) '<span class=\"ocr_line\">'</script>", "<meta name='ocr' />", "a < b > c", " & ", "&", "\n", "<?x?>", "<!DOCTYPE html>", "<em/>", "text",
    ]
    for k in range(400):
        text = "".join(r.choice(parts).replace("{n}", str(r.randrange(99))) for _ in range(r.randrange(60)))
        size = r.choice([1, 7, 50, 10**6])
        want, got = Whole(), hocr.HocrParser()
        want.feed(text)
        for i in range(0, len(text), size):
            got.feed(text[i : i + size])
        want.close()
        got.close()
        assert got.take() == want.take(), (k, size, text)
    seen, feed = [], HTMLParser.feed
    monkeypatch.setattr(HTMLParser, "feed", lambda self, data: seen.append(len(data)) or feed(self, data))
    text = body(*[page(["a&amp;b", "c"], []) for _ in range(500)]).decode()
    parser = hocr.HocrParser()
    for i in range(0, len(text), 5000):
        parser.feed(text[i : i + 5000])
    parser.close()
    assert len(parser.take()) == 1500 and sum(seen) < len(text) / 10


def test_named_files_come_all_or_none(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 3}/f{i}.txt", f"text {i}") for i in range(40)], "name string, content string").repartition(4)
    named_files.write(rows, f"file://{tmp_path}/out")
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {r.name: r.content for r in rows.collect()}
    named_files.write(rows.limit(0), str(tmp_path / "out"))
    for bad, message in ((rows.limit(1), "there already"), (rows.unionByName(rows).withColumn("name", F.concat(F.lit("n"), "name")), "two rows"), (rows.withColumn("name", F.lit("../x")), "no name")):
        with pytest.raises(Exception, match=message):
            named_files.write(bad, str(tmp_path / "out"))
    late = rows.withColumn("name", F.when(F.col("name") == "d1/f1.txt", F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.concat(F.lit("z/"), "name")))
    with pytest.raises(Exception, match="broken row"):
        named_files.write(late, str(tmp_path / "out"))
    assert sum(p.is_file() for p in (tmp_path / "out").rglob("*")) == 40
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_")]


def test_export_items_in_pieces():
    r = random.Random(2)
    doc = {"info": {"a": [1, {"b": "]}"}]}, "images": [{"id": i, "t": "é\"\\ [{" * r.randrange(5)} for i in range(30)], "n": 12, "empty": [], "numbers": [1, 23, -4.5e3, 678], "s": "x"}
    for indent in (None, 1):
        text = json.dumps(doc, indent=indent, ensure_ascii=False)
        for size in (1, 3, 50, 10**6):
            got = list(exports.items(text[i : i + size] for i in range(0, len(text), size)))
            assert [(n, k, json.loads(x)) for n, k, x in got] == [(n, k, x) for n in ("images", "numbers") for k, x in enumerate(doc[n])]
    assert {n for n, _, _ in exports.items(iter([json.dumps(doc)]), {"numbers"})} == {"numbers"}
    assert list(exports.items(iter(["{}"]))) == []
    for bad in ("", "[1]", '{"a": [1, 2', '{"a": [1 2]}', '{"a": [{"b": ]}', "{} x", '{"a" 1}'):
        with pytest.raises(ValueError):
            list(exports.items(iter([bad])))


def test_exports_as_tasks(spark, tmp_path):
    doc = {"images": [{"id": 1, "width": 2, "height": 3, "file_name": "x_1.jpg"}], "annotations": [{"id": i, "image_id": 1, "category_id": 1, "bbox": [0, i, 1, 1]} for i in range(12)], "more": 1}
    (tmp_path / "task7.json").write_text(json.dumps(doc))
    (tmp_path / "task8.json.gz").write_bytes(gzip.compress(json.dumps({"images": [], "categories": [{"id": 1, "name": "toc"}]}).encode()))
    got = {r.task: r for r in readers.coco(spark, str(tmp_path)).collect()}
    assert [a.bbox[1] for a in got["task7"].annotations] == list(range(12)) and got["task7"].categories == []
    assert got["task8"].categories[0].name == "toc" and set(got) == {"task7", "task8"}
    assert readers.coco_items(spark, str(tmp_path), "annotations").where("item.id > 3").count() == 8


def test_small_exports_share_a_partition(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"t{i}.json").write_text(json.dumps({"images": [{"id": i}], "annotations": []}))
    rows = readers.coco_items(spark, str(tmp_path), "images")
    assert rows.rdd.getNumPartitions() <= 3
    assert sorted((r.task, r.n, r.item.id) for r in rows.collect()) == sorted((f"t{i}", 0, i) for i in range(300))


def test_masks(spark, tmp_path):
    stroke = "array<struct<label:int,x:int,y:int,w:int,h:int>>"
    pages = spark.createDataFrame([("a.png", 4, 3, [(1, -1, 0, 3, 2), (4, 1, 1, 9, 9)]), ("b.png", 2, 2, None), ("c.png", None, 1, [])], f"file_name string, width int, height int, strokes {stroke}")
    files = images.mask_files(pages)
    with pytest.raises(Exception, match="no mask for c.png"):
        writers.masks(files, str(tmp_path / "m"))
    assert not [p for p in (tmp_path / "m").rglob("*") if p.is_file()]
    writers.masks(files.where("error is null"), str(tmp_path / "m"))
    got = {(r.file_name, r.red, r.green, r.blue): (r.n, r.places) for r in images.mask_colours(readers.masks(spark, str(tmp_path / "m"))).collect()}
    assert got == {("a.png", 255, 0, 0): (3, 0 + 1 + 4), ("a.png", 128, 0, 128): (6, 5 + 6 + 7 + 9 + 10 + 11), ("a.png", 0, 0, 0): (3, 2 + 3 + 8), ("b.png", 0, 0, 0): (4, 6)}
    assert images.composite_mask(2, 1, [(1, (0, 0, 1, 1)), (4, (0, 0, 2, 1)), (4, (0, 0, 2, 1))]).tolist() == [[[(255 + 128) % 256, 0, 128], [128, 0, 128]]]
    whole = images.png(images.painted_mask(3, 2, []))
    broken = spark.createDataFrame([("x", bytearray(whole[:-20] + b"?" + whole[-19:])), ("y", bytearray(b"no")), ("z", bytearray(whole))], "file_name string, content binary")
    assert {r.file_name: (r.error or "").split(":")[0] for r in images.mask_colours(broken).collect()} == {"x": "ValueError", "y": "ValueError", "z": ""}


def test_strokes_reach_workers_as_numbers(spark):
    """A batch of pages with some hundred structs each would be dictionaries of some gigabytes in a worker."""
    stroke = "array<struct<n:int,label:int,x:int,y:int,w:int,h:int>>"
    pages = spark.createDataFrame([("a.png", 4, 3, [(1, 1, -1, 0, 3, 2), (2, 4, 1, 1, 9, 9)]), ("b.png", 4, 3, [(1, None, 0, 0, 1, 1)]), ("c.png", 4, 3, [])], f"file_name string, width int, height int, strokes {stroke}")
    for files, plain in ((images.mask_files, images.painted_mask), (images.composite_files, images.composite_mask)):
        made = files(pages)
        assert images._flat(pages).schema["strokes"].dataType.simpleString() == "array<int>"
        got = {r.file_name: r for r in made.collect()}
        assert images.png_pixels(bytes(got["a.png"].content)).tolist() == plain(4, 3, [(1, (-1, 0, 3, 2)), (4, (1, 1, 9, 9))]).tolist()
        assert got["b.png"].error and not got["c.png"].error and not images.png_pixels(bytes(got["c.png"].content)).any()


def test_a_failing_row_is_a_dead_letter(spark, tmp_path):
    def work(row):
        if row.n == 3:
            raise KeyError("three")
        return [(row.id, row.n, k) for k in range(row.n)]

    rows = spark.createDataFrame([("a", 1), ("b", 3), ("c", 2), ("d", 0)], "id string, n int")
    good, dead = isolation.parted(isolation.each(rows, work, "id string, n int, k int", ["id"]), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in good.collect()) == [("a", 1, 0), ("c", 2, 0), ("c", 2, 1)]
    assert [tuple(r) for r in dead.collect()] == [("b", None, None, "KeyError: 'three'")]
    good, dead = isolation.parted(isolation.each(rows.limit(0), work, "id string, n int, k int", ["id"]), str(tmp_path / "none"))
    assert (good.count(), dead.count()) == (0, 0)
    probs = np.zeros((30, 30, 3), np.float32)
    probs[2:27, :25, 1] = 1
    df = spark.createDataFrame([("p", 1, 30, 30, bytearray(probs.tobytes())), ("q", 2, 30, 31, bytearray(probs.tobytes())), ("r", 3, 30, 30, None)], "page_id string, page_number int, height int, width int, probs binary")
    got = {r.page_id: (r.label, (r.error or "").split(":")[0]) for r in images.regions_or_errors(df).collect()}
    assert got["p"] == (1, "") and got["q"] == (None, "ValueError") and got["r"][0] is None and got["r"][1]
    assert images.regions_from_probs(df).count() == 1


def test_ranks_of_large_groups(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 5 + ["a", None]), r.randrange(300), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(5)
    got = ranked(df, [F.desc("v"), F.col("i")], ["g"]).collect()
    want = {}
    for g in {x[0] for x in rows}:
        for k, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2])), 1):
            want[x[2]] = k
    assert {x.i: x["rank"] for x in got} == want
    assert sorted(x["n"] for x in ranked(df, [F.col("i")], name="n").collect()) == list(range(1, 3001))
    assert ranked(df.limit(0), [F.col("i")]).collect() == []


def test_folds_are_contiguous(spark):
    df = spark.createDataFrame([(i, (i // 7) % 3) for i in range(100)], "id int, page_type int").repartition(3)
    got = {}
    for r in page_model.folds(df, "id").collect():
        got.setdefault(r.page_type, []).append((r.id, r.fold))
    for rows in got.values():
        found = [f for _, f in sorted(rows)]
        assert found == sorted(found) and set(found) == set(range(5)) and max(map(found.count, range(5))) - min(map(found.count, range(5))) <= 1


@pytest.mark.parametrize("gram", [2, 4, 8])
def test_names_in_lines(spark, gram):
    r = random.Random(gram)
    text = lambda n: "".join(r.choices("ab_é", k=r.randrange(n)))
    names, lines = [text(12) for _ in range(60)] + ["", None, "a", "a"], [text(30) for _ in range(40)] + [None, ""]
    n, g = (spark.createDataFrame([(x,) for x in v], "file_basename string") for v in (names, lines))
    want = {x for x in names if x is not None and any(x in y for y in lines if y is not None)}
    assert sorted(x[0] for x in datasets.contained(n, g, gram).collect()) == sorted(want)
    left = sorted(str(x[0]) for x in datasets.missing_ground(n, g, exact=False).collect())
    assert left == sorted(str(x) for x in names if x not in want)
    plan = datasets.missing_ground(n, g, exact=False)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert datasets.contained(n, g.limit(0), gram).count() == 0


def test_lines_off_a_box_are_not_tried(spark):
    rows = [("p", i, j, f"w{i}_{j}", 10 * j, 10 * i, 10 * j + 8, 10 * i + 8) for i in range(200) for j in range(50)]
    df = spark.createDataFrame(rows, "page string, line_no int, word_no int, text string, x0 int, y0 int, x1 int, y1 int")
    box = {k: F.lit(v) for k, v in {"x0": 100, "y0": 500, "x1": 138, "y1": 528}.items()}
    lines = F.col("lines")
    got = ocr.nested_lines(df, ["page"]).select(ocr.tried(lines, box).alias("tried"), ocr.words_in(lines, box).alias("n"), ocr.box_text(lines, box).alias("text")).first()
    assert (got.n, got.tried) == (12, 150)
    assert [x.strip() for x in got.text.split("\n") if x] == [" ".join(f"w{i}_{j}" for j in range(10, 14)) for i in range(50, 53)]


def test_one_box_for_all_pages_moves_no_words_outside(spark):
    r = random.Random(3)
    rows = [(p, i, None if j < 0 else j, *([None] * 5 if j < 0 else (f"w{i}_{j}", 10 * j, 10 * i, 10 * j + r.randrange(20), 10 * i + r.randrange(12)))) for p in "ab" for i in range(12) for j in (range(r.randrange(9)) or [-1])]
    df = spark.createDataFrame(rows, "page string, line_no int, word_no int, text string, x0 int, y0 int, x1 int, y1 int").repartition(3)
    for corners in ((10, 20, 55, 90), (0, 0, 999, 999), (500, 500, 600, 600)):
        box = {k: F.lit(v) for k, v in zip(("x0", "y0", "x1", "y1"), corners, strict=True)}
        want = ocr.nested_lines(df, ["page"]).select("page", ocr.box_text(F.col("lines"), box).alias("text"), ocr.words_in(F.col("lines"), box).alias("n"))
        text, n = (dict(map(tuple, f(df, ["page"], box).collect())) for f in (ocr.texts_in_box, ocr.words_in_box))
        assert {x.page: (x.text, x.n) for x in want.collect()} == {p: (text[p], n[p]) for p in text} and len(n) == 2
    sent = [line for line in ocr.texts_in_box(df, ["page"], box)._jdf.queryExecution().optimizedPlan().toString().split("\n") if "collect_list" in line]
    assert sent and not any("x0" in line for line in sent)


def test_words_outside_all_boxes_are_lines_alone(spark):
    rows = [(p, i, j, f"w{i}_{j}", 10 * j, 10 * i, 10 * j + 8, 10 * i + 8) for p in "ab" for i in range(20) for j in range(9)]
    rows += [("a", 20, None, *[None] * 5)]
    df = spark.createDataFrame(rows, "page string, line_no int, word_no int, text string, x0 int, y0 int, x1 int, y1 int")
    bounds = spark.createDataFrame([(10, 30, 58, 98)], "x0 int, y0 int, x1 int, y1 int")
    some = ocr.near(df, bounds)
    assert some.columns == df.columns and some.where("text is not null").count() == 2 * 7 * 5
    for corners in ((10, 30, 58, 98), (20, 41, 40, 70), (30, 90, 38, 98)):
        box = {k: F.lit(v) for k, v in zip(("x0", "y0", "x1", "y1"), corners, strict=True)}
        a, b = ({r.page: (r.t, r.n) for r in ocr.nested_lines(w, ["page"]).select("page", ocr.box_text(F.col("lines"), box).alias("t"), ocr.words_in(F.col("lines"), box).alias("n")).collect()} for w in (df, some))
        assert a == b and a["a"][1] > 0
    assert [len(r.lines) for r in ocr.nested_lines(some, ["page"]).orderBy("page").collect()] == [21, 20]


def test_a_small_table_of_long_rows_is_dealt_to_many_tasks(spark, tmp_path):
    """A file of a few bytes is one task by itself; its pages, which take a while each, are not."""
    from foliant.plans import scans

    spark.range(1, 9001).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    tasks = scans._probabilities(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 3 and sum(r[1] for r in tasks) == 9000


def test_growing_and_boxes_beside_plain_ones():
    from foliant.operators import images

    rng = np.random.default_rng(7)
    for h, w, part in ((9, 14, 0.1), (28, 28, 0.02), (1, 7, 0.5), (12, 5, 0.3)):
        mask = rng.random((h, w)) < part
        for by in (1, 2):
            want = [[bool(mask[max(y - by, 0) : y + by + 1, max(x - by, 0) : x + by + 1].any()) for x in range(w)] for y in range(h)]
            assert images._grown(mask, by).tolist() == want
        seen, found = np.zeros_like(mask), []
        for y, x in zip(*np.nonzero(mask), strict=True):
            area, todo = [], [] if seen[y, x] else [(y, x)]
            seen[y, x] = True
            while todo:
                v, u = todo.pop()
                area.append((v, u))
                for b in range(max(v - 1, 0), min(v + 2, h)):
                    for a in range(max(u - 1, 0), min(u + 2, w)):
                        if mask[b, a] and not seen[b, a]:
                            seen[b, a] = True
                            todo.append((b, a))
            if area:
                ys, xs = zip(*area, strict=True)
                found.append((min(xs), min(ys), max(xs), max(ys)))
        assert sorted(images.boxes(mask, 0, 10**6)) == sorted(found)

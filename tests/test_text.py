import pytest
from pyspark.sql import functions as F

from foliant.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


AUTHORS = [
    ("A Conde-Agudelo,* AT Papageorghiou,\"* SH Kennedy,” J Villar®“", "A Conde-Agudelo, AT Papageorghiou, SH Kennedy, J Villar"),
    ("Smith,John", "Smith, ohn"), ("Smith, John", "Smith, John"), ("A\nB", "AB"), ("O'Reilly", "OReilly"), ("A,,B", "A, B"), ("A,,,B", "A, ,"),
    ("A,x'B C, D", "A,"), ("A,", "A,"), ("A,*", "A,"), ("A,*--", "A,"), ("A, B😀C", "A, BC"), ("A,1😀C, D", "A,"),
    ("J. Smith-Jones 1,2 K. Lee", "J. Smith-Jones , K. Lee"), ("", ""), ("A,**B", "A, B"), ("A,1.*B", "A, .B"),
]


def test_clean_authors(spark):
    rows = spark.createDataFrame(AUTHORS, "a string, want string").select("a", "want", tx.clean_authors(F.col("a")).alias("got")).collect()
    assert [(r.a, r.got) for r in rows] == [(r.a, r.want) for r in rows]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("hello", ["hello"]), ("hello-", ["hello"]), ("=hello", ["hello"]), ("hello*", ["hello"]), ("naïve", ["naïve"]), ("hello there", ["hello", "there"]),
        ("hello-there", ["hello", "there"]), ("hello–there", ["hello", "there"]), ("hello—there", ["hello", "there"]), ("hello & there", ["hello", "there"]),
        ("   hello   there   ", ["hello", "there"]), ("*hello-there?", ["hello", "there"]), ("x⁥y⁯z", ["x⁥y⁯z"]),
        ("p q\u001cr　s", ["p", "q", "r", "s"]), ("", []),
    ],
)
def test_tokens(spark, text, want):
    assert value(spark, tx.tokens(F.lit(text))) == want


def test_page_ids(spark):
    p = value(spark, tx.page_id_parts(F.lit("sim_journal-of-thought_2004_fall_39_3_0009")))
    assert tuple(p) == ("sim_journal-of-thought", "sim_journal-of-thought_2004_fall_39_3", 9)
    for bad in ("other_a_b_1", "sim_a_b_x", "sim_a", "sim__1"):
        assert tuple(value(spark, tx.page_id_parts(F.lit(bad)))) == (None, None, None)
    assert value(spark, tx.image_page_id(F.lit("/a/b/sim_x_1.jp2.png"))) == "sim_x_1"


@pytest.mark.parametrize(
    ("path", "want"),
    [("/d/sim_a_1_hocr.html", "sim_a_1"), ("/d/sim_a_1_chocr.html.gz", "sim_a_1"), ("/d/sim_a_1_hocr.html.gz/x", "sim_a_1"), ("/d/sim_a.xml", None)],
)
def test_ocr_issue_ids(spark, path, want):
    assert value(spark, tx.ocr_issue_id(F.lit(path))) == want


def test_lines(spark):
    assert value(spark, tx.one_line(F.lit("  a\nb\\nc   d\t"))) == "a b c d"
    assert value(spark, tx.title_line(F.lit(" a\n\n b  "))) == " a b"
    assert value(spark, tx.escape_newlines(F.lit("a\nb"))) == "a\\nb"
    assert value(spark, tx.finished_authors(F.lit("A&B\nC"))) == "A B, C"
    assert value(spark, tx.fold(F.array(*map(F.lit, ["", "a", "", "b"])), "\n")) == "a\n\nb"
    assert value(spark, tx.fold(F.array().cast("array<string>"), "\n")) == ""
    assert value(spark, tx.short_title(F.lit("x" * 151))) == "x" * 150 + "..."


def test_numbers(spark):
    box = value(spark, tx.full_box(F.lit(0.5), F.lit(1.5), F.lit(2.5), F.lit(10.0)))
    assert tuple(box) == (0, 4, 4, 24)
    assert value(spark, tx.hex_rgb(F.lit("#8000ff"))) == [128, 0, 255]
    assert value(spark, tx.type_bits(F.lit(2), 4)) == [0, 0, 1, 0]
    assert str(value(spark, tx.to_timestamp(F.lit("1999-01-31T00:00:00Z")))) == "1999-01-31 00:00:00"
    assert value(spark, tx.to_timestamp(F.lit("soon"))) is None
    g = spark.range(1).select(*[c.alias(n) for n, c in tx.geometry(F.lit(10), F.lit(20), F.lit(30), F.lit(20), F.lit(100), F.lit(200)).items()]).first()
    assert (g.aspect_ratio, g.page_width_fraction, g.region_size) == (None, 0.2, 0.0)
    assert value(spark, tx.quad_text(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3), F.lit(4))))) == "1,2,3,4"


def test_pretty(spark):
    rows = [("p", 3, k, "T", "A", "r\ns", "c", "why\nnot") for k in (0, 1, 2, 3, 9)]
    df = spark.createDataFrame(rows, "page_id string, page_number int, page_type int, title string, authors string, refs string, toc string, explanation string")
    assert [r[0] for r in df.select(tx.pretty()).collect()] == [
        None, 'p: ARTICLE page 3: why\\nnot\n    "T" by "A"', "p: REFS page 3: why\\nnot\n    r\\ns", "p: TOC page 3: why\\nnot\n    c", "p: UNKNOWN(9) page 3: \n    ",
    ]


def test_predicates(spark):
    rows = [(("j", "p", 1, 2), ("j", "p", 1, 3)), (("j", "p", 1, 2), ("j", "p", 2, 2)), ((None, "p", 1, 2), (None, "p", 1, 2))]
    page = "struct<journal_id:string,page_id:string,page_number:int,page_type:int>"
    df = spark.createDataFrame(rows, f"a {page}, b {page}")
    got = df.select(tx.same_page("a", "b"), tx.same_type("a", "b"), tx.is_type(tx.REFS, F.col("a.page_type"))).collect()
    assert [tuple(r) for r in got] == [(True, False, True), (False, True, True), (True, True, True)]


def test_words_are_told_alike_for_every_character(spark):
    """tokens() names the characters of words, most frequent first; TOKEN, which SQL uses, those between them."""
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([("".join(letters[i : i + 4096]),) for i in range(0, len(letters), 4096)], "t string")
    plain = F.regexp_extract_all("t", F.lit(tx.TOKEN), F.lit(0))
    assert tx.WORD.startswith("[a-zA-Z0-9") and rows.where(tx.tokens(F.col("t")) != plain).count() == 0
    assert rows.select(F.sum(F.size(plain))).first()[0] > 30

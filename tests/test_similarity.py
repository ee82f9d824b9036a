import pytest
from hypothesis import given
from hypothesis import strategies as st

from foliant.functions.similarity import ratio, register
from foliant.operators.scoring import issue_scores, page_scores

PAGE = "issue_id string, page_id string, page_number int, page_type int, title string, authors string, refs string, toc string"


def plain(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[-1], row[j + 1]))
        row = new
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


@given(st.text("abé😀", max_size=12), st.text("abé😀", max_size=12))
def test_ratio_is_that_of_the_longest_common_subsequence(a, b):
    assert ratio(a, b) == pytest.approx(plain(a, b))
    assert ratio(a, b) == ratio(b, a)
    assert 0 <= ratio(a, b) <= 1


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abd", 0.6667), ("kitten", "sitting", 0.6154), ("lewenstein", "levenshtein", 0.8571), ("", "", 1), ("", "a", 0)])
def test_known_ratios(a, b, want):
    assert ratio(a, b) == pytest.approx(want, abs=1e-4)


def page(n, kind, title="", authors="", refs="", toc=""):
    return ("i", f"i_{n}", n, kind, title, authors, refs, toc)


def test_page_scores(spark):
    golden = spark.createDataFrame([page(0, 0), page(1, 1, "title of article", "John Smith, Jane Doe"), page(2, 2, refs="1. a reference " * 9), page(3, 3, toc="x"), page(4, 1, "t")], PAGE)
    check = spark.createDataFrame([page(0, 0, "ignored"), page(1, 1, "title of articl", "John Smith, Jane Do"), page(2, 2, refs=("1. a reference " * 9)[1:]), page(3, 2, refs="x"), page(5, 0)], PAGE)
    got = {r.page_number: r.score for r in page_scores(golden, check, ["issue_id"]).collect()}
    assert got[0] == 1 and got[3] == got[4] == got[5] == 0
    assert 0.94 < got[1] < 0.97
    assert 0.99 < got[2] < 0.999
    r = issue_scores(golden, check, ["issue_id"]).first()
    assert (r.n_pages, r.n_missing, r.n_article, r.n_refs, r.n_toc, r.n_blank) == (5, 2, 2, 1, 1, 1)
    assert r.explanation == " only one file non-contiguous;  2 missing counterpart pages"
    same = issue_scores(golden, golden, ["issue_id"]).first()
    assert same.score == 1 and same.explanation == "5 pages;  articles=2 refs=1 toc=1 blank=1"


def test_unknown_type_is_an_error(spark):
    odd = spark.createDataFrame([page(0, 7)], PAGE)
    with pytest.raises(Exception, match="unknown page type"):
        page_scores(odd, odd, ["issue_id"]).collect()


def test_sql(spark):
    register(spark)
    assert spark.sql("select indel_ratio('abc', 'abd')").first()[0] == ratio("abc", "abd")

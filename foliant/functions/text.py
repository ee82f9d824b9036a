"""Text, id and geometry functions, Column in and Column out, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, further signs, and white space, as classes of a regular expression.
PUNCTUATION = r"!-/:-@\[-`\{-~"
SIGNS = r"\x{A1}-\x{A3}\x{A5}\x{A7}\x{A9}\x{AE}\x{BF}\x{61F}\x{2000}-\x{2064}\x{2066}-\x{206E}"
SPACE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
TOKEN = "[^" + PUNCTUATION + SIGNS + r"\x00-\x20\x{85}\x{A0}\x{1680}\x{2028}\x{2029}\x{3000}" + "]+"
#: The characters of TOKEN named one by one, the most frequent first: a search ends at the range that a letter is in, where a
#: class of what is excluded tries every range for each letter.
WORD = r"[a-zA-Z0-9\x{AA}-\x{AD}\x{7F}-\x{84}\x{86}-\x{9F}\x{A4}\x{A6}\x{A8}\x{AF}-\x{BE}\x{C0}-\x{61E}\x{620}-\x{167F}\x{1681}-\x{1FFF}\x{2065}\x{206F}-\x{2FFF}\x{3001}-\x{10FFFF}]+"
AUTHOR_NOISE = r"!-&(-+\-/:-@\[-`\{-~\x{AE}\x{201C}\x{201D}"
AFTER_COMMA = r",(?s:.)?[" + AUTHOR_NOISE + r"]*(?:['\x{10000}-\x{10FFFF}](?s:.*))?"
NO_AUTHOR_CHAR = r"[^\p{L} ,.\-]"
JOURNAL_PREFIX = "sim_"
BASE_URL = "https://library.example/details"

#: page_type values.
BLANK, ARTICLE, REFS, TOC = range(4)
#: label values of regions, with 0 for the background.
TITLE_LABEL, AUTHORS_LABEL, REFS_LABEL, TOC_LABEL = range(1, 5)
# Names and colours of the labels.
LABEL_NAMES = ["title_article", "authors_article", "refs_article", "toc"]
LABEL_COLOURS = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 0, 128)]


def tokens(text: Column) -> Column:
    """Words between white space, punctuation and control characters; null for null."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def strip(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse(text: Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(text, f"[{SPACE}]+", " ")


def one_line(text: Column) -> Column:
    """One line: newlines, also written as backslash and n, and runs of white space become a space; ends are stripped."""
    return F.trim(collapse(F.replace(text, F.lit("\\n"), F.lit(" "))))


def title_line(text: Column) -> Column:
    """A title as it is stored: one line, without trailing space; a leading one stays."""
    return F.rtrim(collapse(text))


def escape_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def clean_authors(text: Column) -> Column:
    """Authors without affiliation marks.

    A comma takes the next character with it, whatever it is, and the noise after that; where an apostrophe or a
    character beyond the basic plane follows, the rest is lost. Then all but letters, spaces, commas, full stops and
    hyphens goes, newlines too, and runs of spaces become one.
    """
    kept = F.regexp_replace(F.regexp_replace(text, AFTER_COMMA, ", "), NO_AUTHOR_CHAR, "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def finished_authors(text: Column) -> Column:
    """Authors of an article in an issue's result: ampersands become spaces, newlines become commas."""
    return F.replace(F.replace(text, F.lit("&"), F.lit(" ")), F.lit("\n"), F.lit(", "))


def journal_id(any_id: Column) -> Column:
    """Prefix and what follows it up to the next underscore; null if the id has another form."""
    return F.nullif(F.regexp_extract(any_id, f"^({JOURNAL_PREFIX}[^_]+)_", 1), F.lit(""))


def page_id_parts(page_id: Column) -> Column:
    """struct(journal_id, issue_id, page_number); all null if the id lacks the prefix, a journal or a numeric last part."""
    number = F.substring_index(page_id, "_", -1).try_cast("int")
    issue = F.regexp_extract(page_id, r"^(.*)_[^_]*$", 1)
    good = F.startswith(page_id, F.lit(JOURNAL_PREFIX)) & number.isNotNull() & journal_id(page_id).isNotNull()
    return F.struct(F.when(good, journal_id(page_id)).alias("journal_id"), F.when(good, issue).alias("issue_id"), F.when(good, number).alias("page_number"))


def image_page_id(path: Column) -> Column:
    """The file's name up to its first full stop."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def ocr_issue_id(path: Column) -> Column:
    """The issue id in an OCR path: its first part that ends in a known suffix, without it; null if there is none."""
    found = F.regexp_extract(path, r"(?:^|/)([^/]+?)[^/]c?hocr\.html(?:\.gz)?(?:/|$)", 1)
    return F.nullif(found, F.lit(""))


def image_basename(name: Column) -> Column:
    """File name without its folder and without image suffixes, wherever those stand."""
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), (".jpg", ".png", ".JPG", ".PNG"), F.substring_index(name, "/", -1))


def image_page_number(name: Column) -> Column:
    """The number after the last underscore of an image's name; null if there is none."""
    return F.substring_index(image_basename(name), "_", -1).try_cast("int")


def is_image(name: Column) -> Column:
    return F.rlike(name, F.lit(r"\.(jpg|png)$"))


def to_timestamp(text: Column) -> Column:
    """Timestamps like 1999-01-31T00:00:00Z; null if not of that form."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def fold(texts: Column, separator: str) -> Column:
    """All texts in order; the separator comes before a text only if there is something before it."""
    return F.aggregate(texts, F.lit(""), lambda all, x: F.when(F.length(all) > 0, F.concat(all, F.lit(separator), x)).otherwise(x))


def pretty() -> Column:
    """A line for people about an excerpt, from its columns; null for a blank page."""
    note, kind = escape_newlines(F.col("explanation")), F.col("page_type")
    head = lambda name: F.concat(F.col("page_id"), F.lit(f": {name} page "), F.col("page_number").cast("string"), F.lit(": "))
    text = lambda c: F.concat(note, F.lit("\n    "), escape_newlines(F.col(c)))
    by = F.concat(note, F.lit('\n    "'), F.col("title"), F.lit('" by "'), F.col("authors"), F.lit('"'))
    unknown = F.concat(F.col("page_id"), F.lit(": UNKNOWN("), kind.cast("string"), F.lit(") page "), F.col("page_number").cast("string"), F.lit(": \n    "))
    return (
        F.when(kind == BLANK, F.lit(None).cast("string"))
        .when(kind == ARTICLE, F.concat(head("ARTICLE"), by))
        .when(kind == REFS, F.concat(head("REFS"), text("refs")))
        .when(kind == TOC, F.concat(head("TOC"), text("toc")))
        .otherwise(unknown)
    )


def is_type(kind: int, page_type: Column | None = None) -> Column:
    """Whether a page is of a type: BLANK, ARTICLE, REFS or TOC."""
    return (F.col("page_type") if page_type is None else page_type) == kind


def same_page(a: str, b: str) -> Column:
    """Whether two excerpts, given as names of struct columns, are of one page: journal, id and number."""
    each = [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in ("journal_id", "page_id", "page_number")]
    return each[0] & each[1] & each[2]


def same_type(a: str, b: str) -> Column:
    return F.col(f"{a}.page_type").eqNullSafe(F.col(f"{b}.page_type"))


def page_type_of_label(label: Column) -> Column:
    """The type of a page that an annotation with this label makes; null for other labels."""
    return F.when(label.isin(TITLE_LABEL, AUTHORS_LABEL), ARTICLE).when(label == REFS_LABEL, REFS).when(label == TOC_LABEL, TOC)


def full_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """struct(x0, y0, x1, y1) on the full-size image, of a half-size box: each number rounded half to even, then doubled."""
    r = lambda c: F.bround(c).cast("long")
    return F.struct((2 * r(x)).alias("x0"), (2 * r(y)).alias("y0"), (2 * (r(x) + r(w))).alias("x1"), (2 * (r(y) + r(h))).alias("y1"))


def geometry(a: Column, b: Column, c: Column, d: Column, width: Column, height: Column) -> dict[str, Column]:
    """Features of a region with corners (a, b) and (c, d) on a page; a ratio by zero is null."""
    w, h = F.try_divide(c - a, width), F.try_divide(d - b, height)
    return {
        "aspect_ratio": F.try_divide(c - a, d - b),
        "page_width_fraction": w,
        "page_height_fraction": h,
        "normalized_x": F.try_divide(a, width),
        "normalized_y": F.try_divide(b, height),
        "region_size": w * h,
    }


def quad_text(quad: Column) -> Column:
    """Corner coordinates of a region, comma-joined."""
    return F.array_join(F.transform(F.flatten(quad), lambda x: x.cast("string")), ",")


def label_colour(label: Column) -> Column:
    return F.get(F.array(*[F.array(*map(F.lit, c)) for c in LABEL_COLOURS]), label)


def hex_rgb(colour: Column) -> Column:
    """Red, green and blue of a colour like #8000ff."""
    return F.array(*[F.conv(F.substring(colour, i, 2), 16, 10).cast("int") for i in (2, 4, 6)])


def type_bits(index: Column, length: int) -> Column:
    """Zeros with a one at the index."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: (j == index).cast("int"))


def short_title(title: Column, size: int = 150) -> Column:
    return F.when(F.length(title) > size, F.concat(F.substring(title, 1, size), F.lit("..."))).otherwise(title)


def page_url(issue_id: Column, page: Column, base: str = BASE_URL) -> Column:
    return F.concat(F.lit(f"{base}/"), issue_id, F.lit("/page/n"), page.cast("string"), F.lit("/mode/1up?admin=1"))


def issue_url(issue_id: Column, base: str = BASE_URL) -> Column:
    return F.concat(F.lit(f"{base}/"), issue_id, F.lit("/?admin=1"))

"""Text of a page inside a box, from words with bounding boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import strip


def nested_lines(words: DataFrame, page: list[str]) -> DataFrame:
    """One row for each page: lines, an array in order of struct(words, y0, y1), where words are struct(word_no, text, x0, y0, x1, y1)
    in order, y0 is their greatest upper edge and y1 their least lower one (nulls for a line without words).

    words has the page columns, line_no, word_no (null for a line without words), text, x0, y0, x1 and y1.
    """
    word = F.struct("word_no", "text", "x0", "y0", "x1", "y1")
    there = F.when(F.col("word_no").isNotNull(), word)
    line = words.groupBy(*page, "line_no").agg(F.array_sort(F.collect_list(there)).alias("words"), F.max("y0").alias("y0"), F.min("y1").alias("y1"))
    of_line = lambda x: F.struct(x["words"].alias("words"), x["y0"].alias("y0"), x["y1"].alias("y1"))
    return line.groupBy(*page).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "words", "y0", "y1"))), of_line).alias("lines"))


def near(words: DataFrame, bounds: DataFrame) -> DataFrame:
    """words without those that lie outside the bounds (one row: x0, y0, x1, y1) of all boxes that will be asked for: what is left of them is
    their line. Only the lines' numbers and words that some box can hold move then; texts of such boxes stay what they are."""
    bounds = F.broadcast(bounds.select(*[F.col(c).alias(f"__{c}") for c in ("x0", "y0", "x1", "y1")]))
    there = F.coalesce(inside({c: F.col(c) for c in ("x0", "y0", "x1", "y1")}, {c: F.col(f"__{c}") for c in ("x0", "y0", "x1", "y1")}), F.lit(False))
    own = ("word_no", "text", "x0", "y0", "x1", "y1")
    return words.crossJoin(bounds).select(*[F.when(there, F.col(c)).alias(c) if c in own else F.col(c) for c in words.columns])


def inside(word: Column, box: dict[str, Column]) -> Column:
    """Whether a word lies in a box, edges included."""
    return (box["x0"] <= word["x0"]) & (box["x1"] >= word["x1"]) & (box["y0"] <= word["y0"]) & (box["y1"] >= word["y1"])


def reaches(line: Column, box: dict[str, Column]) -> Column:
    """Whether a line can have a word in a box. Two comparisons spare those of all its words if it lies above or below."""
    return F.coalesce((box["y0"] <= line["y0"]) & (box["y1"] >= line["y1"]), F.lit(False))


def tried(lines: Column, box: dict[str, Column]) -> Column:
    """Number of words that box_text() and words_in() compare with a box."""
    return F.aggregate(F.filter(lines, lambda x: reaches(x, box)), F.lit(0), lambda n, x: n + F.size(x["words"]))


def box_text(lines: Column, box: dict[str, Column]) -> Column:
    """Text of the words in a box.

    Every line of the page ends in a newline, with words or without, and every word in a space; then the ends of the
    whole are stripped. A page without lines, or an unknown page, has the empty text.
    """
    found = lambda ws: F.array_join(F.transform(F.filter(ws, lambda w: inside(w, box)), lambda w: F.concat(w["text"], F.lit(" "))), "")
    of_line = lambda x: F.when(reaches(x, box), found(x["words"])).otherwise("")
    return F.coalesce(strip(F.array_join(F.transform(lines, of_line), "\n")), F.lit(""))


def words_in(lines: Column, box: dict[str, Column]) -> Column:
    """Number of a page's words in a box."""
    of_line = lambda n, x: n + F.when(reaches(x, box), F.size(F.filter(x["words"], lambda w: inside(w, box)))).otherwise(0)
    return F.coalesce(F.aggregate(lines, F.lit(0), of_line), F.lit(0))


def texts_in_box(words: DataFrame, page: list[str], box: dict[str, Column]) -> DataFrame:
    """page columns and text, as box_text() gives it, where the box is the same for all pages. Of words outside nothing moves, and of
    a line no more than its number and its text."""
    word = F.struct("word_no", "text")
    there = F.when(F.col("word_no").isNotNull() & inside({c: F.col(c) for c in ("x0", "y0", "x1", "y1")}, box), word)
    line = words.select(*page, "line_no", there.alias("word")).groupBy(*page, "line_no").agg(F.array_sort(F.collect_list("word")).alias("words"))
    found = F.array_join(F.transform("words", lambda w: F.concat(w["text"], F.lit(" "))), "")
    lines = line.select(*page, F.struct("line_no", found.alias("text")).alias("line")).groupBy(*page).agg(F.array_sort(F.collect_list("line")).alias("lines"))
    return lines.select(*page, F.coalesce(strip(F.array_join(F.transform("lines", lambda x: x["text"]), "\n")), F.lit("")).alias("text"))


def words_in_box(words: DataFrame, page: list[str], box: dict[str, Column]) -> DataFrame:
    """page columns and n_words, as words_in() gives it, where the box is the same for all pages: a count."""
    there = F.col("word_no").isNotNull() & inside({c: F.col(c) for c in ("x0", "y0", "x1", "y1")}, box)
    return words.groupBy(*page).agg(F.count_if(there).cast("int").alias("n_words"))

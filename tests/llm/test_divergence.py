"""Operator 12 beside plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from foliant.llm import divergence

DOC = "text string, lang string, source string, rank string, n string"
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top=10):
    counts, docs, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        group = (lang or "", source or "")
        groups.add(group)
        found = WORD.findall((text or "").translate(UPPER))
        for w in found:
            counts[group, w] += 1
        for w in set(found):
            docs[group[0], w] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (x, w), n in docs.items() if x == lang and n >= least)
        mine = sorted(s for x, s in groups if x == lang)
        share = {}
        for s in [*mine, None]:
            c = {w: sum(counts[(lang, x), w] for x in mine) if s is None else counts[(lang, s), w] for w in kept}
            n = sum(c.values())
            share[s] = {w: 1 + 10**9 * (c[w] + 2) // (n + 2 * len(kept)) for w in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in mine:
            pair = [(-sum(f(share[s][w], share[o][w]) for w in kept), o) for o in mine if o != s]
            own = [(-f(share[s][w], share[None][w]), w) for w in kept if counts[(lang, s), w] and share[s][w] > share[None][w]]
            for part, items in (("pair", sorted(pair)), ("term", sorted(own)[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, item) in enumerate(items, 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("small", [False, True])
def test_values_and_ranks(spark, monkeypatch, small):
    if small:  # many blocks, tiles of groups, slices of texts and parts of counts
        for name, value in {"BLOCK_TERMS": 3, "GROUP_TILE": 2, "SLICE_BYTES": 7, "HELD_TERMS": 5, "BLOCK_CELLS": 8}.items():
            monkeypatch.setattr(divergence, name, value)
    r = random.Random(3)
    vocabulary = ["a", "B", "é", "Éa", "ab's", "x1y", "😀", "zz", "ß", "tie", "Tie", "long" * 9]
    rows = [(" ".join(r.choices(vocabulary, k=r.randrange(30))), r.choice(["en", "de", None]), r.choice(["s1", "s2", "s3", "ü", None])) for _ in range(150)]
    rows += [(None, "en", "silent"), ("", "fr", "one"), ("rare", "fr", "two"), ("a B", "it", "alone")] + [rows[0]] * 3
    df = spark.createDataFrame([(*x, "c", "c") for x in rows], DOC).repartition(4)
    assert rows_of(divergence.divergence(df, 4)) == brute(rows, 4)


def test_languages_without_kept_terms_and_empty_tables(spark):
    df = spark.createDataFrame([("x", "en", "a", "", ""), ("y", "en", "b", "", ""), (None, None, None, "", "")], DOC)
    assert rows_of(divergence.divergence(df)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert rows_of(divergence.divergence(df.limit(0))) == []


def test_shares_of_large_counts():
    big = 7_000_000_000_000_000
    counts, total = np.array([2, 10**12, big], np.int64), big
    assert divergence.share(counts, total).tolist() == [1 + 10**9 * int(c) // big for c in counts]


def test_long_texts_are_split_at_separators():
    text = "ab cd " * 300_000 + "x" * 1_200_000 + " e"
    got = Counter(w for part in divergence.words(text) for w in part)
    assert got == Counter({b"ab": 300_000, b"cd": 300_000, b"x" * 1_200_000: 1, b"e": 1})

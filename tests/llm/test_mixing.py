"""Operator 13: sizes, targets and epochs beside plain Python, the selection beside a full sort."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import mixing

DOC = "doc_id long, text string, source string, size string, target string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(1, 2, 3), epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, live, out = sum(sizes.values()), set(names), {}
    while live:
        unit = left / sum(weight[s] for s in live)
        over = {s for s in live if epochs * sizes[s] < unit * weight[s]}
        if not over:
            break
        out |= {s: float(epochs * sizes[s]) for s in over}
        left -= sum(epochs * sizes[s] for s in over)
        live -= over
    return out | {s: unit * weight[s] for s in live}


def made(seed=1, n=600):
    r = random.Random(seed)
    source = lambda: r.choice(["a", "b", "c", "ü", None, "tiny", *["hot"] * 5])
    rows = [(i, " ".join(r.choices(["one", "two", "#", "é"], k=r.randrange(60))), source()) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", "nothing"), (n + 2, "w " * 5000, "hot"), (None, "no id here", None)] + [(-7, "same row again", "copies")] * 40


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_targets_epochs_and_nearness(spark):
    rows = made()
    df = spark.createDataFrame([(*x, "c", "c") for x in rows], DOC).repartition(5)
    got = mixing.mixed(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(x[0] for x in rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want = targets(sizes)
    source_of = {x[0]: x[2] for x in rows}
    taken, longest = Counter(), Counter()
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s])
        times = r.taken / r.size if r.size else 0
        whole = int(want[s] / sizes[s] + 1e-12) if sizes[s] else 0
        assert times in (min(3, whole), min(3, whole + 1)) or not r.size and not r.taken
        taken[s] += r.taken
        longest[s] = max(longest[s], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1e-6, s
    assert any(0 < sum(r.taken > (r.source_size and r.size * int(r.target / r.source_size)) for r in got if source_of[r.doc_id] == s) for s in want)


def test_the_selection_is_a_prefix_by_exponential_keys(spark):
    """Key of each row, sorted whole; the mix must take a prefix of it, and heavier documents come earlier."""
    r = np.random.default_rng(4)
    h = r.integers(-(2**63), 2**63 - 1, 900).tolist()
    rows = [(i, f"0s{i % 2}", h[i], int(r.integers(1, 50)), 9.0 if i % 3 == 0 else 1.0) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, s string, h long, n long, w double").repartition(4)
    got = {x.doc_id: x for x in mixing.mix(df, F.col("w"), F.col("n")).collect()}
    key = lambda x: -np.log(((x[2] % 2**64 >> 11) + 0.5) / 2**53) / x[4]
    for s in ("0s0", "0s1"):
        mine = sorted((x for x in rows if x[1] == s), key=key)
        some = got[mine[0][0]]
        more = [got[x[0]].taken - x[3] * int(some.target // some.source_size) > 0 for x in mine]
        assert more == sorted(more, reverse=True)
        part = (some.target % some.source_size) / some.source_size
        heavy = [m for x, m in zip(mine, more, strict=True) if x[4] == 9.0]
        assert sum(heavy) / len(heavy) > min(0.99, part)


def test_reruns_agree_and_partitions_do_not_matter(spark):
    df = spark.createDataFrame([(*x, "c", "c") for x in made(2, 200)], DOC)
    assert rows_of(mixing.mixed(df.repartition(3))) == rows_of(mixing.mixed(df.repartition(7)))


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([(1, None, "a", "", ""), (None, " ", None, "", "")], DOC)
    assert rows_of(mixing.mixed(df.limit(0))) == []
    assert {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mixed(df).collect()} == {(1, 0, 0, 0.0, 0), (None, 0, 0, 0.0, 0)}


def test_copies_of_one_row_are_cut_where_the_target_is(spark):
    """A source that is one row many times over is taken to its target, not all or nothing."""
    rows = [(1, "a b c d e", "a", "", "")] * 300 + [(2, "x " * 100, "b", "", "")] * 9
    got = mixing.mixed(spark.createDataFrame(rows, DOC).repartition(4)).collect()
    for s in (1, 2):
        mine = [r for r in got if r.doc_id == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= mine[0].size

"""Everyday forms, long texts, gates and keywords of operator 9."""

import random
import re
import time

from foliant.llm import licenses


def scanned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return [r for _, r in sorted((r.doc_id, r) for r in licenses.scan(rows).collect())]


EVERYDAY = {
    "GPLv3 or later": "gpl-3.0", "Licensed GPLv2": "gpl-2.0", "AGPLv3": "agpl-3.0", "LGPLv2.1": "lgpl-2.1", "Apache-2.0": "apache-2.0", "License: MIT": "mit", "license: Apache-2.0": "apache-2.0",
    "(MIT)": "mit", "MIT licensed code": "mit", "BSD-style license": "bsd", "ISC licensed": "isc", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0", "license = \"MPL-2.0\"": "mpl-2.0", "License :: OSI: (zlib)": "zlib",
}


def test_everyday_forms(spark):
    got = scanned(spark, list(EVERYDAY))
    assert {t: r.labels for t, r in zip(EVERYDAY, got, strict=True)} == EVERYDAY
    assert all(r.n_base == 0 and r.base_labels == "" and 0 < r.score <= 1 for r in got)


def test_prose_is_left_alone(spark):
    texts = ["The mitten was limited and simply apt.", "an apache helicopter and 2 wolves", "submit (mitigated) results", "for a licensee", "gplus accounts, ample tables", "x11forward (bsdx)", "MIT researchers say so"]
    assert [r.labels for r in scanned(spark, texts)] == [""] * len(texts)


def test_names_in_parentheses_do_not_move_words(spark):
    text = "(MIT) License and (mit) license, then apache license (ISC)"
    r = scanned(spark, [text])[0]
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == (9, 3, 0, 6, "apache,mit", "apache,isc,mit")
    found = {(d.label, d.start, d.end) for d in licenses.detections(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect() if d.rule == -1}
    assert found == {("mit", 0, 1), ("mit", 3, 4), ("isc", 8, 9)}


def test_places_in_a_long_text_take_time_by_its_length(spark):
    """100,000 matches in 2 MB: first and last places, and time in proportion to a text of a quarter."""
    unit = "MIT License and then some"
    times = []
    for n in (25_000, 100_000):
        text = " ".join([unit] * n)
        began = time.time()
        r = scanned(spark, [text])[0]
        times.append(time.time() - began)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.labels) == (5 * n, n, 0, 5 * (n - 1), "mit")
    assert times[1] < 6 * times[0] + 5


def test_keywords_begin_words_and_groups_hold_their_rules():
    own = licenses.rules()
    of_group = licenses.groups(own)
    sample = random.Random(4).sample(own, 400)
    from tests.llm.test_operators import one_match

    rng = random.Random(5)
    for rule in sample:
        tree = re._parser.parse(rule["pattern"])
        for text in {one_match(tree, rng) for _ in range(20)}:
            assert any(re.search(f"(?:^| ){re.escape(k)}", text) for k in rule["keywords"]), (rule, text)
            assert re.search(of_group[rule["group"]], text), (rule, text)


def test_word_trees_match_what_their_words_do():
    rng = random.Random(6)
    for _ in range(50):
        words = list({"".join(rng.choices("ab1", k=rng.randint(1, 4))) for _ in range(6)})
        tree = re.compile(f"(?:{licenses._tree(words)})$")
        for _ in range(50):
            s = "".join(rng.choices("ab1", k=rng.randint(1, 5)))
            assert bool(tree.match(s)) == (s in words)

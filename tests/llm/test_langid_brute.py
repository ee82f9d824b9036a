"""Operator 3 beside a plain interpolated Kneser-Ney model: language, score, cross-entropy and rejection."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from foliant.llm import langid

WORD = re.compile(r"[^\W\d_]+")
N, D = langid.ORDER, langid.DISCOUNT


class Plain:
    """Counts of n-grams in dictionaries; the probability of a character by recursion over its context."""

    def __init__(self, words: Counter):
        self.count = {k: Counter() for k in range(1, N + 1)}
        before = {k: defaultdict(set) for k in range(1, N)}
        for w, n in words.items():
            s = "\x02" * (N - 1) + w + "\x03"
            for i in range(N - 1, len(s)):
                self.count[N][s[i - N + 1 : i + 1]] += n
                for k in range(1, N):
                    before[k][s[i - k + 1 : i + 1]].add(s[i - k])
        for k in range(1, N):
            self.count[k] = Counter({g: len(x) for g, x in before[k].items()})
        self.total = {k: Counter() for k in self.count}
        self.kinds = {k: Counter() for k in self.count}
        for k, grams in self.count.items():
            for g, n in grams.items():
                self.total[k][g[:-1]] += n
                self.kinds[k][g[:-1]] += 1
        self.floor = 1 / (len({g for g in self.count[1]}) + 1)

    def p(self, gram: str) -> float:
        k = len(gram)
        lower = self.p(gram[1:]) if k > 1 else self.floor
        total = self.total[k][gram[:-1]]
        if not total:
            return lower
        return max(self.count[k][gram] - D, 0) / total + D * self.kinds[k][gram[:-1]] / total * lower

    def entropy(self, words: list[str]) -> tuple[int, float]:
        logs, n = 0.0, 0
        for w in words:
            s = "\x02" * (N - 1) + w + "\x03"
            for i in range(N - 1, len(s)):
                logs += math.log(self.p(s[i - N + 1 : i + 1]))
                n += 1
        return n, -logs / n


def test_predictions_by_brute_force():
    r = random.Random(8)
    make = {x: ["".join(r.choices(letters, k=r.randint(1, 7))) for _ in range(300)] for x, letters in (("aa", "abcdeé"), ("bb", "abxyzü"), ("cc", "мнопab"))}
    words = {x: Counter(r.choices(ws, k=900)) for x, ws in make.items()}
    models = langid.LanguageModels({x: langid.train_language(w) for x, w in words.items()})
    models.limits = {"aa": 1.9, "bb": math.inf, "cc": 1.2}
    plain = {x: Plain(w) for x, w in words.items()}
    mixed = [w for ws in make.values() for w in ws] + ["NEW", "ß", "qq", "ab"]
    texts = [" ".join(r.choices(mixed if i % 3 else make["aa"], k=r.randint(1, 12))) + r.choice(["", " 12_", "!"]) for i in range(120)] + [None, "", "12 _ ²"]
    names, scores, entropies, rejected = models.predict(texts)
    for i, t in enumerate(texts):
        found = WORD.findall(t.lower()) if t else []
        if not any(any(map(str.isalpha, w)) for w in found):
            assert (names[i], scores[i], entropies[i], rejected[i]) == ("und", 0.0, None, True)
            continue
        h = {x: m.entropy(found) for x, m in plain.items()}
        best = min(sorted(h), key=lambda x: h[x][1])
        n = h[best][0]
        assert names[i] == best and entropies[i] == pytest.approx(h[best][1], rel=1e-9)
        assert scores[i] == pytest.approx(1 / sum(math.exp((h[best][1] - v) * min(n, 40)) for _, v in h.values()), rel=1e-6)
        assert rejected[i] == (h[best][1] > models.limits[best] + 5 / math.sqrt(n))
    assert {False, True} <= set(rejected[:120]) and len(set(names)) >= 3


def test_languages_that_tie_go_to_the_first_name():
    same = langid.train_language(Counter(["hello", "there"]))
    assert langid.LanguageModels({"zz": same, "aa": same}).predict(["hello"])[0] == ["aa"]

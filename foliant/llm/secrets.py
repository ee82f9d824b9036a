"""Secrets in texts: three fixed patterns, and strings that look drawn at random.

A string is scored by two character Markov models, one of random strings and one of ordinary identifiers, both trained
from labelled samples; the mean log-likelihood ratio of a character decides. Samples are drawn by rule, and fit() adds those
that documents label themselves: what the patterns find is random, names made of a text's own words are not. Strings that look
random but are public by their class are left alone: UUIDs, digests that name their function, times, and text in base64.
Spans count code points, end exclusive.

Null texts count as empty and have no spans. Texts are scanned whole. Repeated rows are scanned each; an empty table
gives an empty result; input columns that have the name of a result are replaced. Spans that start at the same place go by
kind, as listed; a random string that overlaps a base span is left to it; a score at the threshold is no secret.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.base import annotate, field, table

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

#: What the models judge: runs of these characters, of at least so many.
CANDIDATE = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_=-]{16,}(?![\w+/=-])")
LEAST = 16
CLASSES = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Samples of each label that the default models are trained from.
SAMPLES = 4000

#: Documents that fit() takes samples from, those with the least hash of id and text, and samples of each label from one.
FIT_ROWS, FIT_STRINGS = 2000, 4
#: Classes of strings that are no secrets, whatever the models say.
PUBLIC = {
    "uuid": re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    "digest": re.compile(r"(?ai:sha(?:1|224|256|384|512)|md5)[-_=/][A-Za-z0-9+/_=-]+"),
    "time": re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-][0-9]{2}[-_]?[0-9]{2}[-_]?[0-9]{0,2}Z?"),
}


def public_class(string: str) -> str | None:
    """The class of a string that is no secret though it may look random; None for others."""
    for name, shape in PUBLIC.items():
        if shape.fullmatch(string):
            return name
    core = string.rstrip("=")
    if len(core) % 4 == 1 or any(c in core for c in "=") or string.islower() or string.isupper():
        return None
    try:
        text = base64.b64decode(core.translate(_URL_SAFE) + "=" * (-len(core) % 4), validate=True).decode("utf-8")
    except ValueError:  # no base64, or no text in it
        return None
    return "base64 text" if text.isprintable() or all(c.isprintable() or c in "\n\r\t" for c in text) else None


NAME_PART = re.compile(r"(?a:\b[A-Za-z]{3,}\b)")
_URL_SAFE = str.maketrans("-_", "+/")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kept matches of the three patterns as (kind, start, end), by start and then kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


LOWER, UPPER, DIGITS = CLASSES[:26], CLASSES[26:52], CLASSES[52:62]
#: Alphabets that random strings are drawn from.
ALPHABETS = [LOWER + UPPER + DIGITS, CLASSES[:64], LOWER + DIGITS, UPPER + DIGITS, DIGITS + "abcdef", LOWER + UPPER + DIGITS + "_-", LOWER + UPPER, LOWER, UPPER]
#: Beginnings, middles and ends of syllables of words in several languages.
ONSETS = "b c d f g h j k l m n p qu r s t v w z bl br ch cl cr dr fl fr gl gr kn pf ph pl pr sch schl schw sh sk sl sm sn sp spr st str th thr tr tz wh zw".split() + [""] * 8
NUCLEI = "a e i o u ai au aux ea eau ee ei eu eux ia ie io oa oi oo ou ui".split() + list("aeiou") * 4
CODAS = "b cht ck ct d ft g gh l ld lich ll ly m mb mm mp n nd ng nn ns nt p pf r rb rch rd rg rl rm rn rs rt s sch ss st t th tion tt ty tz ung ble heit keit mente ment ness que x".split() + [""] * 16


def labelled_samples(n: int = SAMPLES, seed: int = 7) -> list[tuple[str, int]]:
    """n random strings (label 1) and n ordinary identifiers, words and numbers (label 0), the same for the same seed."""
    rng = random.Random(seed)
    out = [("".join(rng.choices(rng.choice(ALPHABETS), k=rng.randint(LEAST, 48))), 1) for _ in range(n)]
    word = lambda: "".join(rng.choice(ONSETS) + rng.choice(NUCLEI) + rng.choice(CODAS) for _ in range(rng.randint(1, 4)))
    for _ in range(n):
        if rng.random() < 0.15:  # numbers, some with a separator every four digits
            digits = "".join(rng.choices(DIGITS, k=rng.randint(LEAST, 32)))
            out.append((digits if rng.random() < 0.7 else "-".join(digits[i : i + 4] for i in range(0, len(digits), 4)), 0))
            continue
        words = [word() for _ in range(rng.randint(1, 5))]
        while sum(map(len, words)) < LEAST:
            words.append(word())
        style = rng.randrange(6)
        name = {0: "_".join, 1: "-".join, 2: "/".join, 3: "".join}.get(style, lambda ws: "".join(w.capitalize() for w in ws))(words)
        name = name.upper() if rng.random() < 0.2 else name
        out.append((name + (str(rng.randint(0, 2030)) if rng.random() < 0.2 else ""), 0))
    return out


class MarkovPair:
    """First-order models of characters by label, with add-half smoothing, and the threshold on their mean log ratio."""

    def __init__(self, samples: list[tuple[str, int]], margin: float = 0.1):
        size = len(CLASSES) + 1  # and one state for the ends
        self.index = np.full(128, size - 1, np.int64)
        for i, c in enumerate(CLASSES):
            self.index[ord(c)] = i
        counts = np.full((2, size, size), 0.5)
        for text, label in samples:
            s = self.states(text)
            np.add.at(counts[label], (s[:-1], s[1:]), 1)
        logs = np.log(counts / counts.sum(axis=2, keepdims=True))
        self.ratio = logs[1] - logs[0]
        scores = {k: np.array([self.score(t) for t, label in samples if label == k] or [0.0]) for k in (0, 1)}
        #: Above all but a thousandth of the ordinary samples and above even odds, by a margin.
        self.threshold = max(0.0, float(np.quantile(scores[0], 0.999))) + margin

    def states(self, text: str) -> np.ndarray:
        end = len(CLASSES)
        return np.concatenate([[end], self.index[np.frombuffer(text.encode("ascii"), np.uint8) & 127], [end]])

    def score(self, text: str) -> float:
        """Mean log-likelihood ratio of a character; the higher, the likelier drawn at random."""
        s = self.states(text)
        return float(self.ratio[s[:-1], s[1:]].mean())


_DEFAULT: list[MarkovPair] = []


def default_model() -> MarkovPair:
    if not _DEFAULT:
        _DEFAULT.append(MarkovPair(labelled_samples()))
    return _DEFAULT[0]


def labelled_strings(text: str | None, most: int = FIT_STRINGS) -> list[tuple[str, int]]:
    """Strings that a text labels itself: secrets that the patterns find (1), and names made of its neighbouring words (0)."""
    if not text:
        return []
    spans = base_spans(text)
    found = [(ASSIGN.match(text, a)[1] if kind == "assign" else text[a:b], 1) for kind, a, b in spans]
    found = [(x, y) for x, y in found if len(x) >= LEAST and re.fullmatch(f"[{re.escape(CLASSES)}]+", x) and not public_class(x)][:most]
    rest, at = [], 0
    for _, a, b in spans:
        rest += [text[at:a], "\0"]
        at = max(at, b)
    rest = "".join([*rest, text[at:]])
    for i in range(most):  # from places all over the text
        some, n = [], 0
        for m in NAME_PART.finditer(rest, i * len(rest) // most):
            some.append(m[0])
            n += len(m[0])
            if n >= LEAST:
                found.append((("_", "-", "")[i % 3].join(some) if i % 2 else "".join(w.capitalize() for w in some), 0))
                break
    return found


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> MarkovPair:
    """Models from the drawn samples and those of at most `rows` documents; what moves, and reaches the driver, are those samples."""
    t = docs[f"`{text}`"]
    order = F.xxhash64(docs[f"`{doc_id}`"].cast("string"), t)
    known = docs.select(order.alias("order"), t.alias("text")).where("text is not null")
    share = (2.0 * rows + 100) / max(1, known.count())  # about twice as many as needed, so that only those are looked through
    few = known.where((F.col("order") / F.lit(2.0**64) + 0.5) < min(1.0, share))

    def make():
        def run(texts):
            found = [labelled_strings(t) for t in texts]
            return [[[x for x, _ in f] for f in found], [[y for _, y in f] for f in found]]

        return run

    got = annotate(few, make, [field("strings", "array<string>"), field("labels", "array<int>")], carry=["order"])
    got = got.dropDuplicates(["order"]).orderBy("order").limit(rows).collect()  # repeated rows count once
    return MarkovPair(labelled_samples() + [(x, y) for r in got for x, y in zip(r["strings"], r["labels"], strict=True)])


def find(text: str | None, model: MarkovPair) -> tuple[list, list]:
    """Base spans, and all spans: the base ones and the random strings that overlap none of them."""
    if not text:
        return [], []
    base = base_spans(text)
    ends = list(accumulate((b for _, _, b in base), max))  # of base spans in order of start: the furthest end so far
    starts = [a for _, a, _ in base]
    more = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        k = bisect_left(starts, b)  # base spans that start before b
        if k and ends[k - 1] > a:
            continue
        if model.score(m[0]) > model.threshold and not public_class(m[0]):
            more.append(("random", a, b))
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str | None, spans: list, mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by a mark."""
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], mark]
            at = b
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, model: MarkovPair | None = None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end by start, comma-joined)."""

    def make():
        m = model or default_model()

        def run(texts):
            out = [[], [], [], [], []]
            for t in texts:
                base, spans = find(t, m)
                for i in range(3):
                    out[i].append(sum(k == KINDS[i] for k, _, _ in base))
                out[3].append(hashlib.sha256(written(base).encode()).hexdigest())
                out[4].append(written(spans))
            return out

        return run

    fields = [*(field(f"n_{k}", "long") for k in KINDS[:3]), field("base_sha256", "string"), field("spans", "string")]
    return annotate(docs, make, fields, text, carry)


def redacted(docs: DataFrame, model: MarkovPair | None = None, text: str = "text") -> DataFrame:
    """docs with every found secret replaced in the text column; null texts stay null."""

    def make():
        m = model or default_model()
        return lambda texts: [[redact(t, find(t, m)[1]) for t in texts]]

    order = docs.columns
    return annotate(docs, make, [field(text, "string")], text).select(*[f"`{c}`" for c in order])


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, fit(docs), carry=["doc_id"])

"""Language identification with interpolated Kneser-Ney character models, one for each language.

Words (runs of letters, lower-cased) are scored with their ends marked, so a word's score depends on the word alone and
is kept. The n-grams of all languages lie in sorted hash arrays, one for each order, with a row of probabilities (one for
each language) beside each hash. The language of least cross-entropy a character wins; a text whose cross-entropy is beyond
what held-back training texts of that language reach is rejected.

Null texts and texts without a letter are `und`, score 0 and are rejected. Texts are read whole. Repeated rows are scored
each; an empty table gives an empty result; with nothing to learn from, every text is `und`. Input columns that have the
name of a result are replaced.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliant.llm.base import annotate, field, fold, table

UNKNOWN = "und"
ORDER = 4
DISCOUNT = 0.75
#: Rows of each language that are learned from, whole, at most: those with the least hash of their id.
TRAIN_ROWS = 400
#: Words that a worker keeps the scores of; beyond that it starts afresh, which costs time and no result.
CACHE_WORDS = 150_000
#: Rejected: a cross-entropy (nats a character) this far above the mean of a language's held-back texts, at least.
SLACK = 1.5

WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram of this order that ends at each place, for places that have one."""
    n = len(codes) - order + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(order):
        h = (h ^ codes[k : k + n]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words, each word between two marks of its start and one of its end, and each word's length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    pad = "\x02" * (ORDER - 1)
    text = "".join([f"{pad}{w}\x03" for w in words])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64), lengths


def _places(lengths: np.ndarray) -> np.ndarray:
    """Where the scored characters of each word lie in what _codes gives."""
    ends = np.cumsum(lengths + ORDER - 1)
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return np.repeat(ends - lengths, lengths) + within


def train_language(words: Counter) -> dict:
    """Probabilities of the n-grams of one language and back-off weights of their contexts, by order."""
    names = list(words)
    weight = np.fromiter(words.values(), np.int64, len(names))
    codes, lengths = _codes(names)
    places, weights = _places(lengths), np.repeat(weight, lengths)
    alphabet = len(np.unique(codes[places])) + 1  # and one for all unknown characters
    grams: dict[int, tuple] = {}
    for k in range(ORDER, 0, -1):
        h = _hashes(codes, k)[places - k + 1]
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if k == ORDER:
            count = np.bincount(inverse, weights)
        else:  # of lower orders, the number of different characters before
            longer, at = np.unique(_hashes(codes, k + 1)[places - k], return_index=True)
            count = np.bincount(np.searchsorted(keys, h[at]), minlength=len(keys)).astype(float)
        context = _hashes(codes, k - 1)[places - k + 1][first] if k > 1 else np.zeros(len(keys), np.uint64)
        shorter = _hashes(codes, k - 1)[places - k + 2][first] if k > 1 else None
        grams[k] = keys, count, context, shorter
    out: dict = {"floor": 1.0 / alphabet}
    below = None
    for k in range(1, ORDER + 1):
        keys, count, context, shorter = grams[k]
        ctx, inverse, kinds = np.unique(context, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, count)
        back = DISCOUNT * kinds / total
        lower = out["floor"] if k == 1 else below[1][np.searchsorted(below[0], shorter)]
        p = np.maximum(count - DISCOUNT, 0) / total[inverse] + back[inverse] * lower
        out[k] = keys, p, ctx, back
        below = keys, p
    return out


class LanguageModels:
    """Models of several languages in common sorted hash arrays."""

    def __init__(self, models: dict[str, dict]):
        self.languages = sorted(models)
        own = [models[x] for x in self.languages]
        self.floor = np.array([m["floor"] for m in own])
        self.tables = []
        for k in range(1, ORDER + 1) if own else ():
            keys = np.unique(np.concatenate([m[k][0] for m in own]))
            p = np.full((len(keys), len(own)), np.nan)
            ctx = np.unique(np.concatenate([m[k][2] for m in own]))
            back = np.ones((len(ctx), len(own)))
            for j, m in enumerate(own):
                p[np.searchsorted(keys, m[k][0]), j] = m[k][1]
                back[np.searchsorted(ctx, m[k][2]), j] = m[k][3]
            self.tables.append((keys, p, ctx, back))
        self.limits = {x: math.inf for x in self.languages}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.scores = np.empty((1024, len(self.languages)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "scores")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._forget()

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word, ends included, under each language."""
        codes, lengths = _codes(words)
        places = _places(lengths)
        logs = np.tile(self.floor, (len(places), 1))
        for k, (keys, p, ctx, back) in enumerate(self.tables, start=1):
            h, inverse = np.unique(_hashes(codes, k)[places - k + 1], return_inverse=True)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            own = np.where((keys[at] == h)[:, None], p[at], np.nan)[inverse]
            if k == 1:
                weight = back[0]
            else:
                c, where = np.unique(_hashes(codes, k - 1)[places - k + 1], return_inverse=True)
                at = np.minimum(np.searchsorted(ctx, c), len(ctx) - 1)
                weight = np.where((ctx[at] == c)[:, None], back[at], 1.0)[where]
            logs = np.where(np.isnan(own), weight * logs, own)
        starts = np.cumsum(lengths) - lengths
        return np.add.reduceat(np.log(logs), starts, axis=0)

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHE_WORDS:
            self._forget()
            new = list(words)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            n = len(self.known)
            while n + len(part) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
            self.scores[n : n + len(part)] = self.word_scores(part)
            self.known |= zip(part, range(n, n + len(part)), strict=True)

    def entropies(self, texts: list[str | None]) -> list[tuple[int, np.ndarray | None]]:
        """For each text its number of scored characters and its cross-entropy a character under each language."""
        counts = [Counter(words_of(t)) for t in texts]
        self.learn({w for c in counts for w in c})
        out = []
        for c in counts:
            if not any(any(map(str.isalpha, w)) for w in c):  # signs like ² are in words but are no letters
                out.append((0, None))
                continue
            at = np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))
            n = np.fromiter(c.values(), np.float64, len(c))
            size = sum(map(len, c.elements())) + int(n.sum())
            out.append((size, -(n @ self.scores[at]) / size))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list, list, list, list]:
        """Language, score (how far the best language stands out, 0 to 1), cross-entropy, and whether rejected."""
        out = [], [], [], []
        for size, h in self.entropies(texts) if self.languages else [(0, None)] * len(texts):
            if h is None:
                row = UNKNOWN, 0.0, None, True
            else:
                k = int(np.argmin(h))
                p = np.exp((h[k] - h) * min(size, 40))
                name = self.languages[k]
                row = name, float(1 / p.sum()), float(h[k]), bool(h[k] > self.limits[name] + 5 / math.sqrt(size))
            for column, v in zip(out, row, strict=True):
                column.append(v)
        return out


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS) -> LanguageModels:
    """Learn from at most `rows` rows of each language, whole texts; every fourth of them only sets the limits.

    The number of languages, and so what reaches the driver, does not grow with the rows.
    """
    spark = docs.sparkSession
    order = F.xxhash64(F.col("__key").cast("string"), F.lit("langid"))
    known = docs.select(docs[f"`{lang}`"].alias("__lang"), docs[f"`{text}`"].alias("__text"), docs[f"`{key}`"].alias("__key")).where(
        "__lang is not null and __text is not null"
    )
    sizes = {r[0]: r[1] for r in known.groupBy("__lang").count().collect()}
    if not sizes:
        return LanguageModels({})
    share = F.lit(1.0)  # of a language's rows, about twice as many as needed, so that only those are ranked
    for name, n in sizes.items():
        share = F.when(F.col("__lang") == name, F.lit(min(1.0, 2.0 * rows / n + 100 / n))).otherwise(share)
    few = known.withColumn("__order", order).where((F.col("__order") / F.lit(2.0**64) + 0.5) < share)
    rank = F.row_number().over(Window.partitionBy("__lang").orderBy("__order", F.xxhash64("__text")))
    sample = few.withColumn("__rank", rank).where(F.col("__rank") <= rows)

    def learn(key, table):
        texts = table["__text"][table["__rank"] % 4 != 0] if len(table) > 3 else table["__text"]
        held = table["__text"][table["__rank"] % 4 == 0]
        words = Counter(w for t in texts for w in words_of(t))
        import pandas as pd

        model = train_language(words) if words else None
        limit = math.inf
        if model:
            alone = LanguageModels({"x": model})
            h = [float(e[0]) for n, e in alone.entropies(list(held)) if n >= 50]
            limit = float(np.mean(h) + max(SLACK, 6 * np.std(h))) if len(h) > 7 else math.inf
        return pd.DataFrame({"name": [key[0]], "model": [pickle.dumps((model, limit))]})

    got = sample.groupBy("__lang").applyInPandas(learn, T.StructType([field("name", "string"), field("model", "binary")])).collect()
    models = {r["name"]: pickle.loads(r["model"]) for r in got}
    out = LanguageModels({k: m for k, (m, _) in models.items() if m})
    out.limits = {k: limit for k, (m, limit) in models.items() if m}
    return out


def identify(docs: DataFrame, models: LanguageModels, text: str = "text", carry: list[str] | None = None, prefix: str = "") -> DataFrame:
    """Add lang_pred, score, entropy and rejected, with a prefix to their names if given."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by TRAIN_ROWS of each language

    def make():
        return lambda texts: shared.value.predict(texts)

    kinds = {"lang_pred": "string", "score": "double", "entropy": "double", "rejected": "boolean"}
    fields = [field(prefix + name, kind) for name, kind in kinds.items()]
    return annotate(docs, make, fields, text, carry, lambda: shared.value._forget())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = fit(docs.where(fold(F.col("doc_id"), 5) != 0))
    found = identify(docs.select("doc_id", "text"), models, carry=["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "entropy", "rejected")

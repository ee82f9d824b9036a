"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Terms are words (runs of letters, lower-cased) and the first letters of longer words, written with a star. A bounded sample
of labelled rows gives the vocabulary: every word of the sample, and the heads of words that tell the labels apart. The
weight of a term is its TF-IDF; that of a term that does not tell the labels apart is scaled by PLAIN, as a learned diagonal
metric, since prose shares far more common words than telling ones. Examples, one for each different vector with its label
counts, lie in an inverted index by term, in blocks with the largest weight of each term in each block; a query sums those
into a bound for each block and scores blocks by falling bound until no other block can hold one of the k best. Votes
weigh by squared cosine and by how the sample was drawn, beside PRIOR votes of the sample's share, so a score is a probability.

Null and empty texts, and texts without a word of the sample, score the share of label 1 among such examples, or of all
examples if there are none; with nothing to learn from (no documents, no labels, one label alone), every score is 0. Texts
are read whole; ties among examples go to the earlier one; repeated rows are scored each; repeated labels of an id count as
the largest and of several texts of an id the least is learned; an empty table gives an empty result. Input columns that have
the name of a result are replaced.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from hashlib import md5

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.base import annotate, cut, field, fold, table

#: Labelled rows of each label that are learned from, whole, at most: those with the least hash of their id.
TRAIN_ROWS = {1: 400, 0: 2400}
#: A telling term is in so many examples, at this many deviations above chance, mostly of label 1.
LEAST_EXAMPLES, LEAST_DEVIATIONS, LEAST_SHARE = 5, 6.0, 0.8
#: Lengths of the heads of words that are terms too, where they tell.
HEADS = (3, 4, 5, 6, 7, 8)
#: The scale of the weights of words that do not tell the labels apart.
PLAIN = 0.05
NEIGHBOURS = 15
BLOCK = 32
#: Blocks that are scored before the first look at the bounds of the others.
FIRST_BLOCKS = 4
THRESHOLD = 0.3
#: Votes of the sample's share, beside those of the neighbours.
PRIOR = 1.0
#: The share of examples above which a term's postings are kept as a row of all examples.
WIDE = 0.2

WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> Counter:
    """Counts of the terms of a text."""
    words = Counter(WORD.findall(text.lower())) if text else Counter()
    out = Counter(words)
    for w, n in words.items():
        for k in HEADS:
            if len(w) > k:
                out[w[:k] + "*"] += n
    return out


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    sizes = end - start
    return np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class ExampleIndex:
    """Block-max inverted index of labelled examples: (counts of terms, label, an id), for the weights of terms."""

    def __init__(self, idf: dict[str, float], rows: list[tuple[Counter, int, int]], weights: dict[int, float]):
        self.terms = {t: i for i, t in enumerate(sorted(idf))}
        self.idf = np.array([idf[t] for t in sorted(idf)])
        self.prefixes = {t[:-1]: i for t, i in self.terms.items() if t.endswith("*")}
        self.lengths = sorted({len(p) for p in self.prefixes})
        self.starts = {p[: self.lengths[0]] for p in self.prefixes}
        votes: dict[tuple, list] = defaultdict(lambda: [0.0, 0.0, None])
        for counts, label, key in rows:
            at = votes[self.key(counts)]
            at[0 if label else 1] += weights[label]
            at[2] = key if at[2] is None else min(at[2], key)
        none = votes.pop((), [0.0, 0.0, None])
        total = [sum(v[i] for v in [none, *votes.values()]) for i in (0, 1)]
        self.share = total[0] / max(sum(total), 1e-9)
        self.share_without = none[0] / (none[0] + none[1]) if none[0] + none[1] else self.share
        vectors = {k: self.vector(k) for k in votes}
        # neighbours in order share their heaviest term, which keeps the blocks' bounds tight
        order = sorted(votes, key=lambda k: (int(vectors[k][0][np.argmax(vectors[k][1])]), k))
        self.votes = np.array([votes[k][:2] for k in order]).reshape(-1, 2)
        self.ids = [votes[k][2] for k in order]
        self.blocks = -(-len(order) // BLOCK)
        sizes = np.array([len(vectors[k][0]) for k in order], np.int64)
        of_term = np.concatenate([vectors[k][0] for k in order] or [np.empty(0, np.int64)])
        examples = np.repeat(np.arange(len(order)), sizes)
        weights = np.concatenate([vectors[k][1] for k in order] or [np.empty(0)])
        # the postings of a term that many examples have are kept as a row of all examples, zeros included
        wide = np.flatnonzero(np.bincount(of_term, minlength=len(self.terms)) > max(WIDE * len(order), BLOCK))
        self.row = np.full(len(self.terms), -1)
        self.row[wide] = np.arange(len(wide))
        self.rows = np.zeros((len(wide), self.blocks, BLOCK))
        own = self.row[of_term] >= 0
        self.rows[self.row[of_term[own]], examples[own] // BLOCK, examples[own] % BLOCK] = weights[own]
        self.row_most = self.rows.max(axis=2, initial=0.0)
        # the others by term and then by example; a cell is the postings of one term in one block, with their largest weight
        at = np.flatnonzero(~own)
        at = at[np.argsort(of_term[at], kind="stable")]
        of_term, self.examples, self.weights = of_term[at], examples[at], weights[at]
        cell = of_term * max(self.blocks, 1) + self.examples // BLOCK
        self.cells = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, np.int64)
        self.cell_block = self.examples[self.cells] // BLOCK
        self.cell_most = np.maximum.reduceat(self.weights, self.cells) if len(cell) else np.empty(0)
        self.first_cell = np.searchsorted(of_term[self.cells], np.arange(len(self.terms) + 1))
        self.cells = np.append(self.cells, len(cell))

    def key(self, counts: Counter) -> tuple:
        return tuple(sorted((self.terms[t], n) for t, n in counts.items() if t in self.terms))

    def key_of(self, text: str | None) -> tuple:
        """key() of a text's counts, without counting what is no term."""
        words = Counter(WORD.findall(text.lower())) if text else {}
        out = {self.terms[w]: words[w] for w in words.keys() & self.terms.keys()}
        least = self.lengths[0] if self.lengths else 0
        for w in words:
            if w[:least] in self.starts:
                for k in self.lengths:
                    if w[:k] in self.prefixes and len(w) > k:
                        t = self.prefixes[w[:k]]
                        out[t] = out.get(t, 0) + words[w]
        return tuple(sorted(out.items()))

    def vector(self, key: tuple) -> tuple[np.ndarray, np.ndarray]:
        both = np.array(key, np.int64).reshape(-1, 2)
        w = (1 + np.log(both[:, 1])) * self.idf[both[:, 0]]
        return both[:, 0], w / np.linalg.norm(w)

    def nearest(self, key: tuple, k: int = NEIGHBOURS) -> list[tuple[float, int]]:
        """The k examples of largest cosine above 0, best first, earlier examples first among equals."""
        at, weights = self.vector(key)
        wide = self.row[at] >= 0
        rows, row_weights = self.row[at[wide]], weights[wide]
        at, weights = at[~wide], weights[~wide]
        start, end = self.first_cell[at], self.first_cell[at + 1]
        cells = _ranges(start, end)
        weights = np.repeat(weights, end - start)
        block = self.cell_block[cells]
        bounds = (np.bincount(block, weights * self.cell_most[cells], self.blocks) + row_weights @ self.row_most[rows]) * (1 + 1e-9)
        scores, left = np.zeros((self.blocks, BLOCK)), bounds > 0
        wanted = np.argsort(-bounds, kind="stable")[:FIRST_BLOCKS]
        wanted, least = wanted[left[wanted]], 0.0
        while len(wanted):
            left[wanted] = False
            now = np.zeros(self.blocks, bool)
            now[wanted] = True
            own = now[block]
            c = cells[own]
            size = self.cells[c + 1] - self.cells[c]
            postings = _ranges(self.cells[c], self.cells[c + 1])
            scores += np.bincount(self.examples[postings], np.repeat(weights[own], size) * self.weights[postings], scores.size).reshape(scores.shape)
            if 4 * len(wanted) < self.blocks:
                scores[wanted] += np.tensordot(row_weights, self.rows[rows[:, None], wanted], 1)
            else:
                scores[wanted] += (row_weights @ self.rows.reshape(-1, scores.size)[rows]).reshape(scores.shape)[wanted]
            least = float(np.partition(scores.ravel(), -k)[-k]) if scores.size > k else 0.0
            wanted = np.flatnonzero(left & (bounds >= least))
        scores = scores.ravel()
        best = np.flatnonzero(scores >= max(least, 1e-300))
        best = best[np.argsort(-scores[best], kind="stable")][:k]
        return [(float(scores[e]), int(e)) for e in best]

    def score(self, text: str | None) -> tuple[float, str]:
        """Score from 0 to 1, and its evidence: ids of the examples with their cosines."""
        key = self.key_of(text)
        near = self.nearest(key) if key and self.blocks else []
        if not near:
            return (self.share if key else self.share_without), ""
        w = np.array([[s * s] for s, _ in near]) * self.votes[[e for _, e in near]]
        one, zero = (w / (self.votes.sum() / len(self.votes))).sum(axis=0)
        p = (one + PRIOR * self.share) / (one + zero + PRIOR)
        return float(min(1.0, max(0.0, p))), ",".join(f"{self.ids[e]}:{s:.4f}" for s, e in near[:3])


def fit(docs: DataFrame, labels: DataFrame, rows: dict[int, int] | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ExampleIndex:
    """Learn from at most rows[y] labelled rows of each label y; what reaches the driver are the words of those rows."""
    rows = rows or TRAIN_ROWS
    marks = labels.select(labels[f"`{doc_id}`"].alias("key"), labels[f"`{label}`"].cast("int").alias("y")).where("key is not null and y in (0, 1)")
    marks = marks.groupBy("key").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    picked = None
    for y, n in rows.items():
        order = F.xxhash64(F.col("key").cast("string"), F.lit("toxicity"))
        part = marks.where(F.col("y") == y).orderBy(order, "key").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    picked = cut(picked, "examples")  # at most sum(rows.values()) rows, so it may be broadcast
    sample = docs.select(docs[f"`{doc_id}`"].alias("key"), docs[f"`{text}`"].alias("text")).join(F.broadcast(picked), "key")
    # of several texts of an id the least, whichever order they come in
    sample = cut(sample.groupBy("key", "y").agg(F.min("text").alias("text")), "examples")

    def distinct():
        def run(texts):
            found = [list(terms_of(t)) for t in texts]
            return [found, [md5(" ".join(sorted(f)).encode()).hexdigest() for f in found]]

        return run

    # texts of the same terms are copies and count once: else a term of one text would look telling
    different = annotate(sample, distinct, [field("terms", "array<string>"), field("digest", "string")], carry=["y"]).dropDuplicates(["y", "digest"])
    different = cut(different, "examples")
    alone = {r["y"]: r["count"] for r in different.groupBy("y").count().collect()}
    if not alone.get(0) or not alone.get(1):
        return ExampleIndex({}, [], {0: 1.0, 1: 1.0})
    n = alone[0] + alone[1]
    p = alone[1] / n
    stats = different.select("y", F.explode("terms").alias("term"))
    stats = stats.groupBy("term").agg(F.count("*").alias("df"), F.sum("y").alias("ones")).where(F.col("df") >= LEAST_EXAMPLES)
    deviations = (F.col("ones") - F.col("df") * p) / F.sqrt(F.col("df") * (p * (1 - p)))
    stats = stats.withColumn("z", deviations).where((F.col("z") >= LEAST_DEVIATIONS) & (F.col("ones") >= LEAST_SHARE * F.col("df")))
    idf = {r["term"]: float(np.log((1 + n) / (1 + r["df"])) + 1) for r in stats.collect()}  # terms of a bounded sample

    def words():
        def run(texts):
            found = [Counter(WORD.findall(t.lower())) if t else Counter() for t in texts]
            return [[list(f) for f in found], [list(f.values()) for f in found]]

        return run

    got = annotate(sample, words, [field("words", "array<string>"), field("counts", "array<int>")], carry=["key", "y"])
    examples, df = [], Counter()
    for r in got.orderBy("key").toLocalIterator():
        counts = Counter(dict(zip(map(sys.intern, r["words"]), r["counts"], strict=True)))
        df.update(counts.keys())
        heads = Counter()
        for w, c in counts.items():
            for k in HEADS:
                if len(w) > k and (head := w[:k] + "*") in idf:
                    heads[head] += c
        examples.append((counts + heads, r["y"], r["key"]))
    for w, c in df.items():
        if w not in idf:
            idf[w] = PLAIN * float(np.log((1 + len(examples)) / (1 + c)) + 1)
    drawn = Counter(y for _, y, _ in examples)
    return ExampleIndex(idf, examples, {y: sizes[y] / drawn[y] if drawn[y] else 1.0 for y in rows})


def assess(docs: DataFrame, index: ExampleIndex, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add score, predicted (1 from THRESHOLD on) and evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by TRAIN_ROWS

    def make():
        def run(texts):
            got = [shared.value.score(t) for t in texts]
            return [[s for s, _ in got], [int(s >= THRESHOLD) for s, _ in got], [e for _, e in got]]

        return run

    return annotate(docs, make, [field("score", "double"), field("predicted", "int"), field("evidence", "string")], text, carry)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    index = fit(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    found = assess(docs.select("doc_id", "text"), index, carry=["doc_id"])
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted", "evidence")

"""Queries beside their SQL on the smallest tables, and the pipeline beside plain Python."""

import hashlib
import os

import pytest

import corpus_pipeline
from foliant.llm import bpe, langid, queries, secrets
from tests.llm.test_operators import plain_contamination
from tests.test_queries import SF, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.mark.parametrize("name", queries.ORACLE)
def test_query(spark, name):
    compare(spark, name, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", queries.QUERIES)
def test_every_document_comes_back(spark, name):
    got = queries.QUERIES[name](spark, SF).select("doc_id").collect()
    want = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    assert sorted(got) == sorted(want)


def plain_shingles(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    models = langid.fit(docs)
    left = {i: t for i, t in sorted(rows.items()) if not models.predict([t])[3][0]}
    sets = {i: plain_shingles(t) for i, t in left.items()}
    near = [(i, j) for i in left for j in left if i < j and plain_jaccard(sets[i], sets[j]) >= corpus_pipeline.NEAR_LEAST]
    first = {i: i for i in left}
    for _ in left:
        before = dict(first)
        for i, j in near:
            first[i] = first[j] = min(first[i], first[j])
        if before == first:
            break
    left = {i: t for i, t in left.items() if first[i] == i}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    left = {i: t for i, t in left.items() if not plain_contamination(t, items)[4]}
    assert 0.5 * len(rows) < len(left) < len(rows)
    want = {}
    for i, t in left.items():
        clean = secrets.redact(t, secrets.find(t, secrets.default_model())[1])
        ids_of = bpe.engine(bpe.vocabulary()).encode([clean])[0]
        want[i] = len(ids_of), hashlib.sha256(" ".join(map(str, ids_of)).encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_stages_on_nulls_repeats_and_clashing_columns(spark):
    """What each stage's docstring says, on rows without an id or a text, repeated rows, and columns named like results."""
    text = "the cat sat on the mat with another thing and there is nothing that the weather would change about it today"
    bad = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(1, text, "en"), (1, text, "en"), (2, text, None), (None, text + " now", "en"), (None, None, "en"), (3, "", None), (None, bad, "en"), (None, bad + " more", "en"), (4, "my token=abcdef012345 here", "en")]
    clash = ["score", "lang_pred", "rejected", "node", "row", "root", "__id", "h", "n_words", "n_tokens", "spans", "fingerprint"]
    docs = spark.createDataFrame([(*r, "s", None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    docs = docs.withColumns({c: F.lit(c) for c in clash})
    stages = dict(corpus_pipeline.STAGES)
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        out[name] = sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=str)
        assert all(r[c] == c for r in got.collect() for c in clash)
    assert {i for i, _, _ in out["language_id"]} <= {1, 2, 4, None} and not any(t in (None, "") for _, t, _ in out["language_id"])
    kept = [(i, t) for i, t, _ in out["near_duplicates"]]
    assert sorted([x for x in kept if x[0]], key=str) == sorted([(1, text), (3, ""), (4, rows[8][1])], key=str)
    assert [t for i, t in kept if i is None] in ([bad], [bad + " more"])  # tied but for the hash
    assert len(out["decontamination"]) == len(rows)  # none of them is in the benchmark
    assert (4, "my [SECRET] here", 16) in out["secret_scan"] and (None, None, None) in out["secret_scan"] and len(out["secret_scan"]) == len(rows)
    assert stages["encoding"](spark, docs, SF).count() == len(rows)

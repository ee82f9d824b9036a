"""Operators beside plain Python, and their defined results for nulls, empty texts, ties, repeated rows and odd columns."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import base, bpe, decontaminate, graph, langid, licenses, quality, secrets, shards, shingles, simhash, suffixes, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 8000


def docs(spark, texts, start=0, schema=DOC):
    return spark.createDataFrame([(start + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], schema).repartition(3)


def odd(spark):
    """Null, empty and wordless texts, a long one, repeated rows, a null id, and columns with the names of results."""
    df = docs(spark, [None, "", " \n\t", "a", "a", LONG, "-- !! 😀 é"])
    df = df.unionByName(df.where("doc_id = 3")).unionByName(df.where("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long")))
    clash = ["score", "n_words", "fingerprint", "component_id", "ids", "kept", "spans", "k1", "normal", "size", "row", "h"]
    return df.withColumns({c: F.lit("x") for c in clash})


def empty(spark):
    return odd(spark).limit(0)


MODEL = langid.LanguageModels({"en": langid.train_language(Counter(["hello", "there", "the"])), "de": langid.train_language(Counter(["hallo", "dort", "das"]))})
INDEX = toxicity.ExampleIndex({"bad": 2.0, "bad*": 1.0}, [(Counter({"bad": 1}), 1, 7), (Counter(), 0, 8)], {0: 1.0, 1: 1.0})
ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "short item here"), (3, None), (4, "")]
OPERATORS = {
    "bpe": lambda s, d: bpe.digest(d, bpe.vocabulary()),
    "decontaminate": lambda s, d: decontaminate.contamination(d, s.createDataFrame(ITEMS, "item_id long, text string")),
    "langid": lambda s, d: langid.identify(d, MODEL),
    "toxicity": lambda s, d: toxicity.assess(d, INDEX),
    "quality": lambda s, d: quality.apply_policy(quality.ledger(d)),
    "shards": lambda s, d: shards.partition(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "suffixes": lambda s, d: suffixes.removal(d),
    "licenses": lambda s, d: licenses.scan(d),
    "secrets": lambda s, d: secrets.scan(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_come_back_once_each(spark, name):
    df = odd(spark)
    got = OPERATORS[name](spark, df)
    ids = Counter(r.doc_id for r in got.select("doc_id").collect())
    assert ids == Counter(r.doc_id for r in df.collect())
    assert len(set(map(str.lower, got.columns))) == len(got.columns)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](spark, empty(spark)).count() == 0


# --- 1


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary())


def test_bpe_is_the_librarys(library):
    rng = random.Random(3)
    alphabet = "aAbBqzx'sтΣσİ é́#1٣.,!\n\t\x1c\x85  𝐀ﬁ漢߷\U0003fc3b"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|ENDOFTEXT|>b", "x <|startoftext|><|endoftext|> y", "", LONG, "x" * 5000]
    own = bpe.engine(bpe.vocabulary())
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.encode(texts) == want
    assert [own.decode(i) for i in want] == [library.decode(i, skip_special_tokens=False) for i in want]
    assert own.encode([None]) == [[]]


def test_cuts_are_certain():
    own = bpe.engine(bpe.vocabulary())
    assert own.cuts("the") == ["the"]
    for word in ("qzjx", "zzzqqq", "xjqvk"):
        parts = own.cuts(word)
        assert "".join(parts) == word
        for a, b in zip(parts, parts[1:], strict=False):
            assert not any(a[-1] + b[0] in t for t in own.tokens.values() if t not in own.special)


def test_bpe_columns(spark):
    df = bpe.decode(bpe.encode(docs(spark, ["Hello there", None]), bpe.vocabulary()), bpe.vocabulary())
    rows = {r.doc_id: (len(r.ids), r.decoded) for r in df.collect()}
    assert rows == {0: (2, "hello</w> there</w>"), 1: (0, "")}


# --- 2


def plain_contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    own, hit, found = words(text), set(), set()
    for item, t in items:
        ws = words(t)
        size = min(13, len(ws))
        for k in range(len(ws) - size + 1) if ws else ():
            for p in range(len(own) - size + 1):
                if own[p : p + size] == ws[k : k + size]:
                    hit |= set(range(p, p + size))
                    found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


def test_contamination(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "É", "x9"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 5, 6, 13, 14, 20, 30])))) for i in range(30)] + ITEMS[1:] + [(2, "short item here")]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(40)]
    texts += [f"{texts[i % 9]}, {items[i][1].upper().replace('É', 'É')} - {texts[(i + 3) % 9]}" for i in range(30)] + [None, "", "Short-Item HERE"]
    for how in ({}, {"shingle": 3}):
        got = decontaminate.contamination(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), **how).collect()
        for r in got:
            assert tuple(r)[1:] == plain_contamination(texts[r.doc_id], items), texts[r.doc_id]
    none = decontaminate.contamination(docs(spark, texts), spark.createDataFrame([], "item_id long, text string"))
    assert none.where("contaminated or n_hit > 0").count() == 0


def test_contamination_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    got = decontaminate.contamination(docs(spark, ["x " + ITEMS[0][1], "y"]), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert {r.doc_id: r.n_hit for r in got.collect()} == {0: 14, 1: 0}
    kept = decontaminate.decontaminated(docs(spark, ["x " + ITEMS[0][1], "y"]), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert [(r.doc_id, len(r)) for r in kept.collect()] == [(1, 5)]


# --- 3

ENGLISH = ["the cat sat on the mat with another thing", "there is nothing that the weather would change", "whether they thought of it then is unknown"]
GERMAN = ["der hund sitzt auf dem teppich und schläft", "das wetter ist heute nicht schön und kalt", "ich weiß nicht ob sie daran gedacht haben"]


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    bad, clean = ITEMS[0][1], "nothing of the kind in here"
    rows = [(None, bad), (None, clean), (None, None), (7, clean), (7, bad), (8, clean)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.decontaminated(df, bench)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(None, clean), (None, None), (7, clean), (8, clean)])


def test_kneser_ney_sums_to_one():
    words = Counter(" ".join(ENGLISH).split())
    p = langid.train_language(words)
    total = p[1][1].sum()
    assert total == pytest.approx(1 - p[1][3][0] * p["floor"], rel=1e-6)  # the rest is the share of unknown characters
    for k in range(2, langid.ORDER + 1):
        assert (p[k][1] > 0).all() and (p[k][1] <= 1 + 1e-9).all() and (np.diff(p[k][0].astype(float)) >= 0).all()


def test_languages_are_told_apart(spark):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([(t, "en") for t in ENGLISH * 4] + [(t, "de") for t in GERMAN * 4] + [(None, "en"), ("x", None)])]
    models = langid.fit(spark.createDataFrame(rows, DOC))
    assert models.languages == ["de", "en"]
    got = langid.identify(docs(spark, ["the other thing", "der andere hund", None, "123 !!", "", "½ ² _"]), models).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {0: "en", 1: "de", 2: "und", 3: "und", 4: "und", 5: "und"}
    assert all(0 <= r.score <= 1 for r in got) and {r.doc_id for r in got if r.rejected} >= {2, 3, 4}
    none = langid.fit(spark.createDataFrame(rows, DOC).where("lang is null"))
    assert {r.lang_pred for r in langid.identify(docs(spark, ["the", None]), none).collect()} == {"und"}


# --- 4


def dense_score(index, key):
    """The votes of the nearest examples, from all cosines; None where the last place is shared by unlike votes."""
    at, w = index.vector(key)
    cosines = [sum(x * dict(zip(at.tolist(), w.tolist(), strict=True)).get(t, 0.0) for t, x in v) for v in index.plain]
    order = sorted((-s, e) for e, s in enumerate(cosines) if s > 0)[: toxicity.NEIGHBOURS]
    mean = index.votes.sum() / len(index.votes)
    one, zero = (sum(s * s * index.votes[e][k] / mean for s, e in order) for k in (0, 1))
    return (one + toxicity.PRIOR * index.share) / (one + zero + toxicity.PRIOR), order


@pytest.mark.parametrize("wide", [0.0, 0.1, 2.0])
def test_nearest_examples_and_votes_by_brute_force(monkeypatch, wide):
    monkeypatch.setattr(toxicity, "WIDE", wide)
    rng = random.Random(2)
    terms = [f"{c}{d}word" for c in "abcdefgh" for d in "klmno"] + ["abh*"]
    idf = {t: rng.uniform(1, 4) for t in terms}
    rows = [(Counter(rng.choices(terms, k=rng.randint(0, 9))), rng.randint(0, 1), i) for i in range(700)]
    index = toxicity.ExampleIndex(idf, rows, {0: 2.0, 1: 1.0})
    by_id = {i: c for c, _, i in rows}
    index.plain = [list(zip(*(x.tolist() for x in index.vector(index.key(by_id[i]))), strict=True)) for i in index.ids]
    assert sum(map(sum, index.votes)) + sum(2 - y for c, y, _ in rows if not c) == sum(2 - y for _, y, _ in rows)
    for _ in range(100):
        text = " ".join(rng.choices([*terms[:-1], "abhead", "unknown"], k=rng.randint(1, 6)))
        key = index.key_of(text)
        assert key == index.key(toxicity.terms_of(text))
        if key:
            want, order = dense_score(index, key)
            got = index.nearest(key)
            assert np.allclose([s for s, _ in got], [-s for s, _ in order])
            if [e for _, e in got] == [e for _, e in order]:  # but for rounding in ties
                assert index.score(text)[0] == pytest.approx(want)
    assert index.score("unknown")[0] == index.score(None)[0] == pytest.approx(index.share_without)


def test_learning_from_nothing(spark):
    """No documents, no labels, labels of no document and labels of one kind: an index without examples, scores of 0."""
    some, labels = docs(spark, ["a b", None, "", "c"]), "doc_id long, toxic int"
    one_sided = [[(0, 0), (1, 0)], [(0, 1), (2, 1)], [(9, 1), (0, 0)], [(None, 1), (0, None), (1, 7)], []]
    cases = [(some, spark.createDataFrame(x, labels)) for x in one_sided]
    cases += [(empty(spark), spark.createDataFrame([(0, 0), (1, 1)], labels)), (some.limit(0), spark.createDataFrame([], labels))]
    for d, y in cases:
        index = toxicity.fit(d, y)
        assert not index.ids
        assert {(r.score, r.predicted) for r in toxicity.assess(some, index).collect()} == {(0.0, 0)}
    both = toxicity.fit(some.unionByName(docs(spark, ["b a"])), spark.createDataFrame([(0, 0), (1, 1), (3, 1)], labels))
    assert len(both.ids) == 2 and both.ids  # the null text of label 1 votes for texts without a word; of id 0 the least text


def test_toxic_words_are_learned(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts = [" ".join(word() for _ in range(30)) + (f" {rng.choice(['vile', 'grubbyness', 'grubbyhood'])}" if i % 5 == 0 else "") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(0, 0), (None, 1), (9999, 1)], "doc_id long, toxic int")
    index = toxicity.fit(docs(spark, texts), labels)
    got = {r.doc_id: (r.predicted, r.evidence) for r in toxicity.assess(docs(spark, texts), index).collect()}
    assert [got[i][0] for i in range(300, 600)] == [int(i % 5 == 0) for i in range(300, 600)]
    assert got[305][1]
    blind = toxicity.fit(docs(spark, texts), labels.where("toxic = 0"))
    assert {r.score for r in toxicity.assess(docs(spark, ["vile", None]), blind).collect()} == {0.0}


def test_texts_that_share_one_term_are_not_copies(spark):
    """All texts hold the word of least crc32; each label still learns from all of them, and exact copies count once."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    least = min(("".join(rng.choices("klmnopqrst", k=4)) for _ in range(200_000)), key=lambda w: crc32(w.encode()))
    bad = ["vile", "grub", "slur", "foul"]
    texts = [f"{least} " + " ".join(word() for _ in range(20)) + (f" {bad[i // 5 % 4]}" if i % 5 == 0 else "") for i in range(300)]
    texts += [f"{least} " + " ".join(word() for _ in range(20)) + " copied"] * 20
    labels = spark.createDataFrame([(i, int(i % 5 == 0 or i >= 300)) for i in range(320)], "doc_id long, toxic int")
    index = toxicity.fit(docs(spark, texts), labels)
    weight = {t: index.idf[i] for t, i in index.terms.items()}
    assert min(weight[w] for w in ("vile", "grub", "slur", "foul")) > 1 > weight["copied"]  # the latter is scaled by PLAIN


# --- 5


def test_repeated_words_by_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 40))]
        at = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {p for i in range(len(words) - 7) if at[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
        assert quality.repeated_words(words) == len(hit)


def test_ledger_policies_and_ablation(spark):
    good = " ".join(f"word{i}" for i in range(30))
    df = quality.ledger(docs(spark, [good, "few", good + "".join(f" #{i}" for i in range(40)), "ab " * 60, None]))
    kept = {v: {r.doc_id for r in quality.apply_policy(df, v).where("kept").collect()} for v in quality.POLICIES}
    assert kept == {1: {0, 2}, 2: {0}}
    names = list(quality.RULES)
    for r in quality.ablation(df, 2).collect():
        others = [n for n in quality.POLICIES[2] if n != r.rule]
        bits = [x.failed_rules for x in df.collect()]
        assert r.n_failed == sum(bool(b & quality.mask([r.rule])) for b in bits)
        assert r.n_kept_without == sum(not b & quality.mask(others) for b in bits)
        assert r.n_failed_alone == sum(b == quality.mask([r.rule]) for b in bits) and r.rule in names


def test_measures():
    assert quality.measure_text("a b\na b\n \n\na b c") == (6, 8, 0, 1, 0, 3)
    assert quality.measure_text("#*$%&|<> x") == (2, 9, 8, 0, 0, 1)


# --- 6


def test_shards_are_even_and_gapless(spark):
    rng = random.Random(8)
    texts = ["x" * rng.randint(0, 300) for _ in range(900)] + ["a copy of some length"] * 900
    for n in (1, 3, 16):
        rows = shards.partition(docs(spark, texts), n).collect()
        size, slots = Counter(), {}
        for r in rows:
            size[r.shard] += r.size
            slots.setdefault(r.shard, []).append(r.slot)
            assert r.size == len(texts[r.doc_id]) + 1
        assert set(size) == set(range(n)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(size.values()) - min(size.values()) <= 0.1 * sum(size.values()) / n
    few = shards.partition(docs(spark, ["a", None]), 16).collect()
    assert len(few) == 2 and all(0 <= r.shard < 16 for r in few)


def test_equal_texts_share_a_shard(spark):
    rng = random.Random(9)
    texts = ["x" * rng.randint(0, 200) + str(i // 3) for i in range(3000)]
    texts = [texts[i - i % 3] for i in range(3000)]
    df = docs(spark, texts).withColumn("source", (F.col("doc_id") % 7).cast("string"))
    by = {}
    for r in shards.partition(df, 8).collect():
        by.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for s in by.values()) <= 7


# --- 7


def test_small_and_large_buckets_give_the_same_links(monkeypatch):
    """Buckets in one tile or each in squares: the links join the same fingerprints, those of one key alone."""
    rng = np.random.default_rng(3)
    keys = np.sort(rng.integers(0, 40, 600))
    values = rng.integers(0, 1 << 8, 600, np.uint64) << np.uint64(3)
    values[::7] = (1 << 64) - 1
    rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(values.view(np.int64))], names=["key", "fingerprint"])
    near = [(a, b) for a in range(600) for b in range(a) if keys[a] == keys[b] and (int(values[a]) ^ int(values[b])).bit_count() <= 2 and values[a] != values[b]]
    want = plain_classes([(int(values[a]), int(values[b])) for a, b in near])
    for small in (0, 12, 64):
        monkeypatch.setattr(simhash, "SMALL", small)
        monkeypatch.setattr(simhash, "SQUARE", 8)
        out = list(simhash._compare(2)(iter([rows.slice(0, 100), rows.slice(100)])))
        pairs = [(u & (1 << 64) - 1, v & (1 << 64) - 1) for b in out for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert plain_classes(pairs) == want


def plain_classes(links):
    group = {}
    for a, b in links:
        one = group.get(a, {a}) | group.get(b, {b})
        for x in one:
            group[x] = one
    return {frozenset(g) for g in group.values()}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("aBÉ \n\x0b ", k=rng.randint(0, 60)))
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("tile", [7, 4096])
def test_components_of_fingerprints_by_brute_force(spark, tile):
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(40)]
    values = {c for c in centres}
    for c in centres[:20]:
        for _ in range(40):  # chains of steps within the radius
            c ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
            values.add(c)
    values = sorted(values | {0, 1, 3, (1 << 64) - 1})
    x = np.array(values, np.uint64)
    root = list(range(len(x)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(x)):
        for b in np.flatnonzero(np.bitwise_count(x ^ x[a]) <= 4).tolist():
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    want = {}
    for a in range(len(x)):
        want.setdefault(find(a), set()).add(int(x[a]))
    signed = x.view(np.int64).tolist()
    df = base.cut(spark.createDataFrame([(v,) for v in signed], "fingerprint long"), "t")
    for blocks in (None, 6, 7):
        got = {}
        for r in graph.components(simhash.near_links(df, 4, blocks, tile)).collect():
            got.setdefault(r.root, set()).add(r.node & (1 << 64) - 1)
        assert sorted(map(sorted, got.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(order[0], order[0])], "u long, v long")
    assert {(r.node, r.root) for r in graph.components(links).collect()} == {(i, 0) for i in range(n)}


def plain_similarity(a, b):
    def parts(text):
        words = (text or "").lower().split()
        return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()

    x, y = parts(a), parts(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("tile", [3, shingles.TILE])
def test_near_copies_by_brute_force(spark, monkeypatch, tile):
    rng = random.Random(11)
    texts = ["", None, "short text", "Short  TEXT"]
    for _ in range(12):
        text = rng.choices([f"w{i}" for i in range(500)], k=rng.randint(20, 200))
        for _ in range(6):  # edits one after the other, so that similarities lie on both sides of the limit
            texts.append(" ".join(text))
            for _ in range(rng.randint(0, 1 + len(text) // 60)):
                text[rng.randrange(len(text))] = rng.choice(["new", "other", "x"])
    n = len(texts)
    near = [[plain_similarity(a, b) >= 0.8 for b in texts] for a in texts]
    far = sum((simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count() > 8 for i, a in enumerate(texts) for j, b in enumerate(texts[:i]) if near[i][j])
    assert far > 5  # what fingerprints within eight bits lose
    first = list(range(n))
    for _ in range(n):
        first = [min(first[j] for j in range(n) if near[i][j]) for i in range(n)]
    links = shingles.near_links
    monkeypatch.setattr(shingles, "near_links", lambda members, least: links(members, least, tile))
    got = shingles.one_of_each(docs(spark, texts))
    assert sorted(r.doc_id for r in got.collect()) == [i for i in range(n) if first[i] == i]


def test_filter_loses_no_member(spark, monkeypatch):
    rows = spark.range(5000).select(F.xxhash64("id").alias("row"), F.col("id").cast("string").alias("text"))
    members = rows.where("cast(text as long) % 50 = 0").select("row")
    for bits, most in ((1 << 25, 130), (1 << 16, 200), (8, 5000)):
        monkeypatch.setattr(shingles, "FILTER_BITS", bits)
        got = {r.text for r in shingles._likely(rows, members).collect()}
        assert {str(i) for i in range(0, 5000, 50)} <= got and len(got) <= most
    assert shingles._likely(rows, members.limit(0)).count() == 0


def test_like_fingerprints_do_not_make_copies(spark):
    """Texts whose fingerprints are eight bits apart or fewer, but whose shingles are not alike, all stay."""
    common = " ".join(f"w{i}" for i in range(60))
    texts = [f"{common} {' '.join(f'{c}{i}' for i in range(25))}" for c in "abcdefghijklmnopqrstuvwxyz"]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    assert any((a ^ b).bit_count() <= 8 for i, a in enumerate(prints) for b in prints[:i])
    assert max(plain_similarity(a, b) for i, a in enumerate(texts) for b in texts[:i]) < 0.8
    assert shingles.one_of_each(docs(spark, texts)).count() == len(texts)


def test_one_row_of_each_group_of_near_copies_stays(spark):
    """Rows that share an id, or have none, are told apart by their texts."""
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text), (1, "another text altogether with more words"), (None, text + " more"), (None, "one without an id"), (None, "one without an id"), (2, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shingles.one_of_each(df)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([rows[0], rows[1], rows[3]]) and got.columns == df.columns
    odd_ones = odd(spark)
    assert shingles.one_of_each(odd_ones).columns == odd_ones.columns and shingles.one_of_each(odd_ones).count() == 4


# --- 8


def plain_removal(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = set()
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone |= set(range(i, i + length))
        runs = sum(p - 1 not in gone for p in gone)
        out.append((len(r), len(gone), runs, bytes(b for p, b in enumerate(r) if p not in gone)))
    return out


@pytest.mark.parametrize("group", [2, suffixes.GROUP])
def test_repeated_passages_by_brute_force(spark, group):
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abé", k=rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    make = lambda n: " ".join(word() for _ in range(n))
    texts = [make(rng.randint(0, 60)) + passage[rng.randint(0, 40) : rng.randint(80, 200)] + make(rng.randint(0, 40)) for _ in range(25)]
    texts += [None, "", "z" * 300, "xy" * 200, texts[0], texts[0], texts[3][5:], make(200), passage]
    # a passage that a third of the texts hold, some of them only in part, between words that no other has
    texts += [make(20) + passage[200 : 300 - 7 * (i % 3)] + make(20) for i in range(len(texts) // 2)]
    order = "".join("ab"[i.bit_count() % 2] for i in range(512))  # whose halves polynomial hashes confuse
    texts += [order, order.translate({97: 98, 98: 97}) + "c"]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.removal(docs(spark, texts), length=40, gram=16, group=group, keep_text=True).collect()}
    want = plain_removal(texts, 40)
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i])


def test_column_sort_gives_order_and_common_prefixes():
    rng = random.Random(13)
    strings = ["".join(rng.choices("ab", k=12)).encode() for _ in range(60)]
    sort = suffixes.ColumnSort(np.array([i % 2 for i in range(60)]))
    for c in range(11, -1, -1):
        sort.insert(np.array([s[c] for s in strings], np.int64))
        tails = [(i % 2, s[c:], i) for i, s in enumerate(strings)]
        assert [(g, t) for g, t, _ in sorted(tails)] == [tails[i][:2] for i in sort.order]
        for k in range(1, 60):
            a, b = tails[sort.order[k - 1]], tails[sort.order[k]]
            n = 0
            while a[0] == b[0] and n < len(a[1]) and a[1][n] == b[1][n]:
                n += 1
            assert sort.common[k] == n


def test_blocks_of_long_texts(monkeypatch):
    rng = random.Random(14)
    text = "".join(rng.choices("ab", k=3000)).encode()
    monkeypatch.setattr(suffixes, "BLOCK", 700)
    covered = []
    for _, start, size, _ in suffixes.pieces(text, 40, 16):
        covered += [w for s, n in zip(start.tolist(), size.tolist(), strict=True) for w in range(s, s + n - 39)]
    assert covered == list(range(len(text) - 39))


# --- 9


def test_licenses(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "This is under CC BY-NC 4.0 and cc by", "GNU General Public License version 3 or any later version",
        "apache license apache license", "SPDX-License-Identifier: BSD-3-Clause", "no such thing", "MIT LICENSE mit license", "submit licenses", "mit\n\nlicense",
    ]
    got = {r.doc_id: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert (got[0].base_labels, got[0].labels, got[0].n_base, got[0].score) == ("apache", "apache,apache-2.0", 1, 1.0)
    assert got[1].labels == "mit" and got[3].labels == "gpl,gpl-3.0"
    assert (got[2].labels, got[2].n_base) == ("cc-by,cc-by-nc-4.0", 2)
    assert (got[4].n_base, got[4].first_word, got[4].last_word) == (2, 0, 2)
    assert got[5].labels == "bsd-3-clause" and got[6].labels == "" and got[6].score == 0 and got[6].first_word is None
    assert got[7].n_base == 2 and got[8].n_base == 0 and got[9].n_base == 1


def plain_base(text):
    """The base columns of the contract, word by word."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    at = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))


def test_base_columns_by_brute_force(spark):
    rng = random.Random(23)
    parts = ["GNU", "general", "Public", "license", "apache", "Apache License", "cc", "by", "CC-BY", "mit", "MIT License", "gnu general public license", "É", "é", "x", "\n", "licence", None]
    texts = [" ".join(str(p) for p in rng.choices(parts, k=rng.randint(0, 14))) for _ in range(400)] + [None, ""]
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(docs(spark, texts)).collect()}
    assert got == {i: plain_base(t) for i, t in enumerate(texts)}


def one_match(tree, rng):
    """A random string that a parsed expression matches; looks around are left to the caller."""
    out = ""
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "IN":
            op, arg = rng.choice(arg)
            out += chr(arg if str(op) == "LITERAL" else rng.randint(*arg))
        elif kind == "BRANCH":
            out += one_match(rng.choice(arg[1]), rng)
        elif kind == "SUBPATTERN":
            out += one_match(arg[3], rng)
        elif kind == "MAX_REPEAT":
            out += "".join(one_match(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
        else:
            assert kind == "ASSERT_NOT", kind
    return out


def plain_detections(text, own):
    for rule in own:
        for m in re.finditer(rule["pattern"], text):
            start = text[: m.start()].count(" ")
            yield rule["rule"], start, start + m[0].count(" ") + 1


def test_no_match_of_a_rule_lacks_gate_or_keyword():
    rng = random.Random(9)
    own = licenses.rules()
    every = licenses.gate(own)
    assert len(own) > 500
    for rule in own:
        tree = re._parser.parse(rule["pattern"])
        for text in sorted({one_match(tree, rng) for _ in range(60)}):
            assert re.search(rule["pattern"], text), (rule, text)
            assert any(re.search(f"(?:^| )(?:{g})", f"a {text} b") for g in rule["gates"]) and any(k in text for k in rule["keywords"]), (rule, text)
            assert re.search(every, f"a {text} b") and re.search(every, text)


def test_every_rule_finds_its_own_sample(spark):
    """A text for each rule through the operator: detections as plain Python finds them, the rule's own among them."""
    rng, own, texts = random.Random(10), licenses.rules(), []
    for rule in own:
        tree = re._parser.parse(rule["pattern"])
        texts.append("before " + " ".join(one_match(tree, rng).split()) + " after")
    found = {}
    for r in licenses.detections(docs(spark, texts)).collect():
        found.setdefault(r.k1, set()).add((r.rule, r.start, r.end))
    for rule, text in zip(own, texts, strict=True):
        assert found[rule["rule"]] == set(plain_detections(text, own)), (rule, text)
        assert rule["rule"] in {x for x, _, _ in found[rule["rule"]]}
    labels = {r.doc_id: r.labels.split(",") for r in licenses.scan(docs(spark, texts)).collect()}
    assert all(labels[i] != [""] for i in range(len(own)))


def test_wording_of_licenses_is_found(spark):
    texts = {
        "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction": "mit",
        "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:": "bsd",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl",
        "you may not use this file except in compliance with the License.": "apache-2.0",
        "they were permitted to come with a disc": "",
    }
    got = {r.doc_id: r.labels for r in licenses.scan(docs(spark, list(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_short_names_are_found(spark):
    texts = {"Released under the MIT.": "mit", "covered by MPL 2.0": "mpl-2.0", "BSD 3-Clause": "bsd-3-clause", "Issued under the Expat.": "mit", "for example, simple": ""}
    got = {r.doc_id: r.labels for r in licenses.scan(docs(spark, list(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_suppression(spark):
    rows = [("a", 0, 10, 2), ("b", 2, 5, 2), ("c", 2, 5, 1), ("d", 8, 12, 3), ("e", 0, 10, 2), ("f", 9, 11, 2)]
    df = spark.createDataFrame([(1, 1, i, *r) for i, r in enumerate(rows)], "k1 long, k2 long, rule int, label string, start int, end int, priority int")
    assert sorted(r.label for r in licenses.survivors(df).collect()) == ["a", "c", "d", "f"]


# --- 10


def test_base_spans():
    text = 'x token = "abcdef" Password:short API_KEY=abc-def_g AKIA' + "A" * 16 + " " + "0a" * 12 + " ſecret=abcdefg"
    spans = secrets.base_spans(text)
    assert [k for k, _, _ in spans] == ["assign", "assign", "access", "hex"]
    assert [text[a:b] for _, a, b in spans] == ['token = "abcdef', "API_KEY=abc-def", "AKIA" + "A" * 16, "0a" * 12][:1] + [text[spans[1][1] : spans[1][2]], "AKIA" + "A" * 16, "0a" * 12]
    both = "secret=" + "ab12" * 8
    assert secrets.written(secrets.base_spans(both)) == f"assign:0:{len(both)},hex:7:{len(both)}"


def test_patterns_agree_with_those_of_the_contract():
    rng = random.Random(15)
    for _ in range(3000):
        text = "".join(rng.choices("af09g AKI", k=80)) + "AKIA" * rng.randint(0, 8)
        plain = [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
        plain += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
        assert secrets.base_spans(text) == sorted(plain, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def plain_assign(text):
    """The assign kind, character by character."""
    names, spaces, value = ["password", "passwd", "secret", "token", "api_key", "apikey"], " ", set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low = "".join(c.lower() if c.isascii() else c for c in text)
    out, i = [], 0
    while i < len(text):
        # a pattern tries the names in order, and goes back to fewer spaces, quotes and value characters if need be
        name = next((n for n in names if low.startswith(n, i)), None)
        end = None
        if name:
            at = i + len(name)
            at += text[at : at + 1] in ('"', "'") and text[at : at + 1] != ""
            while text[at : at + 1] == spaces:
                at += 1
            if text[at : at + 1] in (":", "="):
                at += 1
                while text[at : at + 1] == spaces:
                    at += 1
                at += text[at : at + 1] in ('"', "'") and text[at : at + 1] != ""
                end = at
                while text[end : end + 1] and text[end] in value:
                    end += 1
                if end == at:
                    end = None
        if end is None:
            i += 1
            continue
        if end - at >= 6:
            out.append(("assign", i, end))
        i = end
    return out


def test_assignments_by_brute_force():
    rng = random.Random(21)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "apikey", '"', "'", " ", " ", ":", "=", ":", "=", "abc", "x9+/", "_.=-", "é", "ſecret", "passwordpasswd", "ab12cd"]
    hits = 0
    for _ in range(20000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 9)))
        got = [x for x in secrets.base_spans(text) if x[0] == "assign"]
        assert got == plain_assign(text), text
        hits += bool(got)
    assert hits > 500


def test_random_strings_are_told_from_identifiers():
    """On samples that nothing was learned from, by the kind of string; strings of one case and numbers are judged like others."""
    model, said = secrets.default_model(), {}
    for t, y in secrets.labelled_samples(2000, seed=99):
        kind = "digits" if t.replace("-", "").isdigit() else "one case" if t.isalpha() and (t.islower() or t.isupper()) else "other"
        said.setdefault((kind, y), []).append(model.score(t) > model.threshold)
    assert set(said) == {("digits", 0), ("one case", 0), ("one case", 1), ("other", 0), ("other", 1)}
    for (_, y), hits in said.items():
        assert sum(hits) >= 0.97 * len(hits) if y else sum(hits) <= 0.005 * len(hits)


def test_model_spans_by_brute_force(spark):
    """Every run of the candidates' characters is judged by log probabilities summed one character at a time."""
    rng, model = random.Random(22), secrets.default_model()
    samples = [t for t, _ in secrets.labelled_samples(300, seed=5)]
    texts = [" ".join(rng.choices(samples + ["plain", "words", "token=abcdef0123", "(x)", "é" + samples[0], "0a" * 14], k=rng.randint(1, 12))) for _ in range(60)]
    counts = np.full((2, len(secrets.CLASSES) + 1, len(secrets.CLASSES) + 1), 0.5)
    place = {c: i for i, c in enumerate(secrets.CLASSES)}
    for t, y in secrets.labelled_samples():
        states = [len(place), *(place[c] for c in t), len(place)]
        for a, b in zip(states, states[1:], strict=False):
            counts[y, a, b] += 1
    p = counts / counts.sum(axis=2, keepdims=True)
    added = 0
    for text, r in zip(texts, sorted(secrets.scan(docs(spark, texts)).collect(), key=lambda r: r.doc_id), strict=True):
        base_spans, want = secrets.base_spans(text), []
        for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
            around = text[m.start() - 1 : m.start()] + text[m.end() : m.end() + 1]
            if len(m[0]) < 16 or re.search(r"\w", around) or any(a < m.end() and b > m.start() for _, a, b in base_spans):
                continue
            states = [len(place), *(place[c] for c in m[0]), len(place)]
            ratio = sum(np.log(p[1, a, b] / p[0, a, b]) for a, b in zip(states, states[1:], strict=False)) / (len(states) - 1)
            if ratio > model.threshold:
                want.append(("random", *m.span()))
        added += len(want)
        assert r.spans == secrets.written(sorted(base_spans + want, key=lambda s: (s[1], secrets.KINDS.index(s[0]))))
    assert added > 50


def test_redaction(spark):
    df = docs(spark, ["my password=hunter22 and Zx81kQ0bTr7LmW3eVu5y end", None, "plain words only", "token=abcdef0123456789abcdef0123"])
    got = {r.doc_id: r.text for r in secrets.redacted(df).collect()}
    assert got == {0: "my [SECRET] and [SECRET] end", 1: None, 2: "plain words only", 3: "[SECRET]"}
    assert secrets.redacted(df).columns == df.columns

"""BPE encoding and decoding with forced-boundary splitting.

A merge can only join two bytes that stand side by side inside some token of the vocabulary. Where a pair of bytes is
inside none, no merge can reach across it: the place is a certain cut. A word is split at its certain cuts, each
fragment is encoded on its own (and kept, since fragments come back often), and the ids are put together.

Null texts count as empty and give no ids. Very long texts are encoded whole, piece by piece. Repeated rows are encoded
each; an empty table gives an empty result; input columns that have the name of a result are replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata

import regex
from pyspark.sql import DataFrame, SparkSession

from foliant.llm.base import annotate, field, table

#: Chunks in each of the two generations that a worker keeps the ids of. When one is full, it becomes the old one, and what is
#: asked for again moves to the new one; the rest is forgotten, which costs time and no result.
CACHE_ENTRIES = 200_000

#: The last character for which every Unicode version in use agrees about letters, digits and case.
STABLE = "\u052f"

_ENGINES: dict[str, ForcedBoundaryBPE] = {}


def byte_alphabet() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(rest)) for b in range(256)]


class ForcedBoundaryBPE:
    """An encoder for a byte-level BPE file whose last piece of a word carries an end suffix."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import Split

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.inner = {t[i : i + 2] for t in (v.removesuffix(self.suffix) if self.suffix else v for v in vocab) for i in range(len(t) - 1)}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tail = Tokenizer(BPE(vocab=vocab, merges=merges, end_of_word_suffix=self.suffix or None))
        self.body = Tokenizer(BPE(vocab=vocab, merges=merges))
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.beyond = regex.compile(f"[^\\x00-{STABLE}]").search
        self.chars = byte_alphabet()
        self.written = {str(i): t for i, t in self.tokens.items()}
        #: Ids of chunks, written with a space between.
        self.chunks: dict[str, str] = {}
        self.old: dict[str, str] = {}

    def normal(self, text: str) -> str:
        """NFC and lower case, character by character: a final capital sigma has no form of its own here.

        Beyond STABLE the Unicode versions of Python and of the library differ, so the file's own normalizer is asked.
        """
        if text.isascii():
            return text.lower()
        if self.beyond(text):
            return self.normalizer.normalize_str(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def cuts(self, word: str) -> list[str]:
        """The fragments of a word in the byte alphabet, split at the pairs that no token holds."""
        inner, out, start = self.inner, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in inner:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def _pieces(self, chunk: str) -> list[tuple[str, bool]]:
        out = []
        for word in [w for w, _ in self.splitter.pre_tokenize_str(chunk)] if self.beyond(chunk) else self.words(chunk):
            raw = word if word.isascii() and word.isprintable() else "".join(self.chars[b] for b in word.encode())
            parts = self.cuts(raw)
            out += [(p, False) for p in parts[:-1]]
            out.append((parts[-1], True))
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encode the chunks that are not known yet, all in one go."""
        pieces = {c: self._pieces(c) for c in chunks if c[0] != " "}
        self.chunks |= {c: str(self.special[c[1:]]) for c in chunks if c[0] == " "}
        new = {p for ps in pieces.values() for p in ps}
        ids_of: dict[tuple[str, bool], str] = {}
        for last, engine in ((True, self.tail), (False, self.body)):
            texts = [p for p, end in new if end is last]
            for text, got in zip(texts, engine.encode_batch(texts, add_special_tokens=False) if texts else (), strict=True):
                ids_of[text, last] = " ".join(map(str, got.ids))
        for c, ps in pieces.items():
            self.chunks[c] = " ".join([ids_of[p] for p in ps])

    def split(self, texts: list[str | None]) -> list[list[str]]:
        """Each text as chunks between white space; a special token is a chunk of a space and its content."""
        out = []
        for text in texts:
            if not text:
                out.append([])
            elif self.specials and self.specials.search(text):
                chunks = []
                for k, part in enumerate(self.specials.split(text)):
                    chunks += [" " + part] if k % 2 else self._split(self.normal(part))
                out.append(chunks)
            else:
                out.append(self._split(self.normal(text)))
        return out

    @staticmethod
    def _split(text: str) -> list[str]:
        if regex.search("[\x1c-\x1f]", text):  # white space for str.split, not for the vocabulary's pattern
            return [c for c in regex.split(r"[\s--[\x1c-\x1f]]+", text, flags=regex.V1) if c]
        return text.split()

    def encoded(self, texts: list[str | None]) -> list[str]:
        """The ids of each text, written with a space between."""
        split = self.split(texts)
        if len(self.chunks) > CACHE_ENTRIES:
            self.chunks, self.old = {}, self.chunks
        known, old = self.chunks, self.old
        missing = {c for chunks in split for c in chunks if c not in known}
        again = missing & old.keys()
        known |= {c: old[c] for c in again}
        self.learn(missing - again)
        return [" ".join([known[c] for c in chunks]) for chunks in split]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [list(map(int, ids.split())) for ids in self.encoded(texts)]

    def decode(self, ids: list[int]) -> str:
        """The tokens with a space between: the file names no decoder. Special tokens stay; unknown ids are left out."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])

    def digests(self, texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
        n, ids, decoded, digest = [], [], [], lambda t: hashlib.sha256(t.encode()).hexdigest()
        for written in self.encoded(texts):
            parts = written.split(" ") if written else []
            n.append(len(parts))
            ids.append(digest(written))
            decoded.append(digest(" ".join([self.written[i] for i in parts])))
        return n, ids, decoded


def engine(path: str) -> ForcedBoundaryBPE:
    """The worker's encoder for a file, built once."""
    if path not in _ENGINES:
        _ENGINES[path] = ForcedBoundaryBPE(path)
    return _ENGINES[path]


def forget(path: str) -> None:
    """Drop the chunks that the worker's encoder remembers."""
    if path in _ENGINES:
        _ENGINES[path].chunks, _ENGINES[path].old = {}, {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids", carry: list[str] | None = None) -> DataFrame:
    """Add the ids of every whole text."""
    return annotate(docs, lambda: lambda texts: [engine(path).encode(texts)], [field(out, "array<int>")], text, carry, lambda: forget(path))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded", carry: list[str] | None = None) -> DataFrame:
    """Add the text that a column of ids stands for; null ids give null."""
    return annotate(docs, lambda: lambda rows: [[None if r is None else engine(path).decode(r) for r in rows]], [field(out, "string")], ids, carry)


def digest(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add n_tokens and the digests of the ids and of their decoding, without moving the ids themselves."""
    fields = [field("n_tokens", "long"), field("ids_sha256", "string"), field("decoded_sha256", "string")]
    return annotate(docs, lambda: lambda texts: engine(path).digests(texts), fields, text, carry, lambda: forget(path))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), carry=["doc_id"])

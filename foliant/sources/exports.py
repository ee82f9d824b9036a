"""Large JSON documents whose top level holds lists, as a data source of list items: spark.read.format("json_items").load(path).

A document is read a piece at a time, and each item of a list is handed on as soon as it is whole, so that a document of any
size needs the memory of its largest item. A row has the file's name, the list's name, the item's place in it and the item as JSON
text. A filter on list leaves out what other lists hold without parsing their items twice; top-level values that are no lists
are left out. A broken document fails the query that reads it.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from foliant.sources.stores import listed, store

ITEM = "file string, list string, n long, item string"
_ARROW = pa.schema([("file", pa.string()), ("list", pa.string()), ("n", pa.int64()), ("item", pa.string())])
#: Bytes that are read at a time at first; while an item does not fit, twice as many each time.
CHUNK = 1 << 16
#: Bytes of files that share a partition, and what a file counts at least, since to open one takes a while too.
PACKED, OPENED = 16 << 20, 64 << 10
#: Rows of a batch, and bytes of its items.
BATCH, BATCH_BYTES = 8192, 8 << 20
_SPACE = " \t\n\r"


class _Text:
    """A document's text as far as it is needed."""

    def __init__(self, pieces: Iterator[str]):
        self.pieces, self.text, self.at, self.ended = pieces, "", 0, False

    def more(self, least: int = 1) -> bool:
        """Read on, dropping what is done; False at the end."""
        got = []
        while least > 0 and not self.ended:
            piece = next(self.pieces, None)
            self.ended = piece is None
            if piece:
                got.append(piece)
                least -= len(piece)
        self.text, self.at = self.text[self.at :] + "".join(got), 0
        return bool(got)

    def peek(self) -> str:
        """The next letter that is not space, or nothing at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in _SPACE:
                self.at += 1
            if self.at < len(self.text) or not self.more():
                return self.text[self.at : self.at + 1]

    def take(self, letter: str) -> None:
        if self.peek() != letter:
            raise ValueError(f"{letter!r} is missing before {self.text[self.at : self.at + 40]!r}")
        self.at += 1

    def value(self) -> tuple[object, str]:
        """The next value and its text."""
        self.peek()
        while True:
            try:
                value, end = json.JSONDecoder().raw_decode(self.text, self.at)
                if end < len(self.text) or self.ended:  # a number may go on behind what is there
                    break
                bad = None
            except json.JSONDecodeError as e:
                bad = e
            if not self.more(max(1, len(self.text) - self.at)) and bad:
                raise ValueError(f"a value is broken or cut short: {bad}")
        raw, self.at = self.text[self.at : end], end
        return value, raw


def items(pieces: Iterator[str], wanted: set[str] | None = None) -> Iterator[tuple[str, int, str]]:
    """(list, place, text) of the items of a document's top-level lists, or of those that are wanted."""
    doc = _Text(pieces)
    doc.take("{")
    while doc.peek() != "}":
        name, _ = doc.value()
        doc.take(":")
        if doc.peek() != "[":
            doc.value()
        else:
            doc.take("[")
            n = 0
            while doc.peek() != "]":
                _, raw = doc.value()
                if wanted is None or name in wanted:
                    yield name, n, raw
                n += 1
                if doc.peek() != "]":
                    doc.take(",")
            doc.take("]")
        if doc.peek() != "}":
            doc.take(",")
    doc.take("}")
    if doc.peek():
        raise ValueError("more follows behind the document")


def pieces(path: str, base: str) -> Iterator[str]:
    files, _ = store(base)
    decode = codecs.getincrementaldecoder("utf-8")()
    with files.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as stream:
        while data := stream.read(CHUNK):
            yield decode.decode(data)
        yield decode.decode(b"", True)


@dataclass
class Files(InputPartition):
    paths: list[str]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if len(held) == BATCH or size >= BATCH_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


class ItemsReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.lists = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("list",):
                names = set(f.value if isinstance(f, In) else [f.value])
                self.lists = names if self.lists is None else self.lists & names
            else:
                yield f

    def partitions(self) -> list[Files]:
        packs, room = [Files([])], PACKED
        for f in listed(self.path):
            if f.path.endswith((".json", ".json.gz")):
                size = max(f.size or 0, OPENED)
                if size > room and packs[-1].paths:
                    packs.append(Files([]))
                    room = PACKED
                packs[-1].paths.append(f.path)
                room -= size
        return packs

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _batches((path.rsplit("/", 1)[-1], *item) for path in partition.paths for item in items(pieces(path, self.path), self.lists))


class JsonItems(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_items"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema) -> ItemsReader:
        return ItemsReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonItems)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

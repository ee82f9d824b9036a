"""OCR words in hOCR files as a data source: spark.read.format("hocr").load(folder).

A folder is searched at all depths for names that end in hocr.html or hocr.html.gz; an issue's plain file is read before
a packed one, and of several the last path. Filters on issue_id choose files before any is opened; filters on page stop a file's
reading after the last page that is asked for. Files are parsed as they are read, so that neither a file nor an issue is
held whole, and small files share a partition.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html import unescape
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from foliant.sources.stores import listed, store

WORD = "issue_id string, page int, line_no int, word_no int, text string, x0 int, y0 int, x1 int, y1 int"
_ARROW = pa.schema([("issue_id", pa.string())] + [(c, pa.string() if c == "text" else pa.int32()) for c in ("page", "line_no", "word_no", "text", "x0", "y0", "x1", "y1")])
#: Bytes that are fed to the parser at a time, rows of a batch, and bytes of files that share a partition.
CHUNK, BATCH, PACKED = 1 << 16, 8192, 32 << 20
#: A part of a path that names an issue: the id, any character, and the kind of file.
_ISSUE = re.compile(r"(?:^|/)([^/]+?)[^/]c?hocr\.html(?:\.gz)?(?:/|$)")


#: Text and end tags, which mean nothing outside a word; a word as most writers write it; and start tags of common elements.
_SPACES, _VALUE = r"[ \t\n\r\f]", r"(?:'[^'<>&]*'|\"[^\"<>&]*\")"
_BETWEEN = re.compile(r"(?:[^<]++|</[a-z]++>)*+")
_WORD = re.compile(
    rf"{_BETWEEN.pattern}<span class=(['\"])ocrx_word\1(?: (?:id|lang|dir)={_VALUE})*"
    rf" title=(['\"])bbox (-?\d+) (-?\d+) (-?\d+) (-?\d+)[^'\"<>&]*\2(?: (?:id|lang|dir)={_VALUE})*>([^<]*)</span>"
)
_TAG = re.compile(rf"{_BETWEEN.pattern}<(html|head|body|div|p|span|em|strong)((?:{_SPACES}+[a-z_:][-a-z_:.0-9]*={_VALUE})*){_SPACES}*>")
_ATTRIBUTE = re.compile(r"([-a-z_:.0-9]+)=(?:'([^']*)'|\"([^\"]*)\")")


class HocrParser(HTMLParser):
    """Lines and words of hOCR, page by page: feed() it pieces of a file and take() what they complete.

    Plain words and tags are told by expressions, some ten times faster than by HTMLParser, which reads all else.
    """

    BOX = re.compile(r"bbox\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)\s+(-?\d+)")

    def __init__(self):
        super().__init__()
        self.rows: list[tuple] = []
        self.page = self.line = -1
        self.word = 0
        self.open: list | None = None
        self.depth = 0
        self.left = ""

    def feed(self, data: str) -> None:
        text, at = self.left + data if self.left else data, 0
        while True:
            if not self.rawdata and self.open is None and self.cdata_elem is None:
                at = self._plain(text, at)
                end = text.find(">", at) + 1
            else:  # as much again as waits to be told, so that long comments are not read again and again
                end = text.find(">", at + len(self.rawdata)) + 1
            if not end:
                break
            super().feed(text[at:end])
            at = end
        self.left = text[at:]

    def _plain(self, text: str, at: int) -> int:
        """Take plain words and tags from a place on, where no word is open; the place of what is not plain or not whole."""
        word, tag, add = _WORD.match, _TAG.match, self.rows.append
        while True:
            if m := word(text, at):
                _, _, x0, y0, x1, y1, inner = m.groups()
                add((self.page, max(self.line, 0), self.word, (unescape(inner) if "&" in inner else inner).strip(), int(x0), int(y0), int(x1), int(y1)))
                self.word += 1
            elif (m := tag(text, at)) and "ocrx_word" not in m[2]:
                if "ocr" in m[2]:
                    self.handle_starttag(m[1], [(name, a or b) for name, a, b in _ATTRIBUTE.findall(m[2])])
            else:
                return _BETWEEN.match(text, at).end()
            at = m.end()

    def _close_line(self) -> None:
        if self.line >= 0 and self.word == 0 and self.page >= 0:
            self.rows.append((self.page, self.line, None, None, None, None, None, None))

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        kinds = (at.get("class") or "").split()
        if self.open is not None:
            self.depth += tag not in ("br", "img", "wbr")
        if "ocr_page" in kinds:
            self._close_line()
            self.page, self.line, self.word = self.page + 1, -1, 0
        elif "ocr_line" in kinds or {"ocr_header", "ocr_caption", "ocr_textfloat"} & set(kinds):
            self._close_line()
            self.line, self.word = self.line + 1, 0
        elif "ocrx_word" in kinds and (m := self.BOX.search(at.get("title") or "")):
            self.open, self.depth = [[], tuple(map(int, m.groups()))], 1

    def handle_data(self, data):
        if self.open is not None:
            self.open[0].append(data)

    def handle_endtag(self, tag):
        if self.open is None:
            return
        self.depth -= 1
        if self.depth <= 0:
            text, box = "".join(self.open[0]).strip(), self.open[1]
            self.rows.append((self.page, max(self.line, 0), self.word, text, *box))
            self.word, self.open = self.word + 1, None

    def close(self):
        super().feed(self.left)
        self.left = ""
        super().close()
        self._close_line()

    def take(self) -> list[tuple]:
        """Rows that are whole by now, once each."""
        out, self.rows = self.rows, []
        return out


def parse(chunks: Iterable[bytes], first: int = 0, last: int | None = None) -> Iterator[tuple]:
    """(page, line_no, word_no, text, x0, y0, x1, y1) of each word on pages first to last; a line without words has nulls.

    Pages count from 0. Nothing is read behind the last page.
    """
    parser, decode = HocrParser(), codecs.getincrementaldecoder("utf-8")("replace")
    for chunk in chunks:
        parser.feed(decode.decode(chunk))
        rows = parser.take()
        if rows and rows[0][0] >= first and (last is None or rows[-1][0] <= last):  # pages rise
            yield from rows
        else:
            yield from (r for r in rows if r[0] >= first and (last is None or r[0] <= last))
        if last is not None and parser.page > last:
            return
    parser.feed(decode.decode(b"", True))
    parser.close()
    for row in parser.take():
        if row[0] >= first and (last is None or row[0] <= last):
            yield row


def chunks(files: fs.FileSystem, at: str) -> Iterator[bytes]:
    """A file's bytes as they are read, unpacked if its name says so."""
    with files.open_input_stream(at, compression="gzip" if at.endswith(".gz") else None) as stream:
        while data := stream.read(CHUNK):
            yield data


def issue_files(path: str) -> dict[str, tuple[str, int]]:
    """The file of each issue below a folder, and its size; as paths within the store."""
    out: dict[str, tuple[bool, str, int]] = {}
    for f in listed(path):
        if not re.search(r"hocr\.html(\.gz)?$", f.path) or not (m := _ISSUE.search(f.path)):
            continue
        plain = not f.path.endswith(".gz")
        if m[1] not in out or (plain, f.path) > out[m[1]][:2]:
            out[m[1]] = plain, f.path, f.size or 0
    return {issue: (at, size) for issue, (_, at, size) in out.items()}


@dataclass
class Files(InputPartition):
    """Issues and the paths of their files."""

    files: list[tuple[str, str]]


class HocrReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.issues: set[str] | None = None
        self.first, self.last = 0, None

    def _only(self, issues: set) -> None:
        self.issues = issues if self.issues is None else self.issues & issues

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = ".".join(getattr(f, "attribute", ()))
            if name == "issue_id" and isinstance(f, (EqualTo, EqualNullSafe, In)):
                self._only({v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None})
                continue
            if name == "page" and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                values = [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]
                if values and not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.first = max(self.first, min(values))
                if values and not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.last = max(values) if self.last is None else min(self.last, max(values))
            yield f  # Spark still looks at each row, and at what is not understood here

    def partitions(self) -> list[Files]:
        found = issue_files(self.path)
        wanted = sorted(i for i in found if self.issues is None or i in self.issues)
        packs: list[Files] = []
        room = 0
        for issue in wanted:
            at, size = found[issue]
            if not packs or size > room:
                packs.append(Files([]))
                room = PACKED
            packs[-1].files.append((issue, at))
            room -= size
        return packs or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        files, _ = store(self.path)
        for issue, at in partition.files:
            found = parse(chunks(files, at), self.first, self.last)
            while rows := list(islice(found, BATCH)):
                yield _batch(issue, rows)


def _batch(issue: str, rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_ARROW)[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(issue, pa.string()), len(rows)), *columns], schema=_ARROW)


class HocrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hocr"

    def schema(self) -> str:
        return WORD

    def reader(self, schema) -> HocrReader:
        return HocrReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach it."""
    spark.dataSource.register(HocrSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

"""Files with names of their own as a data sink: rows of name and content become one file each.

A task writes into a folder of its own, out of sight; when all tasks are done the driver moves the files to their names, and
when one fails it deletes what there is. So readers see all files of a write or none of a failed one, and a task that runs
twice leaves nothing behind. Names may have folders. A name that comes twice, or is there already, is an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from foliant.sources.stores import store

FILE = "name string, content binary"
#: Files that the driver moves at a time.
MOVERS = 16


@dataclass
class Staged(WriterCommitMessage):
    """What one task has written: its folder, and how many files."""

    folder: str
    files: int


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path
        self.staging = f"{store(path)[1]}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, _ = store(self.path)
        folder = f"{self.staging}/{uuid.uuid4().hex}"
        files.create_dir(folder, recursive=True)
        n = 0
        for row in iterator:
            parts = (row.name or "").split("/")
            if "" in parts or ".." in parts or row.name.startswith("_"):
                raise ValueError(f"{row.name!r} is no name of a file")
            at = f"{folder}/{row.name}"
            if len(parts) > 1:
                files.create_dir(at.rsplit("/", 1)[0], recursive=True)
            if files.get_file_info(at).type != fs.FileType.NotFound:
                raise ValueError(f"two rows have the name {row.name!r}")
            with files.open_output_stream(at) as out:
                out.write(bytes(row.content or b""))
            n += 1
        return Staged(folder, n)

    def commit(self, messages: list[Staged | None]) -> None:
        files, top = store(self.path)
        moves = {}
        for m in messages:
            for f in files.get_file_info(fs.FileSelector(m.folder, recursive=True)) if m else ():
                if f.type == fs.FileType.File:
                    to = top + f.path[len(m.folder) :]
                    if to in moves:
                        raise ValueError(f"two rows have the name {to[len(top) + 1 :]!r}")
                    moves[to] = f.path
        there = [f.path for f in files.get_file_info(list(moves)) if f.type != fs.FileType.NotFound] if moves else []
        if there:
            raise ValueError(f"{there[0]} is there already")
        for folder in {to.rsplit("/", 1)[0] for to in moves}:
            files.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda x: files.move(x[1], x[0]), moves.items()))
        files.delete_dir(self.staging)

    def abort(self, messages: list[Staged | None]) -> None:
        files, _ = store(self.path)
        if files.get_file_info(self.staging).type == fs.FileType.Directory:
            files.delete_dir(self.staging)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return FILE

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options["path"])


def write(rows: DataFrame, path: str, name: str = "name", content: str = "content") -> None:
    """Write a file for each row of name and content (bytes or text) below a folder."""
    spark = rows.sparkSession
    spark.dataSource.register(NamedFiles)
    rows.select(rows[name].cast("string").alias("name"), rows[content].cast("binary").alias("content")).write.format("named_files").mode("append").option("path", path).save()

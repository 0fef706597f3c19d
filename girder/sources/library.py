"""A folder of family descriptions as a Spark data source, with what is wrong with each file in its row.

``spark.read.format("girder_library").load(folder)``: a row for each file. Files are read in
partitions of bounded size wherever pyarrow's file systems reach; a file that can't be
read or is no description gives a row with an error and stops nothing.
"""

from __future__ import annotations

import csv
import io
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from girder.sources.text import _atom, encoding_of

NAME = "girder_library"
#: Files and bytes of a partition; a larger file is one by itself.
FILES, BYTES = 1000, 64 << 20
SCHEMA = "path string, bytes long, kind string, title string, id string, updated string, categories array<string>, types array<string>, columns array<string>, error string"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if re.match(r"^file:/(?!/)", path):
        path = path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


@dataclass
class Files(InputPartition):
    """Files that one task reads: (path, size)."""

    files: list[tuple[str, int]]

    def __post_init__(self):
        super().__init__(None)


def described(content: bytes) -> tuple:
    """(kind, title, id, updated, categories, types, columns, error) of a file's bytes: Atom where it begins with a tag, else a type catalog."""
    try:
        name, _, mark = encoding_of(content)
        text = content[mark:].decode("cp1252" if name == "windows-1252" else "cp1251" if name == "windows-1251" else name)
    except UnicodeDecodeError as e:
        return None, None, None, None, None, None, None, f"encoding: {e}"
    if not text.strip():
        return None, None, None, None, None, None, None, "empty"
    if text.lstrip().startswith("<"):
        title, identifier, updated, categories, error = _atom(text)
        return "atom", title, identifier, updated, categories, None, None, error
    try:
        rows = list(csv.reader(io.StringIO(text, newline=""), strict=True))
    except csv.Error as e:
        return "catalog", None, None, None, None, None, None, f"malformed: {e}"
    columns = [c.split("##")[0].strip() for c in rows[0][1:]]
    types = [r[0].strip() for r in rows[1:] if r and r[0].strip()]
    if rows[0][0].strip() or not any(columns):
        return "catalog", None, None, None, None, None, None, "malformed: no header of columns"
    wide = next((k for k, r in enumerate(rows[1:], 2) if r and len(r) > len(rows[0])), None)
    return "catalog", None, None, None, None, types, columns, None if wide is None else f"malformed: row {wide} has more cells than the header"


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Files]:
        system, root = _open(self.path)
        infos = system.get_file_info(fs.FileSelector(root, recursive=True))
        listed = sorted((i.path, i.size or 0) for i in infos if i.type == fs.FileType.File and not i.base_name.startswith((".", "_")))
        out: list[list[tuple[str, int]]] = [[]]
        held = 0
        for path, size in listed:
            if out[-1] and (len(out[-1]) >= FILES or held + size > BYTES):
                out.append([])
                held = 0
            out[-1].append((path, size))
            held += size
        return [Files(f) for f in out]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _open(self.path)
        for path, size in partition.files:
            try:
                with system.open_input_stream(path) as f:
                    content = f.read()
            except OSError as e:
                yield (path, size, *[None] * 7, f"unreadable: {e}")
                continue
            yield (path, len(content), *described(content))


class Library(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])


def read_library(spark: SparkSession, folder: str):
    """A row for each file below a folder."""
    spark.dataSource.register(Library)
    return spark.read.format(NAME).load(folder)

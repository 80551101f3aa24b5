"""Openings of files as a Spark data source: files are listed once and read in tasks, a few bytes of each.

Every file has a row, empty ones included. ``content`` holds the first ``HEAD`` bytes, or, if these are all
blank, a blank and what follows the blanks. ``first`` is the first byte that is not blank (nor a
byte-order mark), ``whole_line`` whether a JSON value that begins there ends before the first line break.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD = 64
#: Bytes read at once where more than the head is needed.
PIECE = 1 << 20
#: Files of one task.
FILES = 128
BLANK = b" \t\n\r\x0b\f"
MARK = b"\xef\xbb\xbf"
SCHEMA = "path string, length bigint, content binary, first string, whole_line boolean"


@dataclass
class Group(InputPartition):
    files: list[tuple[str, str, int]]


def opening(file) -> bytes:
    """The head; if it is all blank, a blank and what follows the blanks."""
    data = file.read(HEAD)
    if data.strip(BLANK):
        return data
    while part := file.read(PIECE):
        if rest := part.lstrip(BLANK):
            return b" " + rest[: HEAD - 1]
    return data


def ends_in_line(file) -> bool:
    """Whether the brackets that are opened in the file's first line that is not blank are closed in it.

    Read piece by piece up to the first line break; JSON holds none inside a string.
    """
    depth, quoted, escaped, begun = 0, False, False, False
    while part := file.read(PIECE):
        for byte in part:
            if byte in b"\r\n":
                if begun:
                    return depth == 0
            elif escaped:
                escaped = False
            elif quoted:
                escaped, quoted = byte == 0x5C, byte != 0x22
            elif byte == 0x22:
                quoted = True
            elif byte in b"{[":
                depth, begun = depth + 1, True
            elif byte in b"}]":
                depth -= 1
    return depth == 0


class HeadsReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[InputPartition]:
        fs, root = pa.fs.FileSystem.from_uri(self.uri)
        info = fs.get_file_info(root)
        if info.type == pa.fs.FileType.NotFound:
            raise FileNotFoundError(self.uri)
        found = [info] if info.is_file else fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
        inside = len(root.rstrip("/")) + 1
        # as for Spark's own sources, names that begin with an underscore or a dot are no data
        files = sorted(
            (f.path, f.size) for f in found
            if f.is_file and (f is info or not any(p[0] in "_." for p in f.path[inside:].split("/")))
        )
        prefix = self.uri.split("://")[0] + "://"
        rows = [(prefix + path, path, size) for path, size in files]
        return [Group(rows[k : k + FILES]) for k in range(0, len(rows), FILES)] or [Group([])]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        fs, _ = pa.fs.FileSystem.from_uri(self.uri)
        rows = []
        for name, path, size in partition.files:
            with fs.open_input_stream(path, compression=None) as file:
                content = opening(file)
            first = content.removeprefix(MARK).lstrip(BLANK).removeprefix(MARK)[:1].decode("latin-1")
            whole = None
            if first == "{":
                with fs.open_input_stream(path, compression=None) as file:
                    whole = ends_in_line(file)
            rows.append((name, size, content, first, whole))
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.string(), pa.bool_()]
        names = ["path", "length", "content", "first", "whole_line"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


class FileHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HeadsReader(self.options["path"])


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its store's scheme, as the session resolves it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toUri().toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file:///") else whole


def file_heads(spark: SparkSession, path: str) -> DataFrame | None:
    """(path, length, content, first, whole_line) of every file below ``path``; None where the store is one that only Spark reads."""
    uri = qualified(spark, path)
    try:
        pa.fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid:
        return None
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").option("path", uri).load()

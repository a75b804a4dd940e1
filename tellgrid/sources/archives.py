"""Python data sources for archives: members of zip files, and items of JSON documents too large for one row.

``zip_members``: options ``path`` (a file, a folder or, locally, a glob; with an address such as hdfs:// or s3:// on any file system) and ``pattern`` (a regular expression on member names);
rows are archive, member, position, content. Only the directories of the archives are read on the driver; members are
read in partitions of about ``partition_bytes`` that do not cross archives.

``json_items``: options ``path``, ``member`` (for a zip file), ``field`` and ``kind`` (``items`` of an array or ``pairs`` of
a map at the top level); rows are position, key, value with the value as JSON text. The document is decoded in a sliding
buffer, so memory is bounded by the largest item, whatever the size of the document.
"""

from __future__ import annotations

import glob
import io
import json
import os
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Uncompressed bytes of members that one partition reads.
PARTITION_BYTES = 64 << 20
_CHUNK = 1 << 20


def _paths(path: str) -> list[str]:
    files, own = _filesystem(path)
    if any(c in own for c in "*?["):
        if not isinstance(files, fs.LocalFileSystem):
            raise ValueError(f"patterns are for local folders only: {path}")
        return sorted(glob.glob(own))
    info = files.get_file_info(own)
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    if info.type == fs.FileType.Directory:
        return sorted(prefix + f.path for f in files.get_file_info(fs.FileSelector(own)) if f.path.endswith(".zip"))
    return [path] if info.type == fs.FileType.File else []


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address (file, hdfs, s3, gs ...) and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _opened(path: str) -> pa.NativeFile:
    """A file that can be read from any place, wherever it lies."""
    files, own = _filesystem(path)
    return files.open_input_file(own)


class _Members(InputPartition):
    def __init__(self, archive: str, members: list[tuple[int, str]]) -> None:
        super().__init__((archive, members[0][0]))
        self.archive, self.members = archive, members


class _ZipReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.pattern = re.compile(options.get("pattern", ""))
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for path in _paths(self.path):
            try:
                with _opened(path) as raw, zipfile.ZipFile(raw) as archive:
                    infos = [(i, x.filename, x.file_size) for i, x in enumerate(archive.infolist()) if self.pattern.search(x.filename)]
            except (zipfile.BadZipFile, OSError, pa.ArrowInvalid):
                parts.append(_Members(path, [(0, "")]))  # an unreadable archive is one row without a member
                continue
            held: list[tuple[int, str]] = []
            weight = 0
            for position, name, size in infos:
                if held and weight + size > self.size:
                    parts.append(_Members(path, held))
                    held, weight = [], 0
                held.append((position, name))
                weight += size
            if held:
                parts.append(_Members(path, held))
        return parts or [_Members("", [(0, "")])]

    def read(self, partition: _Members) -> Iterator[tuple]:
        if not partition.archive:
            return
        if not partition.members[0][1]:
            yield partition.archive, None, 0, None
            return
        with _opened(partition.archive) as raw, zipfile.ZipFile(raw) as archive:
            for position, name in partition.members:
                try:
                    content = archive.read(name)
                except (zipfile.BadZipFile, OSError, KeyError, NotImplementedError, pa.ArrowInvalid):
                    content = None
                yield partition.archive, name, position, content


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return "archive string, member string, position bigint, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(self.options)


class JsonStream:
    """A JSON document read piece by piece."""

    _MARK = re.compile(r'["{}\[\]]')
    _STRING_END = re.compile(r'(?:[^"\\]|\\.)*"', re.S)

    def __init__(self, source: io.TextIOBase) -> None:
        self.source, self.text, self.at, self.ended = source, "", 0, False
        self.decode = json.JSONDecoder().raw_decode

    def more(self) -> bool:
        """Read on; a larger step each time, so that a large item is not decoded again and again."""
        if self.ended:
            return False
        self.text = self.text[self.at :]
        self.at = 0
        step = self.source.read(max(_CHUNK, len(self.text)))
        self.ended = not step
        self.text += step
        return bool(step)

    def peek(self) -> str:
        while True:
            while self.at < len(self.text) and self.text[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.text):
                return self.text[self.at]
            if not self.more():
                return ""

    def expect(self, sign: str) -> None:
        if self.peek() != sign:
            raise ValueError(f"{sign!r} expected, {self.peek()!r} found")
        self.at += 1

    def value(self) -> object:
        self.peek()
        while True:
            try:
                found, end = self.decode(self.text, self.at)
                if end < len(self.text) or self.ended:
                    self.at = end
                    return found
            except json.JSONDecodeError:
                if self.ended:
                    raise
            self.more()

    def skip(self) -> None:
        """Pass over a value without building it."""
        if self.peek() not in "{[":
            self.value()
            return
        depth = 0
        while True:
            m = self._MARK.search(self.text, self.at)
            if not m:
                self.at = len(self.text)
                if not self.more():
                    raise ValueError("the document breaks off")
                continue
            self.at = m.end()
            if m.group() == '"':
                while not (s := self._STRING_END.match(self.text, self.at)):
                    if not self.more():
                        raise ValueError("the document breaks off")
                self.at = s.end()
            else:
                depth += 1 if m.group() in "{[" else -1
                if depth == 0:
                    return

    def members(self) -> Iterator[str]:
        """Keys of the object ahead; the caller takes or skips each value."""
        self.expect("{")
        if self.peek() == "}":
            self.at += 1
            return
        while True:
            key = self.value()
            self.expect(":")
            yield key
            if self.peek() == ",":
                self.at += 1
                self.peek()
                continue
            self.expect("}")
            return

    def elements(self) -> Iterator[object]:
        self.expect("[")
        if self.peek() == "]":
            self.at += 1
            return
        while True:
            yield self.value()
            if self.peek() == ",":
                self.at += 1
                continue
            self.expect("]")
            return

    def field(self, name: str, pairs: bool) -> Iterator[tuple[str | None, object]]:
        """Items of the array, or pairs of the map, under a top-level key; nothing if it is missing or of another kind."""
        for key in self.members():
            if key != name or self.peek() != ("{" if pairs else "["):
                self.skip()
            elif pairs:
                for k in self.members():
                    yield k, self.value()
            else:
                for v in self.elements():
                    yield None, v


class _ItemsReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def read(self, partition) -> Iterator[tuple]:
        path = self.options["path"]
        pairs = self.options.get("kind", "items") == "pairs"
        tolerant = self.options.get("tolerant", "false") == "true"

        def run(raw) -> Iterator[tuple]:
            stream = JsonStream(io.TextIOWrapper(raw, encoding="utf-8"))
            position = -1
            try:
                for position, (key, value) in enumerate(stream.field(self.options["field"], pairs)):
                    yield position, key, json.dumps(value, ensure_ascii=False)
            except ValueError:
                if not tolerant:
                    raise
                yield position + 1, None, None  # the document breaks off here

        if member := self.options.get("member"):
            with _opened(path) as file, zipfile.ZipFile(file) as archive, archive.open(member) as raw:
                yield from run(raw)
        else:
            with _opened(path) as raw:
                yield from run(raw)


class JsonItems(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_items"

    def schema(self) -> str:
        return "position bigint, key string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _ItemsReader(self.options)

"""Folders of files as a data source that never lists or opens what a query leaves out.

    spark.read.format("tree").option("path", root).option("exclude", "gen,*.tmp").load().where("extension = '.py'")

A partition is a folder (or a group of small ones): the driver lists folders only to `spread` levels, tasks list what is below and read the files'
contents. Folders named in `segments` are not entered. Links are followed; a folder that was met by another name on its own way down is not
entered again, and of several ways to a folder all give files, each under its own path.

Filters that reach the source (spark.sql.python.filterPushdown.enabled): equality, IN, and prefixes of `path`, by which folders are
left out, and of `name`, `extension` and `size`, by which files are before they are opened. Contents are read only for what is left, and not
at all with option `content` false.

Columns: path, name, extension (lower case, with its point, else empty), size, mtime, content (null if it isn't read; undecodable bytes
are replaced). Files and folders that can't be read, or are gone since, have no row. An empty or missing root gives no rows.
"""

from __future__ import annotations

import datetime as dt
import fnmatch
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith

from .files import EXCLUDED_NAMES, EXCLUDED_SEGMENTS

SPREAD, GROUP = 2, 64
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
COMPARED = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


@dataclass
class Folders(InputPartition):
    """(folder, whether what is below it belongs to it) of one task."""

    folders: list


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, name string, extension string, size long, mtime timestamp, content string"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        words = lambda key, default: tuple(w for w in o[key].split(",") if w) if key in o else default
        return _Reader(o["path"].removeprefix("file:").rstrip("/") or "/", words("segments", EXCLUDED_SEGMENTS), words("names", EXCLUDED_NAMES) + words("exclude", ()), o.get("content", "true") == "true", int(o.get("spread", SPREAD)))


class _Reader(DataSourceReader):
    def __init__(self, root: str, segments: tuple, names: tuple, content: bool, spread: int):
        self.root, self.segments, self.names, self.content, self.spread = root, frozenset(s.lower() for s in segments), names, content, spread
        self.equal: dict[str, list[set]] = {}
        self.begins: list[tuple[str, str]] = []
        self.sizes: list[tuple] = []

    def pushFilters(self, filters: list) -> Iterable:
        """What is taken is held exactly; what isn't is given back to Spark."""
        for f in filters:
            column = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if isinstance(f, EqualTo) and column in ("path", "name", "extension"):
                self.equal.setdefault(column, []).append({f.value})
            elif isinstance(f, In) and column in ("path", "name", "extension"):
                self.equal.setdefault(column, []).append(set(f.value))
            elif isinstance(f, StringStartsWith) and column in ("path", "name"):
                self.begins.append((column, f.value))
            elif type(f) in COMPARED and column == "size":
                self.sizes.append((COMPARED[type(f)], f.value))
            elif isinstance(f, IsNotNull) and column in ("path", "name", "extension", "size"):
                continue  # they never are
            else:
                yield f

    def _enters(self, folder: str) -> bool:
        """Can a path below `folder` be asked for?"""
        at = folder.rstrip("/") + "/"
        asked = all(at.startswith(b) or b.startswith(at) for column, b in self.begins if column == "path")
        return asked and all(any(v is not None and v.startswith(at) for v in some) for some in self.equal.get("path", []))

    def _folder_fits(self, name: str) -> bool:
        return name.lower() not in self.segments and not any(fnmatch.fnmatchcase(name, p) for p in self.names)

    def _file_fits(self, path: str, name: str) -> bool:
        values = {"path": path, "name": name, "extension": os.path.splitext(name)[1].lower()}
        if name.lower() in self.segments or any(fnmatch.fnmatchcase(name, p) for p in self.names):
            return False
        return all(values[c] in some for c, every in self.equal.items() for some in every) and all(values[c].startswith(b) for c, b in self.begins)

    def _list(self, folder: str) -> tuple[list[str], list[os.DirEntry]]:
        """Folders to enter and entries of files, by name."""
        below, files = [], []
        try:
            with os.scandir(folder) as entries:
                for e in sorted(entries, key=lambda e: e.name):
                    try:
                        if e.is_dir():
                            if self._folder_fits(e.name) and self._enters(e.path) and not self._looped(e):
                                below.append(e.path)
                        elif e.is_file() and self._file_fits(e.path, e.name):
                            files.append(e)
                    except OSError:
                        continue
        except OSError:
            pass
        return below, files

    def _looped(self, entry: os.DirEntry) -> bool:
        """Does a link lead to a folder that its own way down has come through?"""
        if not entry.is_symlink():
            return False
        target, at = os.path.realpath(entry.path), os.path.dirname(entry.path)
        while len(at) >= len(self.root):
            if os.path.realpath(at) == target:
                return True
            if at == os.path.dirname(at):
                break
            at = os.path.dirname(at)
        return False

    def partitions(self) -> list:
        level, out = ([self.root] if self._enters(self.root) else []), []
        for _ in range(self.spread):
            out += [(f, False) for f in level]
            level = [b for f in level for b in self._list(f)[0]]
        # Folders whose own files alone are meant are small work and go together; each of the last level is walked by a task.
        return [Folders(out[n : n + GROUP]) for n in range(0, len(out), GROUP)] + [Folders([(f, True)]) for f in level] or [Folders([])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        waiting = list(reversed(partition.folders))
        while waiting:
            folder, deep = waiting.pop()
            below, files = self._list(folder)
            if deep:
                waiting += [(b, True) for b in reversed(below)]
            for e in files:
                try:
                    stat = e.stat()
                    if not all(holds(stat.st_size, value) for holds, value in self.sizes):
                        continue
                    text = None
                    if self.content:
                        with open(e.path, "rb") as f:
                            text = f.read().decode("utf-8", "replace")
                except OSError:
                    continue
                yield e.path, e.name, os.path.splitext(e.name)[1].lower(), stat.st_size, dt.datetime.fromtimestamp(stat.st_mtime, dt.UTC), text


def tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = (), content: bool = True, **options: str) -> DataFrame:
    """Files below `root` that a scan may take; `exclude` names more files and folders by patterns. Filters on the result are pushed down."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(Tree)
    read = spark.read.format("tree").option("path", root).option("content", str(content).lower()).option("exclude", ",".join(exclude))
    for key, value in options.items():
        read = read.option(key, value)
    return read.load()

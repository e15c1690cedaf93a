"""One document out of many rows: a data source whose tasks write fragments, which are joined on commit.

    ordered.select("value").write.format("document").option("head", ...).option("joint", ...).option("tail", ...).mode("overwrite").save(path)

Rows are the texts of a document's items, in the order of the partitions and within them. Each task streams its own to a fragment
beside `path`, named by the partition and the attempt, so that a task that runs twice never writes where another does; the
fragments that were committed are joined behind `head`, with `joint` between items, and `tail` ends the document, which takes its name
only when it is whole. What comes to the driver is a name and two numbers for each partition; fragments are joined by the kernel
(copy_file_range: the bytes of shared folders stay with their server), so no text is read into the driver. An aborted write leaves nothing.

`path` lies in a folder that all executors share. Modes: overwrite replaces the document, append goes to an error.

Defined results: null values are no items; no rows give head and tail; a fragment without items adds no joint.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

CHUNK = 1 << 30


@dataclass
class Fragment(WriterCommitMessage):
    part: int
    name: str
    items: int
    size: int


class Document(DataSource):
    """The format `document`: a single column `value string`."""

    @classmethod
    def name(cls) -> str:
        return "document"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite:
            raise ValueError("a document is written whole: use mode('overwrite')")
        if [f.name for f in schema.fields] != ["value"]:
            raise ValueError("a document has one column, value")
        o = self.options
        return _Writer(o["path"].removeprefix("file:"), o.get("head", ""), o.get("joint", ""), o.get("tail", ""))


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, head: str, joint: str, tail: str):
        self.path, self.head, self.joint, self.tail = path, head, joint, tail
        self.folder = os.path.join(os.path.dirname(os.path.abspath(path)), f".{os.path.basename(path)}.{uuid.uuid4().hex}")
        os.makedirs(self.folder)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Fragment:
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{task.partitionId()}-{task.attemptNumber()}-{uuid.uuid4().hex}"
        items = size = 0
        with open(os.path.join(self.folder, name), "wb") as out:
            joint = self.joint.encode()
            for batch in batches:
                values = [v.as_buffer().to_pybytes() for v in batch.column(0).drop_null().cast(pa.binary())]
                if values:
                    size += out.write((joint if items else b"") + joint.join(values))
                    items += len(values)
            out.flush()
            os.fsync(out.fileno())
        return Fragment(task.partitionId(), name, items, size)

    def commit(self, messages: list) -> None:
        whole = os.path.join(self.folder, "whole")
        joint = self.joint.encode()
        with open(whole, "wb", buffering=0) as out:
            out.write(self.head.encode())
            begun = False
            for f in sorted((m for m in messages if m is not None and m.items), key=lambda m: m.part):
                if begun and joint:
                    out.write(joint)
                begun = True
                _append(out, os.path.join(self.folder, f.name), f.size)
            out.write(self.tail.encode())
        os.replace(whole, self.path)
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        for name in os.listdir(self.folder):
            os.unlink(os.path.join(self.folder, name))
        os.rmdir(self.folder)


def _append(out, path: str, size: int) -> None:
    """All of a fragment at the end of `out`, whose place moves with it."""
    if os.path.getsize(path) != size:
        raise OSError(f"fragment {path} isn't whole")
    with open(path, "rb", buffering=0) as part:
        left = size
        try:
            while left:
                done = os.copy_file_range(part.fileno(), out.fileno(), min(left, CHUNK))
                if not done:
                    break
                left -= done
        except OSError:  # between file systems, or one that can't
            pass
        while left and (piece := part.read(min(left, 1 << 20))):
            out.write(piece)
            left -= len(piece)


def write(items: DataFrame, path: str, head: str = "", joint: str = "", tail: str = "") -> None:
    """The column `value` of `items`, in their order, as one document."""
    items.sparkSession.dataSource.register(Document)
    items.select("value").write.format("document").option("head", head).option("joint", joint).option("tail", tail).mode("overwrite").save(path)

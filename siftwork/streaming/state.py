"""Streams with state of their own for each path or document: changed files with a debounce, and findings that come and go.

Both are arbitrary stateful operators: what is known of a key is in the state store, so a stream that is stopped goes on
from its checkpoint, and a key's rows need not come in one batch. Rows of a batch are taken in order of time; how rows are
dealt to batches changes no result. State is of the size of the keys, not of their history.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CHANGES = "path string, first long, last long, n long, hash string"
FEED = "uri string, at long, what string, finding string"
#: Changes of documents with this many lines or more are not scanned.
MOST_LINES = 1000


def _ordered(rows: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """A key's rows by their first two columns, nulls of the second last. Most keys have few rows: plain tuples, as frames cost more than the rows."""
    every = [row for df in rows for row in zip(*(df[c].tolist() for c in columns))]
    return sorted(every, key=lambda r: (r[0], r[1] is None, "" if r[1] is None else r[1]))


class Changes(StatefulProcessor):
    """Of each path: what was last seen, and the changes that wait until it is quiet."""

    def __init__(self, quiet: int):
        self.quiet = quiet  # microseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value for both, as each access asks the store: first, last and n are null while nothing waits.
        self.known = handle.getValueState("known", "mtime long, hash string, first long, last long, n long")

    def _due(self, last: int) -> int:
        """Milliseconds, rounded up, at which a change is quiet for long enough."""
        return -(-(last + self.quiet) // 1000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.known.get()
        seen = known[:2] if known else None
        before = waiting = known[2:] if known and known[2] is not None else None
        out = []
        for mtime, digest in _ordered(rows, ["mtime", "hash"]):
            mtime = int(mtime)
            if seen is not None and mtime <= seen[0]:
                continue  # an older state of the file
            if seen is not None and digest != seen[1]:
                if waiting is not None and mtime - waiting[1] > self.quiet:
                    out.append((key[0], *waiting, seen[1]))
                    waiting = None
                waiting = (waiting[0], mtime, waiting[2] + 1) if waiting is not None else (mtime, mtime, 1)
            seen = (mtime, digest)
        self.known.update((*seen, *(waiting or (None, None, None))))
        if waiting is not None and waiting != before:
            self.handle.registerTimer(self._due(waiting[1]))
        if out:
            yield pd.DataFrame(out, columns=["path", "first", "last", "n", "hash"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        known = self.known.get()
        # A timer that a later change has outrun finds that it isn't due.
        if known and known[2] is not None and self._due(known[3]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.known.update((*known[:2], None, None, None))
            yield pd.DataFrame([(key[0], *known[2:], known[1])], columns=["path", "first", "last", "n", "hash"])

    def close(self) -> None:
        pass


def changes(files: DataFrame, quiet_ms: int, late: str = "1 second") -> DataFrame:
    """Changes of a stream of file states (path, mtime: timestamp, hash): path, first, last, n, hash.

    The first sighting of a path is no change, nor is a later time with the same content, or an older one. Changes that follow each other
    within `quiet_ms` are one row, which is given once the path is quiet for so long, by a timer of event time: from when the first and the last
    of them are, how many, and the content's hash. Rows later than `late` are dropped; null paths are a path.
    """
    rows = files.withColumn("at", F.col("mtime").cast("timestamp")).withWatermark("at", late).select("path", "hash", "at", F.unix_micros("at").alias("mtime"))
    out = rows.groupBy("path").transformWithStateInPandas(Changes(quiet_ms * 1000), CHANGES, "append", "eventTime")
    return out.select("path", F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n", "hash")


class Findings(StatefulProcessor):
    """Of each document: the time of its latest version, and the findings that this has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "at long, seq long, findings string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        at, seq, have = self.now.get() or (None, None, "[]")
        have = set(json.loads(have))
        out = []
        for when, number, op, n_lines, findings in _ordered(rows, ["at", "seq", "op", "n_lines", "findings"]):
            when, number = int(when), int(number)
            if at is not None and (when, number) <= (at, seq) or op == "change" and n_lines >= MOST_LINES:
                continue
            now = set() if op == "close" else set(findings)
            out += [(key[0], when, "removed", f) for f in sorted(have - now)] + [(key[0], when, "added", f) for f in sorted(now - have)]
            at, seq, have = when, number, now
        if at is not None:
            self.now.update((at, seq, json.dumps(sorted(have))))
        if out:
            yield pd.DataFrame(out, columns=["uri", "at", "what", "finding"])

    def close(self) -> None:
        pass


def found_in(patterns: list[dict[str, Any]], text: str = "text") -> Any:
    """The findings of a whole text as an array of `rule:line`, in the JVM, without taking its lines apart into rows."""
    by_line = F.split(F.col(text), "\n")

    def matches(pattern: dict[str, Any]) -> Any:
        named = F.lit(pattern["rule"]["id"] + ":")
        return F.array_compact(F.transform(by_line, lambda line, i: F.when(F.rlike(line, F.lit(pattern["regex"].java)), F.concat(named, (i + 1).cast("string")))))

    return F.concat(*map(matches, patterns)) if patterns else F.array().cast("array<string>")


def feed(versions: DataFrame, patterns: list[dict[str, Any]]) -> DataFrame:
    """From a stream of versions (uri, ts, seq: long, op: open, change or close, text): what each brings or takes away.

    uri, at, what (added or removed), finding. A closed document has no findings; a change with MOST_LINES lines or more is not scanned, so
    that what was known stays; versions that come after a later one are ignored; null texts have no findings.
    """
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    rows = versions.select(
        "uri", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "seq", "op", n_lines.alias("n_lines"), F.coalesce(found_in(patterns), F.array().cast("array<string>")).alias("findings"),
    )
    out = rows.groupBy("uri").transformWithStateInPandas(Findings(), FEED, "append", "none")
    return out.select("uri", F.timestamp_micros("at").alias("at"), "what", "finding")

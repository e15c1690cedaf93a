import random

import pandas as pd
import pytest
from pyspark.sql import functions as F
from siftwork.streaming import state


class Value:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = tuple(value)


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, name, schema):
        return Value()

    def registerTimer(self, at):
        self.timers.add(at)


class Expired:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def bursts(rows, quiet, until):
    """Changes by hand: rows in order of time, the first one and equal contents apart, gathered while gaps are at most `quiet`.

    The last ones wait until time has gone on for so long.
    """
    seen, out = None, []
    for at, digest in sorted(rows):
        if seen is not None and at <= seen[0]:
            continue
        if seen is not None and digest != seen[1]:
            if out and at - out[-1][1] <= quiet:
                out[-1] = (out[-1][0], at, out[-1][2] + 1)
            else:
                out.append((at, at, 1))
        seen = (at, digest)
    return [b for b in out if b[1] + quiet <= until or b is not out[-1]]


@pytest.mark.parametrize("seed", range(30))
def test_changes_do_not_depend_on_batches(seed):
    """One key: rows dealt to batches at random, timers fired as time goes on."""
    rng = random.Random(seed)
    quiet = 5_000
    rows = [(1000 * k + rng.randint(0, 900), rng.choice("abc")) for k in sorted(rng.sample(range(200), 60))]
    one, handle = state.Changes(quiet), Handle()
    one.init(handle)
    got, k = [], 0
    while k < len(rows):
        n = rng.randint(1, 9)
        part = rows[k : k + n]
        k += n
        frame = pd.DataFrame(rng.sample(part, len(part)), columns=["mtime", "hash"])
        for f in one.handleInputRows(("p",), iter([frame]), None):
            got += [tuple(r[1:4]) for r in f.itertuples(index=False)]
        now = part[-1][0] // 1000
        for at in sorted(t for t in handle.timers if t <= now):
            handle.timers.discard(at)
            for f in one.handleExpiredTimer(("p",), None, Expired(at)):
                got += [tuple(r[1:4]) for r in f.itertuples(index=False)]
    assert sorted(got) == bursts(rows, quiet, rows[-1][0] // 1000 * 1000)


def test_findings_come_and_go():
    one = state.Findings()
    one.init(Handle())
    columns = ["at", "seq", "op", "n_lines", "findings"]

    def give(*rows):
        return [tuple(r)[1:] for f in one.handleInputRows(("d",), iter([pd.DataFrame(rows, columns=columns)]), None) for r in f.itertuples(index=False)]

    assert give((5, 1, "open", 3, ["a:1", "b:2"])) == [(5, "added", "a:1"), (5, "added", "b:2")]
    assert give((4, 0, "change", 3, ["z:1"])) == []  # older than what is known
    assert give((7, 3, "change", 3, ["c:1"]), (6, 2, "change", 3, ["b:2"])) == [(6, "removed", "a:1"), (7, "removed", "b:2"), (7, "added", "c:1")]
    assert give((8, 4, "change", state.MOST_LINES, [])) == []  # too long to be scanned
    assert give((9, 5, "close", 1, ["c:1"])) == [(9, "removed", "c:1")]
    assert give((9, 6, "open", state.MOST_LINES, ["d:1"])) == [(9, "added", "d:1")]


def test_large_parts_come_as_more_files(spark, monkeypatch):
    from siftwork.streaming import replay as own

    monkeypatch.setattr(own, "FILE_ROWS", 100)
    rows = spark.range(1200).selectExpr("id", "cast(id % 2 AS int) AS part")
    seen = []

    def through(stream):
        seen.append(stream)
        return stream

    out = own.replay(rows, F.col("part"), 2, through, runs=1)
    assert sorted(r.id for r in out.collect()) == list(range(1200))
    assert len(seen[0].sparkSession.read.parquet(out.inputFiles()[0].rsplit("/", 2)[0] + "/in").inputFiles()) == 2 * 6

"""Large rule packs: an index of what every match must hold, so that a line meets only the patterns it may match.

Of each pattern `factors` reads a set of lower-case strings of which every match holds one. The pack's factors form one
automaton (Aho-Corasick), which passes over a line once, whatever the number of patterns, and names the candidates. These
pairs of a line and a pattern, few against lines times patterns, are joined with the pack and verified in the JVM by the
pattern itself. Patterns without factors, which any line may match, are candidates for every line.

Defined results: a null line has no candidates; an empty pack, or one that doesn't compile, has no matches; equal patterns
are matched each. What is broadcast is the pack, driver-side data: a row for each pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

parser = re._parser  # the standard library's reader of patterns

#: Strings shorter than this tell too little, and alternatives beyond this number are given up.
LEAST, MOST = 3, 64
SPLIT = "path string, line_no int, text string, k int"


def _plain(code: int) -> str:
    return chr(code).lower() if code < 128 else ""


def _strings(items: Any) -> tuple[list[frozenset[str]], frozenset[str] | None]:
    """Of a sequence: sets of strings of which each match holds one, and, if all its matches are known, the set of these."""
    found: list[frozenset[str]] = []
    run: frozenset[str] | None = frozenset([""])
    whole = True
    for op, value in items:
        name, exact, inner = str(op), None, []
        if name == "LITERAL":
            exact = frozenset([_plain(value)]) if value < 128 else None
        elif name == "SUBPATTERN":
            inner, exact = _strings(value[3])
        elif name == "BRANCH":
            arms = [_strings(arm) for arm in value[1]]
            if all(arm[1] is not None for arm in arms):
                exact = frozenset().union(*(arm[1] for arm in arms))
            best = [_best([*arm[0], *([arm[1]] if arm[1] is not None else [])]) for arm in arms]
            if all(best):
                inner = [frozenset().union(*best)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            inner, one = _strings(value[2])
            if one is not None and value[0] == value[1] == 1:
                exact = one
            elif one is not None:
                inner = [*inner, one]
        elif name == "IN" and all(str(o) == "LITERAL" and v < 128 for o, v in value):
            exact = frozenset(_plain(v) for _, v in value)
        elif name == "AT" or name == "ASSERT_NOT":
            exact = frozenset([""])
        found += inner
        if exact is not None and run is not None and len(run) * len(exact) <= MOST:
            run = frozenset(a + b for a in run for b in exact)
            continue
        found += [run] if run else []
        whole = False
        run = exact if exact is not None and len(exact) <= MOST else frozenset([""])
    return [*found, run], run if whole else None


def _best(sets: list[frozenset[str]]) -> frozenset[str] | None:
    """The set whose shortest string is longest; None if that is below LEAST."""
    fit = [s for s in sets if s and min(map(len, s)) >= LEAST]
    return max(fit, key=lambda s: (min(map(len, s)), -len(s))) if fit else None


def factors(source: str) -> frozenset[str] | None:
    """Lower-case ASCII strings of which every match of `source` holds one, in any case; None if none are plain to see."""
    return _best(_strings(parser.parse(source))[0])


def index(patterns: list[dict[str, Any]]) -> tuple[dict[str, list[int]], list[int]]:
    """Numbers of the patterns by factor, and of those that have none."""
    by_factor: dict[str, list[int]] = {}
    rest = []
    for p in patterns:
        own = factors(p["regex"].python)
        for factor in own or ():
            by_factor.setdefault(factor, []).append(p["k"])
        if own is None:
            rest.append(p["k"])
    return by_factor, rest


def candidates(lines: DataFrame, patterns: list[dict[str, Any]]) -> DataFrame:
    """SPLIT: each line with the patterns that it may match and that apply to it."""
    by_factor, rest = index(patterns)
    applies = {p["k"]: (frozenset(p["languages"]), p["in_tests"]) for p in patterns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for factor, ks in by_factor.items():
            machine.add_word(factor, ks)
        machine.make_automaton()
        for batch in batches:
            rows, ks = [], []
            columns = [batch.column(c).to_pylist() for c in ("language", "is_test_file", "text")]
            for row, (language, test, text) in enumerate(zip(*columns)):
                if text is None:
                    continue
                met = set(rest)
                if by_factor:
                    for _, found in machine.iter(text.lower()):
                        met.update(found)
                for k in sorted(met):
                    spoken, in_tests = applies[k]
                    if (not spoken or language in spoken) and (in_tests or not test):
                        rows.append(row)
                        ks.append(k)
            at = pa.array(rows, pa.int64())
            kept = [batch.column(c).take(at) for c in ("path", "line_no", "text")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ks, pa.int32())], names=["path", "line_no", "text", "k"])

    return lines.select("path", "line_no", "text", "language", "is_test_file").mapInArrow(run, SPLIT)


def indexed(lines: DataFrame, patterns: list[dict[str, Any]]) -> DataFrame:
    """First match of each pattern in each line: path, line_no, text, k, start, stop, metavars."""
    spark = lines.sparkSession
    pack = spark.createDataFrame([(p["k"], p["regex"].java, list(p["regex"].groups)) for p in patterns], "k int, java string, named array<struct<name: string, n: int>>")
    met = candidates(lines, patterns).join(F.broadcast(pack), "k").where("text RLIKE java")
    start = F.expr("cast(regexp_instr(text, java) - 1 AS int)")
    size = F.expr("cast(length(regexp_extract(text, java, 0)) AS int)")
    named = F.expr("map_from_entries(transform(named, g -> struct(g.name, regexp_extract(text, java, g.n))))")
    return met.withColumn("start", start).select("path", "line_no", "text", "k", "start", (F.col("start") + size).alias("stop"), named.alias("metavars"))

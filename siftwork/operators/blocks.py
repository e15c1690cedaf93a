"""Regions of lines: dead code, commented-out code, and branches with their ends."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, has_any
from . import ranges

# What makes a branch sanitizing, and what ends a path.
CLEANING = ("sanitize", "validate", "escape", "encode", "purify", "clean")
LEAVING = ("return", "throw", "continue", "break")

STARTS = r"^\s*if\s*\("


def braces(text: Column) -> Column:
    """Opening less closing braces."""
    size = lambda mark: F.length(F.replace(text, F.lit(mark), F.lit("")))
    return size("}") - size("{")


def commented_code(lines: DataFrame) -> DataFrame:
    """path, start, end of runs of two or more comment lines that look like code: gaps and islands."""
    looks = F.col("text").rlike(r"^\s*(//|#)\s*[a-zA-Z_][a-zA-Z0-9_]*\s*[=(.]")
    rows = lines.where(looks).withColumn("island", F.col("line_no") - F.row_number().over(Window.partitionBy("path").orderBy("line_no")))
    return rows.groupBy("path", "island").agg(F.min("line_no").alias("start"), F.max("line_no").alias("end")).where("end > start").select("path", "start", "end")


def unreachable(files: DataFrame) -> DataFrame:
    """path, start, end of lines after a statement that leaves a block, up to the brace that closes it.

    A fold over the lines of a file, as the depth restarts with each region; it stays in the JVM.
    """
    state = "struct<depth:int,open:boolean,start:int,nr:int,found:array<struct<start:int,end:int>>>"

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + braces(x).cast("int")
        t = F.trim(x)
        leaves = x.rlike(r"^\s*(return|break|continue|throw|goto)\b") & ~t.endswith("...") & ~s["open"] & (depth > 0)
        opened = s["open"] | leaves
        start = F.when(leaves, s["nr"] + 2).otherwise(s["start"])
        closes = (t == "}") & opened & (depth <= 0)
        found = F.when(closes & (s["nr"] >= start), F.concat(s["found"], F.array(F.struct(start.cast("int").alias("start"), s["nr"].alias("end"))))).otherwise(s["found"])
        return F.struct(
            F.when(closes, F.lit(0)).otherwise(depth).cast("int").alias("depth"), (opened & ~closes).alias("open"), start.cast("int").alias("start"), (s["nr"] + 1).cast("int").alias("nr"), found.alias("found")
        )

    zero = F.expr(f"cast(named_struct('depth', 0, 'open', false, 'start', 0, 'nr', 0, 'found', array()) AS {state})")
    return files.select("path", F.explode(F.aggregate(F.split("content", "\n"), zero, step, lambda s: s["found"])).alias("r")).select("path", "r.start", "r.end")


def dead(files: DataFrame, lines: DataFrame) -> DataFrame:
    return unreachable(files).withColumn("kind", F.lit("unreachable")).unionByName(commented_code(lines).withColumn("kind", F.lit("commented")))


def in_dead_code(findings: DataFrame, regions: DataFrame) -> DataFrame:
    """Findings in a dead region: a semi-join by file and blocks of lines, see `ranges`."""
    r = regions.select(F.col("path").alias("_path"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    return ranges.split(findings, r, ("file", "_path"), "line", "_start", "_end", [], None, "left_semi")


def tree(lines: DataFrame) -> DataFrame:
    """path, start, end, parent, nesting of every `if (` of each file: one ordered pass over a file's lines with a stack.

    A block ends at the first later line whose depth of braces is at or below that before it, or with the file. An open block whose
    depth is reached or passed by a line ends there; the others stay on the stack, so each line is looked at once, and what is kept
    of a file is its open and closed blocks. `parent` is the start of the innermost block that is open at a block's start, null for
    the outermost; `nesting` is how many are. A block that begins on the line that ends another isn't inside it. Null texts are
    empty lines; a file without an `if` gives no row.
    """
    depth = F.sum(braces(F.col("text"))).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    opens = F.coalesce(F.col("text").rlike(STARTS), F.lit(False))
    rows = lines.withColumn("text", F.coalesce("text", F.lit(""))).select("path", "line_no", depth.alias("depth"), (depth - braces(F.col("text"))).alias("before"), opens.alias("opens"))
    # After a line that opens nothing, one that isn't less deep ends nothing: the line before has ended all that it could.
    per_file = Window.partitionBy("path").orderBy("line_no")
    last = rows.groupBy("path").agg(F.max("line_no").alias("_last"))
    idle = (F.col("depth") >= F.lag("depth").over(per_file)) & ~F.lag("opens").over(per_file)
    matter = rows.withColumn("_idle", F.coalesce(idle, F.lit(False))).where("opens OR NOT _idle").drop("_idle")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stack, seen = None, [], False
        out: list[tuple] = []

        def close(name: str, end: int | None, level: float) -> None:
            while stack and stack[-1][1] >= level:
                start, _, parent, nesting = stack.pop()
                out.append((name, start, end, parent, nesting))

        for batch in batches:
            for name, nr, deep, before, opening in zip(*(batch.column(c).to_pylist() for c in ("path", "line_no", "depth", "before", "opens"))):
                if not seen or name != path:
                    close(path, None, float("-inf"))
                    path, seen = name, True
                close(name, nr, deep)
                if opening:
                    stack.append((nr, before, stack[-1][0] if stack else None, len(stack)))
            yield _blocks(out)
            out.clear()
        close(path, None, float("-inf"))
        yield _blocks(out)

    ordered = matter.repartition("path").sortWithinPartitions("path", "line_no")
    found = ordered.mapInArrow(walk, "path string, start int, end int, parent int, nesting int")
    return found.join(last, "path").select("path", "start", F.coalesce("end", "_last").alias("end"), "parent", "nesting")


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "start", "end", "parent", "nesting"])


def branches(lines: DataFrame) -> DataFrame:
    """path, start, end, condition, has_else, sanitizes of every `if (`.

    Ends come from `tree`. Lines that say something (an else, a cleaning or leaving word) meet the branches around them by
    blocks of lines (`ranges`), so that what is made is in proportion to what is inside of what.
    """
    found = tree(lines).select("path", "start", "end")
    named = lines.select(F.col("path").alias("_file"), F.col("line_no").alias("_nr"), F.trim("text").alias("condition"))
    found = found.join(named, (F.col("path") == F.col("_file")) & (F.col("start") == F.col("_nr"))).select("path", "start", "end", "condition")
    t, low = F.trim("text"), F.lower("text")
    says = lines.select(F.col("path").alias("_path"), "line_no", any_of([t.startswith("else"), t.startswith("} else")]).alias("_else"), has_any(low, CLEANING + LEAVING).alias("_clean")).where("_else OR _clean")
    inside = ranges.met(says, found.select("path", "start", "end"), ("_path", "path"), "line_no", "start", "end")
    said = inside.groupBy("path", "start").agg(F.max("_else").alias("_has_else"), F.max("_clean").alias("_sanitizes"))
    out = found.join(said, ["path", "start"], "left")
    no = F.lit(False)
    return out.select("path", "start", "end", "condition", F.coalesce("_has_else", no).alias("has_else"), F.coalesce("_sanitizes", no).alias("sanitizes"))


def sanitized_paths(lines: DataFrame) -> DataFrame:
    """Files with a sanitizing branch."""
    return branches(lines).groupBy("path").agg(F.max("sanitizes").alias("has_sanitized_path"))

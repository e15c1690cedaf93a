"""Fixes of findings: applied to files, validated, turned into patches, and read from a model's answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of

# What a fix must no longer contain, by category, and what it must not switch off.
DANGEROUS = {
    "sqli": ("execute(f", '" + ', "' + ", "${"), "xss": ("innerHTML", "dangerouslySetInnerHTML", "document.write"), "cmdi": ("shell=True", "os.system", "exec("),
    "pathtraversal": ("../",), "crypto": ("md5", "sha1", "DES"), "secrets": ("password =", "api_key ="),
}
DISABLING = ("verify=False", "rejectUnauthorized: false", "InsecureSkipVerify: true", "csrf_exempt", "eslint-disable", "nosec", "@SuppressWarnings")


def apply(files: DataFrame, findings: DataFrame) -> DataFrame:
    """path, content, changed of files with fixes applied to the findings' lines; one fix for each line, by column.

    Fixes are joined to lines; a file is put together again from its own lines only, in order.
    """
    fix = findings.where("fix_available").groupBy(F.col("file").alias("path"), (F.col("line") - 1).alias("pos")).agg(F.min_by("fix", F.struct("column", "rule_id")).alias("fix"))
    touched = files.join(fix.select("path").distinct(), "path", "left_semi")
    lines = touched.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text")).join(fix, ["path", "pos"], "left")
    text = F.when(F.col("fix").isNotNull(), F.regexp_replace("text", F.col("fix.pattern"), F.regexp_replace(F.col("fix.replace"), r"\\(\d)", r"\$$1"))).otherwise(F.col("text"))
    done = lines.withColumn("new", text)
    out = done.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("pos", "new"))).alias("ls"), F.count_if(F.col("new") != F.col("text")).alias("changed"))
    return out.select("path", F.array_join(F.transform("ls", lambda x: x["new"]), "\n").alias("content"), "changed")


def _balance(text: Column, opening: str, closing: str) -> Column:
    """Depth at the end, or -1 as soon as more is closed than was open: a fold over the brackets alone."""
    marks = F.split(F.regexp_replace(text, rf"[^\{opening}\{closing}]", ""), "")
    return F.aggregate(F.filter(marks, lambda c: c != ""), F.lit(0), lambda d, c: F.when(d < 0, F.lit(-1)).otherwise(d + F.when(c == opening, 1).otherwise(-1)))


def validate(pairs: DataFrame) -> DataFrame:
    """`pairs` (category, original, fixed) with six checks, issues and is_valid."""
    fixed, original = F.col("fixed"), F.col("original")
    gone = F.lit(True)
    for category, words in DANGEROUS.items():
        gone = F.when(F.col("category") == category, ~any_of([fixed.contains(w) for w in words])).otherwise(gone)
    calls = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\w+)\s*\("), F.lit(1)))
    kept = (F.size(calls(original)) == 0) | F.arrays_overlap(calls(original), calls(fixed))
    balanced = F.lit(True)
    for a, b in ("()", "[]", "{}"):
        balanced = balanced & (_balance(fixed, a, b) == 0)
    checks = {
        "not_empty": F.trim(fixed) != "", "differs": F.trim(fixed) != F.trim(original), "balanced": balanced, "danger_gone": gone,
        "nothing_disabled": ~any_of([fixed.contains(w) & ~original.contains(w) for w in DISABLING]), "calls_kept": kept,
    }
    out = pairs.withColumns(checks)
    issues = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c)) for c in checks]))
    return out.withColumn("issues", issues).withColumn("is_valid", F.size("issues") == 0)


def patches(edits: DataFrame) -> DataFrame:
    """`edits` (path, content, start, end, replacement: lines start to end, from 1) with new_content and a unified hunk."""
    lines, new = F.split("content", "\n"), F.split("replacement", "\n")
    before = F.slice(lines, F.lit(1), F.greatest(F.col("start") - 1, F.lit(0)))
    old = F.slice(lines, F.col("start"), F.col("end") - F.col("start") + 1)
    after = F.slice(lines, F.col("end") + 1, F.greatest(F.size(lines) - F.col("end"), F.lit(0)))
    head = F.format_string("--- a/%s\n+++ b/%s\n@@ -%d,%d +%d,%d @@\n", F.col("path"), F.col("path"), F.col("start"), F.size(old), F.col("start"), F.size(new))
    mark = lambda sign, a: F.transform(a, lambda x: F.concat(F.lit(sign), x))
    return edits.withColumns({
        "new_content": F.array_join(F.concat(before, new, after), "\n"), "diff": F.concat(head, F.array_join(F.concat(mark("-", old), mark("+", new)), "\n")),
        "applies": (F.col("start") >= 1) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.size(lines)),
    })


def answers(replies: DataFrame) -> DataFrame:
    """`replies` (reply) with code (the first fenced block), explanation and confidence (0.9 high, 0.3 low, else 0.7)."""
    low = F.lower("reply")
    code = F.regexp_extract("reply", r"(?s)```\w*\n(.*?)```", 1)
    said = F.regexp_extract("reply", r"(?im)^explanation:\s*(.*)$", 1)
    sure = F.regexp_extract(low, r"confidence:\s*(\w+)", 1)
    return replies.withColumns({"code": F.regexp_replace(code, r"\n$", ""), "explanation": F.trim(said), "confidence": F.when(sure == "high", 0.9).when(sure == "low", 0.3).otherwise(0.7)})


def batch_answers(replies: DataFrame) -> DataFrame:
    """Rows of the JSON document in each reply, fenced or not: id, fixed_code, explanation."""
    body = F.regexp_replace(F.trim("reply"), r"(?s)^```\w*\n|```$", "")
    fixes = F.from_json(body, "fixes array<struct<id:string,fixed_code:string,explanation:string>>")
    return replies.select(F.explode(fixes["fixes"]).alias("f")).select("f.*")


def cache_key(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def prompts(findings: DataFrame) -> DataFrame:
    """rule_id, file, line, prompt: what a model would be asked. Nothing is sent anywhere."""
    hint = {"sqli": "Use bound parameters.", "xss": "Encode output for its context.", "cmdi": "Pass arguments as a list, without a shell.", "secrets": "Read the value from a secret store."}
    advice = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in hint.items() for x in kv]), F.col("category")), F.lit("Keep the behaviour."))
    text = F.format_string("Fix this finding.\nRule: %s\nMessage: %s\nFile: %s, line %d\nCode:\n%s\n%s\nAnswer with one code block.", "rule_id", "message", "file", "line", "snippet", advice)
    return findings.select("rule_id", "file", "line", text.alias("prompt"))

"""Findings as reports: JSON, SARIF, GitLab's format, HTML, text, diagnostics, and ignore files.

A report is a `Document`: its items are rendered by columns, most severe first, and written by the executors through `sink`; only head
and tail (counts, rules) are made on the driver. `text` and the functions that return one are for consoles.
"""

from __future__ import annotations

import html
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import severity_rank
from ..schemas import SEVERITIES
from . import sink
from .refine import ordered, summary, taxonomy

# Names of weaknesses.
CWE_NAMES = {
    "CWE-20": "Improper Input Validation", "CWE-22": "Path Traversal", "CWE-77": "Command Injection", "CWE-78": "OS Command Injection", "CWE-79": "Cross-site Scripting",
    "CWE-89": "SQL Injection", "CWE-90": "LDAP Injection", "CWE-94": "Code Injection", "CWE-95": "Eval Injection", "CWE-200": "Information Exposure", "CWE-259": "Hard-coded Password",
    "CWE-287": "Improper Authentication", "CWE-295": "Improper Certificate Validation", "CWE-306": "Missing Authentication", "CWE-312": "Cleartext Storage", "CWE-319": "Cleartext Transmission",
    "CWE-326": "Inadequate Encryption Strength", "CWE-327": "Broken Cryptographic Algorithm", "CWE-330": "Insufficiently Random Values", "CWE-352": "Cross-Site Request Forgery",
    "CWE-359": "Exposure of Personal Information", "CWE-434": "Unrestricted Upload", "CWE-489": "Active Debug Code", "CWE-502": "Deserialization of Untrusted Data", "CWE-601": "Open Redirect",
    "CWE-611": "XML External Entity", "CWE-798": "Hard-coded Credentials", "CWE-918": "Server-Side Request Forgery",
}


def level(severity: Column | str) -> Column:
    """SARIF's level of a severity."""
    s = F.col(severity) if isinstance(severity, str) else severity
    return F.when(s.isin("critical", "high"), "error").when(s == "medium", "warning").otherwise("note")


def diagnostic(severity: Column | str) -> Column:
    """An editor's severity: error 1, warning 2, information 3, hint 4."""
    s = F.col(severity) if isinstance(severity, str) else severity
    return F.when(s.isin("critical", "high"), 1).when(s == "medium", 2).when(s == "low", 3).otherwise(4)


def cwe_name(cwe: Column | str) -> Column:
    c = F.col(cwe) if isinstance(cwe, str) else cwe
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CWE_NAMES.items() for x in kv]), c), c)


def sarif_results(findings: DataFrame) -> DataFrame:
    """One result object for each finding, as JSON."""
    place = F.struct(F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level("severity").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("rule_id", "file", "line", "column", F.to_json(result).alias("result"))


@dataclass
class Document:
    """A report as a document: what it begins with, its items in order (column `value`), what stands between them, how it ends.

    Head and tail hold what is known of the findings as a whole: counts, and the rules and weaknesses that occur, whose number is the pack's.
    """

    head: str
    items: DataFrame
    joint: str
    tail: str

    def text(self) -> str:
        """The document on the driver, for a console: an item at a time."""
        return self.head + self.joint.join(r["value"] for r in self.items.toLocalIterator() if r["value"] is not None) + self.tail

    def write(self, path: str) -> None:
        """The document as a file in a folder that executors share; they write it, see `sink`."""
        sink.write(self.items, path, self.head, self.joint, self.tail)


def _most_severe(findings: DataFrame, limit: int | None) -> DataFrame:
    rows = ordered(findings)
    return rows.limit(limit) if limit else rows


def sarif_document(findings: DataFrame, tool: str = "siftwork", limit: int | None = None) -> Document:
    """A SARIF 2.1.0 log with its rules and the weaknesses that they name; a result is a line."""
    rules = taxonomy(findings).withColumn("cwe_name", cwe_name("cwe")).orderBy("rule_id").collect()
    taxa = sorted({(r["cwe"], r["cwe_name"]) for r in rules if r["cwe"]})
    driver = {"name": tool, "rules": [{"id": r["rule_id"], "name": r["rule_name"], "shortDescription": {"text": r["message"]}, "properties": {"severity": r["severity"], "cwe": r["cwe"]}} for r in rules]}
    more = {"tool": {"driver": driver}, "taxonomies": [{"name": "CWE", "taxa": [{"id": a, "name": b} for a, b in taxa]}]}
    head = '{"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [' + json.dumps(more)[:-1] + ', "results": [\n'
    return Document(head, sarif_results(_most_severe(findings, limit)).select(F.col("result").alias("value")), ",\n", "\n]}]}\n")


def gitlab_rows(findings: DataFrame) -> DataFrame:
    """One vulnerability object for each finding, as JSON."""
    number = F.substring("cwe", 5, 10)
    cwe = F.struct(F.lit("cwe").alias("type"), F.col("cwe").alias("name"), number.alias("value"), F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), number, F.lit(".html")).alias("url"))
    rule = F.struct(F.lit("rule").alias("type"), F.col("rule_id").alias("name"), F.col("rule_id").alias("value"), F.lit(None).cast("string").alias("url"))
    known = F.when(F.coalesce("cwe", F.lit("")) != "", F.array(rule, cwe)).otherwise(F.array(rule))
    row = F.struct(
        F.sha2(F.concat_ws(":", "rule_id", "file", "line", "column"), 256).alias("id"), F.lit("sast").alias("category"), F.col("rule_name").alias("name"), "message",
        F.initcap("severity").alias("severity"), F.struct("file", F.col("line").alias("start_line")).alias("location"), known.alias("identifiers"),
    )
    return findings.select("rule_id", "file", "line", "column", F.to_json(row).alias("vulnerability"))


def gitlab_document(findings: DataFrame, limit: int | None = None) -> Document:
    return Document('{"version": "15.0.0", "vulnerabilities": [\n', gitlab_rows(_most_severe(findings, limit)).select(F.col("vulnerability").alias("value")), ",\n", "\n]}\n")


def json_document(findings: DataFrame, limit: int | None = None) -> Document:
    """All columns of findings, nulls included, and their summary."""
    whole = F.to_json(F.struct(*findings.columns), {"ignoreNullFields": "false"})
    head = '{"summary": ' + json.dumps(summary(findings).first().asDict()) + ', "findings": [\n'
    return Document(head, _most_severe(findings, limit).select(whole.alias("value")), ",\n", "\n]}\n")


def text_summary(findings: DataFrame) -> str:
    s = summary(findings).first()
    return "\n".join([f"{s['total']} findings", *[f"{x:>9}: {s[x]}" for x in SEVERITIES]])


def pretty_document(findings: DataFrame, limit: int | None = None, code: bool = True) -> Document:
    """Findings as text, the first of each severity below its name; up to three lines of code each."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    row = F.concat(F.lit("  "), text("file"), F.lit(":"), text("line"), F.lit(":"), text("column"), F.lit("  "), text("rule_id"), F.lit("  "), text("message"))
    shown = F.transform(F.slice(F.split(text("snippet"), "\n"), 1, 3), lambda x: F.concat(F.lit("\n      "), x))
    row = F.concat(row, F.array_join(shown, "")) if code else row
    # The first of each severity is told by its place: one row for each severity.
    place = [text("file"), F.coalesce(F.col("line"), F.lit(-1)), F.coalesce(F.col("column"), F.lit(-1)), text("rule_id"), text("message"), text("snippet")]
    key = F.xxhash64("severity", *place)
    first = findings.groupBy("severity").agg(F.min_by(key, F.struct(*[p.alias(f"p{n}") for n, p in enumerate(place)])).alias("k")).collect()
    titled = F.lit("")
    for r in first:
        titled = F.when(F.col("severity").eqNullSafe(F.lit(r["severity"])) & (key == r["k"]), F.lit(f"\n{str(r['severity']).upper()}\n")).otherwise(titled)
    rows = findings.orderBy(severity_rank("severity").desc(), "severity", *place)
    return Document(text_summary(findings) + "\n", (rows.limit(limit) if limit else rows).select(F.concat(titled, row).alias("value")), "\n", "")


def _escaped(c: Column) -> Column:
    out = F.coalesce(c.cast("string"), F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def html_document(findings: DataFrame, vulnerabilities: DataFrame | None = None, limit: int | None = None) -> Document:
    e = lambda x: html.escape(str(x))
    cells = [x for c in ("severity", "rule_id", "file", "line", "message", "snippet") for x in (F.lit("<td>"), _escaped(F.col(c)), F.lit("</td>"))]
    known = vulnerabilities.limit(5).collect() if vulnerabilities is not None else []
    listed = "".join(f"<li>{e(v['id'])} {e(v['package'])}: {e(v['summary'])}</li>" for v in known)
    head = f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Findings</title></head><body><pre>{e(text_summary(findings))}</pre><table>\n"
    rows = _most_severe(findings, limit).select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("value"))
    return Document(head, rows, "\n", f"\n</table><ul>{listed}</ul></body></html>\n")


def summary_document(findings: DataFrame, limit: int | None = None) -> Document:
    nothing = findings.sparkSession.createDataFrame([], "value string")
    return Document(text_summary(findings), nothing, "", "")


def sarif(findings: DataFrame, tool: str = "siftwork", limit: int | None = None) -> str:
    return sarif_document(findings, tool, limit).text()


def gitlab(findings: DataFrame) -> str:
    return gitlab_document(findings).text()


def as_json(findings: DataFrame) -> str:
    return json_document(findings).text()


def pretty(findings: DataFrame, limit: int | None = None, code: bool = True) -> str:
    return pretty_document(findings, limit, code).text()


def as_html(findings: DataFrame, vulnerabilities: DataFrame | None = None, limit: int | None = None) -> str:
    return html_document(findings, vulnerabilities, limit).text()


FORMATS = {"json": json_document, "sarif": sarif_document, "gitlab": gitlab_document, "html": html_document, "summary": summary_document, "pretty": pretty_document}


def write_report(findings: DataFrame, kind: str, path: str | None = None) -> str:
    """A report in one of FORMATS, `pretty` for others: written to `path` by the executors, whose name is returned, or as a text."""
    document = FORMATS.get(kind, pretty_document)(findings)
    if path is None:
        return document.text()
    document.write(path)
    return path


def ignore_lines(findings: DataFrame) -> DataFrame:
    """Lines of an ignore file."""
    return findings.select(F.format_string("%s:%d:%s -- Ignore %s: %s", "file", "line", "rule_id", "rule_name", "message").alias("value"))


def diagnostics(findings: DataFrame) -> DataFrame:
    """file, line, start, end (0-based), severity, code, message: an editor's view of findings (with `lines`).

    A range is the snippet's place, else its first line's, else twenty characters from the column.
    """
    own = F.coalesce(F.get("lines", F.col("line") - 1), F.lit(""))
    head = F.trim(F.substring_index("snippet", "\n", 1))
    at = F.call_function("instr", own, F.col("snippet"))
    first = F.call_function("instr", own, head)
    start = F.when((F.col("snippet") != "") & (at > 0), at - 1).when((head != "") & (first > 0), first - 1).otherwise(F.greatest(F.col("column") - 1, F.lit(0)))
    end = F.when((F.col("snippet") != "") & (at > 0), at - 1 + F.length("snippet")).when((head != "") & (first > 0), first - 1 + F.length(head)).otherwise(start + 20)
    return findings.select("file", (F.col("line") - 1).alias("line"), start.alias("start"), end.alias("end"), diagnostic("severity").alias("severity"), F.col("rule_id").alias("code"), "message")


def grouped_markdown(findings: DataFrame, by: str = "severity") -> DataFrame:
    """key, text: findings of each severity or category as a list; for small relations, as a group is one text."""
    row = F.format_string("- %s:%d %s: %s", "file", "line", "rule_id", "message")
    return findings.groupBy(F.col(by).alias("key")).agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("text"))


def shortened(path: Column, root: str) -> Column:
    return F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, F.lit(len(root.rstrip("/")) + 2), F.length(path))).otherwise(path)



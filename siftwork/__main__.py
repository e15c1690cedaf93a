"""Command line: scan, ci, secrets, rules, frameworks and watch over a folder."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import compare, frameworks, gates, refine, reports, secrets
from .plans import scan
from .sources import files as source
from .sources import rules as catalog
from .streaming import watch


def session() -> SparkSession:
    spark = SparkSession.builder.appName("siftwork").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siftwork")
    p.add_argument("command", choices=["scan", "ci", "secrets", "rules", "frameworks", "watch"])
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--rules", action="append", help="folder of rules; the own pack without")
    p.add_argument("--config", default=".siftwork.yaml")
    p.add_argument("--format", choices=sorted(reports.FORMATS))
    p.add_argument("--output")
    p.add_argument("--min-severity")
    p.add_argument("--confidence")
    p.add_argument("--exclude", action="append")
    p.add_argument("--secrets", action="store_true")
    p.add_argument("--staged", action="store_true")
    p.add_argument("--baseline")
    p.add_argument("--update-baseline", action="store_true")
    p.add_argument("--policy")
    p.add_argument("--no-ignore-comments", action="store_true")
    p.add_argument("--fail-on", default="low")
    p.add_argument("--search")
    return p


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = session()
    rules = catalog.load(*(a.rules or ()))
    settings = gates.load_settings(a.config)
    if a.command == "rules":
        known = catalog.catalog(spark, rules)
        known = catalog.search(known, a.search) if a.search else known
        for r in known.orderBy("id").toLocalIterator():
            print(f"{r['id']:24} {r['severity']:9} {r['category']:16} {r['name']}")
        for rule, wrong in catalog.violations(rules):
            print(f"{rule}: {wrong}", file=sys.stderr)
        return 0
    files = source.read_files(spark, a.path)
    files = source.staged(files, a.path) if a.staged else files
    if a.command == "frameworks":
        print(frameworks.formatted(frameworks.detect(files)).first()[0])
        return 0
    if a.command == "watch":
        seen = lambda df, _: print(reports.pretty(df))
        watch.watch(watch.changed_files(spark, a.path), rules, seen, os.path.join(a.path, f".siftwork-{int(time.time())}"), every="1 second").awaitTermination()
        return 0
    if a.command == "secrets":
        found = secrets.as_findings(secrets.detect(source.lines(files.where(secrets.takes(F.col("path"))))))
        print(found.count())
        return int(not found.isEmpty())
    if a.command == "ci":
        found, code = scan.ci(files, rules, a.fail_on, tuple(a.exclude or settings.exclude))
        print(reports.write_report(found, a.format or "sarif", a.output))
        return code
    seen = tuple(r["name"] for r in frameworks.detect(files).select("name").distinct().collect())
    config = scan.Config(a.min_severity or settings.min_severity, a.confidence or settings.confidence, (*settings.frameworks, *seen), tuple(a.exclude or settings.exclude), not (a.no_ignore_comments or settings.no_ignore_comments), a.secrets)
    baseline = compare.load(spark, a.baseline) if a.baseline and not a.update_baseline else None
    result = scan.scan(files, rules, config, baseline)
    found = result.findings.cache()
    print(reports.write_report(found, a.format or settings.format, a.output))
    if a.baseline and a.update_baseline:
        compare.save(compare.records(found), a.baseline)
    policy = gates.load_policy(a.policy) if a.policy else None
    counted = result.new if result.new is not None else found
    return gates.exit_code(gates.policy_violations(found, policy, result.new), refine.dedup(counted))


if __name__ == "__main__":
    sys.exit(main())

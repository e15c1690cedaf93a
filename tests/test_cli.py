import json
import tempfile
from pathlib import Path

import pytest
from siftwork.__main__ import main
from siftwork.operators import compare, dependencies
from siftwork.plans import scan
from siftwork.sources import files as source


@pytest.fixture
def folder():
    # The folder's name must not look like a test's.
    at = Path(tempfile.mkdtemp(prefix="project"))
    (at / "src").mkdir()
    (at / "src" / "a.py").write_text("import os\nos.system('x' + y)\n")
    (at / "requirements.txt").write_text("flask==2.0\n")
    return at


def test_scan_and_baseline(spark, folder, capsys):
    base = str(folder / "base")
    assert main(["scan", str(folder), "--format", "json", "--baseline", base, "--update-baseline"]) == 1
    assert json.loads(capsys.readouterr().out)["summary"]["critical"] == 1
    assert main(["scan", str(folder), "--format", "summary", "--baseline", base]) == 0
    (folder / "policy.yaml").write_text("max_findings: {critical: 0}\n")
    assert main(["scan", str(folder), "--policy", str(folder / "policy.yaml")]) == 2
    assert main(["ci", str(folder), "--fail-on", "critical"]) == 1
    capsys.readouterr()
    assert main(["frameworks", str(folder)]) == 0 and "flask" in capsys.readouterr().out
    assert main(["rules", "--search", "shell"]) == 0 and "py-shell" in capsys.readouterr().out


def test_records_round_trip(spark, tmp_path):
    found = scan.scan(source.from_strings(spark, {"a.js": "eval(x)\n"})).findings
    at = str(tmp_path / "b")
    assert compare.load(spark, at).count() == 0
    compare.save(compare.records(found), at)
    assert compare.new(found, compare.load(spark, at)).count() == 0 and compare.known(found, compare.load(spark, at)).count() == 1
    record = compare.records(found).first().asDict()
    (tmp_path / "one.json").write_text(json.dumps({"created": "now", "findings": [record]}))
    assert compare.load_document(spark, str(tmp_path / "one.json")).first().asDict() == record
    assert compare.delete(spark, at) and not compare.exists(spark, at)


def test_advisories(spark):
    files = source.from_strings(spark, {"package.json": '{"dependencies": {"left": "^1.2.10", "right": "2.0"}}', "requirements.txt": "Flask==2.0.1\n", "go.mod": "require (\n  a.b/c v1.9.0\n)"})
    rows = [("npm", "left", "A1", "s", "high", "1.2.9", "1.3", []), ("npm", "right", "A2", "s", "low", None, "2.0", []), ("pypi", "flask", "A3", "s", "low", None, None, []), ("go", "a.b/c", "A4", "s", "low", "1.10", None, [])]
    advisories = spark.createDataFrame(rows, "ecosystem string, package string, id string, summary string, severity string, introduced string, fixed_version string, references array<string>")
    assert sorted(r.id for r in dependencies.vulnerable(dependencies.packages(files), advisories).collect()) == ["A1", "A3"]

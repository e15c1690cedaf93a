import json
import tempfile
from pathlib import Path

import pytest
from siftwork.operators import fixes, gates, reports, syntax, taint
from siftwork.plans import scan
from siftwork.sources import files as source
from siftwork.sources import rules as catalog
from siftwork.streaming import watch


@pytest.mark.parametrize(
    ("language", "code", "query", "hits"),
    [
        ("python", "eval(x)\nf(eval(y))", '(call function: (identifier) @f (#eq? @f "eval")) @v', ["eval(x)", "eval(y)"]),
        ("python", "os.system(c)", "(call function: (attribute object: (identifier) @o attribute: (identifier) @a)) @v", ["os.system(c)"]),
        ("python", "a = 1\nb = g(a)", "(assignment left: (_) @l right: (call)) @v", ["b = g(a)"]),
        ("javascript", "el.innerHTML = x;\nel.id = y", '(assignment_expression left: (member_expression property: (property_identifier) @p) (#eq? @p "innerHTML")) @v', ["el.innerHTML = x"]),
        ("javascript", "eval(a); run(b)", '(call_expression function: (identifier) @f (#match? @f "^ev")) @v', ["eval(a)"]),
        ("go", 'x := exec.Command("ls", y)', "(call_expression function: (selector_expression) @s arguments: (argument_list)) @v", ['exec.Command("ls", y)']),
        ("java", "class A { void f() { st.executeQuery(q); } }", "(method_invocation) @v", ["st.executeQuery(q)"]),
        ("python", "f(1, 2)", "(call arguments: (argument_list . (integer) @first)) @v", ["f(1, 2)"]),
    ],
)
def test_queries(language, code, query, hits):
    raw = code.encode()
    found = syntax.run_query(syntax.compile_query(query), syntax.parse(code, language), raw)
    assert [syntax.text_of(syntax.primary({k: v for k, v in f.items() if k == "v"}), raw) for f in found] == hits


def test_bad_queries_and_sources():
    for bad in ("", "(", "(a", "(#foo? @a b)", "%"):
        with pytest.raises(ValueError):
            syntax.compile_query(bad)
    assert syntax.parse("def (", "python") is None and syntax.parse("x", "cobol") is None
    for code in ("((((", "}}}}", "a.b.c(", "`${", "'", "/*", "x = = =", "function", "😀(é)"):
        for language in ("javascript", "go", "java"):
            assert syntax.parse(code, language) is not None


@pytest.mark.parametrize(
    ("language", "code", "lines"),
    [
        ("javascript", "const a = req.body.x;\ndb.query('select ' + a);", [2]),
        ("javascript", "const a = escape(req.body.x);\ndb.query(a);", []),
        ("javascript", "db.query('select 1', req.body.x);", []),
        ("javascript", "const a = req.query.x;\nconst b = `v ${a}`;\neval(b);", [3]),
        ("javascript", "function go(v) { eval(v); }\ngo(req.params.id);", [2]),
        ("javascript", "function id(v) { return v; }\nconst a = id(req.params.id);\neval(a);", [3]),
        ("python", "x = input()\nif x == 'a':\n    pass\nos.system(x)", [4]),
        ("python", "ok = input() == 'a'\nos.system(ok)", []),
        ("python", "x = input()\ny = interpolate(x)\nos.system(y)", [3]),
        ("python", "x = input()\ny = int(x)\nos.system(y)", []),
        ("go", "func f(r *http.Request) {\n a := r.FormValue(\"a\")\n exec.Command(a)\n}", [3]),
        ("java", "class E { void f() { String n = r.getParameter(\"n\"); s.executeQuery(\"a\" + n); } }", [1]),
    ],
)
def test_flows(language, code, lines):
    assert [n for n, _, _ in taint.analyse(code, language, [], [], [])] == lines


APP = {
    "src/app.py": "import os\nos.system('ls ' + name)\nos.system('rm ' + name)  # scan-ignore: py-shell\n",
    "src/page.js": "el.innerHTML = value\nel.innerHTML = sanitize(v)\neval(code)\neval('1')\n",
    "node_modules/x.js": "eval(a)\n",
    "tests/t.py": "os.system('a' + b)\n",
}


def test_scan(spark):
    result = scan.scan(source.from_strings(spark, APP))
    rows = sorted((f.file, f.line, f.rule_id) for f in result.findings.collect())
    # A constant argument is told by the snippet, which is the line; the sanitizer is within two lines of both assignments.
    assert rows == [("src/app.py", 2, "py-shell"), ("src/page.js", 3, "js-eval"), ("src/page.js", 4, "js-eval")]
    assert [(r.rule_id, r.suppressed) for r in result.suppressed.collect()] == [("py-shell", 1)]


def test_scan_text_and_ci(spark):
    assert {f.rule_id for f in scan.scan_text(spark, "import os\ndef f():\n    eval(x)\n").collect()} == {"py-eval-call"}
    found, code = scan.ci(source.from_strings(spark, APP), least="critical")
    assert code == 1 and found.count() >= 2
    assert scan.ci(source.from_strings(spark, {"a.py": "x = 1"}))[1] == 0


def test_incremental(spark):
    rules = catalog.load()
    files = source.from_strings(spark, APP)
    from siftwork.operators import compare

    hashed = compare.hashed(files, scan.ruleset_hash(rules))
    cache = compare.entries(hashed.where("path = 'src/app.py'"), scan.scan(files, rules).findings)
    found, good = scan.incremental(files, cache, rules)
    assert {f.file for f in found.collect()} == {"src/page.js"} and [c.path for c in good.collect()] == ["src/app.py"]


def test_reports(spark, tmp_path):
    found = scan.scan(source.from_strings(spark, APP)).findings.cache()
    log = json.loads(reports.write_report(found, "sarif"))
    assert reports.write_report(found, "sarif", str(tmp_path / "a.sarif")) == str(tmp_path / "a.sarif")
    assert log["version"] == "2.1.0" and {r["ruleId"] for r in log["runs"][0]["results"]} == {"py-shell", "js-eval"}
    assert json.loads((tmp_path / "a.sarif").read_text()) == log
    assert {t["id"] for t in log["runs"][0]["taxonomies"][0]["taxa"]} == {"CWE-78", "CWE-95"}
    lab = json.loads(reports.gitlab(found))
    assert lab["vulnerabilities"][0]["severity"] == "Critical" and lab["vulnerabilities"][0]["identifiers"][1]["value"] in ("78", "95")
    assert json.loads(reports.as_json(found))["summary"]["critical"] == found.count()
    assert "CRITICAL" in reports.pretty(found) and "<table>" in reports.as_html(found) and "findings" in reports.text_summary(found)


def test_fixes(spark):
    files = source.from_strings(spark, {"p.js": "a\nel.innerHTML = value\nb"})
    found = scan.scan(files, config=scan.Config(confidence="low")).findings
    out = fixes.apply(files, found).first()
    assert out.content == "a\nel.textContent = value\nb" and out.changed == 1
    pairs = spark.createDataFrame([("cmdi", "run(a, shell=True)", "run([a])"), ("cmdi", "run(a)", "run(a"), ("xss", "f(x)", ""), ("sqli", "q(a)", "q(a) # nosec")], "category string, original string, fixed string")
    got = [(r.is_valid, r.issues) for r in fixes.validate(pairs).collect()]
    assert got[0] == (True, []) and "balanced" in got[1][1] and "not_empty" in got[2][1] and got[3][1] == ["nothing_disabled"]
    reply = spark.createDataFrame([("Explanation: why\nConfidence: high\n```py\nx = 1\n```",)], "reply string")
    r = fixes.answers(reply).first()
    assert (r.code, r.explanation, r.confidence) == ("x = 1", "why", 0.9)
    batch = spark.createDataFrame([('```json\n{"fixes": [{"id": "1", "fixed_code": "c", "explanation": "e"}]}\n```',)], "reply string")
    assert [tuple(r) for r in fixes.batch_answers(batch).collect()] == [("1", "c", "e")]


def test_rules_are_valid_and_loading_is_lenient(tmp_path):
    assert catalog.violations(catalog.load()) == []
    (tmp_path / "a.yaml").write_text("id: x\nseverity: odd\npatterns: [{type: regex, pattern: '('}, {type: what}]")
    (tmp_path / "b.yaml").write_text("id: [broken")
    (tmp_path / "c.yaml").write_text("name: no id")
    (tmp_path / "d.yaml").write_text("id: x\nname: second")
    rules = catalog.load(str(tmp_path))
    assert [r["id"] for r in rules] == ["x"] and rules[0]["name"] == ""
    assert len(catalog.violations(rules)) == 6


def test_gate_files(tmp_path, monkeypatch):
    (tmp_path / "gate.yaml").write_text("max_critical: 3\nignore:\n  - {path: 'a/*', rules: ['*']}\n")
    (tmp_path / "over.yaml").write_text("max-critical: 7\n")
    gate = gates.load_gate(str(tmp_path / "gate.yaml"), str(tmp_path / "over.yaml"), str(tmp_path / "none.yaml"))
    assert gate.max_critical == 7 and gate.ignore == (("a/*", ("*",)),)
    assert gates.load_policy(str(tmp_path / "none.yaml")) is None
    monkeypatch.setenv("SIFTWORK_EXCLUDE", "a, b")
    assert gates.load_settings(str(tmp_path / "none.yaml")).exclude == ("a", "b")


def test_exit_codes(spark):
    df = spark.createDataFrame([("r", "high", "f")], "rule_id string, severity string, file string")
    broken = gates.policy_violations(df, gates.Policy({"high": 0}))
    fine = gates.policy_violations(df, gates.Policy({"high": 1}))
    assert gates.exit_code(broken, df) == 2 and gates.exit_code(fine, df) == 1 and gates.exit_code(fine, df.where("false")) == 0
    assert gates.policy_violations(df, None).collect() == []


def test_watch(spark):
    # The folder's name must not look like a test's.
    tmp_path = Path(tempfile.mkdtemp(prefix="watched"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text("import os\nos.system('x' + y)\n")
    seen = []
    stream = watch.changed_files(spark, str(tmp_path / "in"))
    run = lambda: watch.watch(stream, catalog.load(), lambda df, n: seen.append(sorted((f.file.rsplit("/", 1)[-1], f.line) for f in df.collect())), str(tmp_path / "state")).awaitTermination(120)
    run()
    (tmp_path / "in" / "b.js").write_text("eval(z)\n")
    run()
    assert seen == [[("a.py", 2)], [("b.js", 1)]]
    assert source.read_files(spark, str(tmp_path / "in")).count() == 2


@pytest.mark.parametrize(
    ("language", "code"),
    [("javascript", f"const a = {s};\n{k};") for s in ("req.cookies.x", "req.files.x", "process.argv[2]", "window.location.hash", "document.URL") for k in ("Function(a)", "setTimeout(a)", "x.outerHTML = a", "document.write(a)", "fetch(a)")]
    + [("python", f"a = request.{s}\n{k}(a)") for s in ("data", "cookies", "files") for k in ("c.executemany", "render_template_string", "pickle.loads")]
    + [("go", "a := r.Header.Get(\"x\")\ndb.QueryRow(a)"), ("java", "class E { void f() { String n = System.getenv(\"n\");\n s.executeUpdate(n); } }")],
)
def test_flows_of_whole_tables(language, code):
    assert [n for n, _, _ in taint.analyse(code, language, [], [], [])] == [2]


def test_tables_of_every_language():
    assert set(taint.DEFAULTS) >= set("javascript typescript python go java csharp php rust kotlin c cpp bash dart elixir lua scala solidity".split())
    assert all(all(x) for x in taint.DEFAULTS.values())


@pytest.mark.parametrize(
    ("language", "code"),
    [
        ("javascript", "const a = " + "(" * 3000 + "req.body.x" + ")" * 3000 + ";\neval(a);"),
        ("javascript", "const a = 'b'" + " + 'b'" * 3000 + " + req.body.x;\neval(a);"),
        ("python", "a = 'b'" + " + 'b'" * 1500 + " + input()\neval(a)"),
        ("python", "a = input()\neval('b'" + " + 'b'" * 1500 + " + a)"),
    ],
)
def test_deep_files_are_read(language, code):
    assert [n for n, _, _ in taint.analyse(code, language, [], [], [])] == [2]


def test_flows_cross_files(spark):
    files = source.from_strings(spark, {"src/app.js": "import { input } from './lib'\neval(input)\n", "src/lib.js": "export const input = req.body.x\n", "src/other.js": "import { input } from 'lib'\neval(input)\n"})
    rule = catalog.parse({"id": "flow", "confidence": "high", "severity": "high", "patterns": [{"type": "taint", "sources": ["req.body"], "sinks": ["eval"]}]})
    found = scan.scan(files, [rule]).findings
    assert [(f.file, f.line) for f in found.collect()] == [("src/app.js", 2)]

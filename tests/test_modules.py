from siftwork.operators import modules
from siftwork.sources import files as source

FILES = {
    "a.js": "import x from './x'\nimport {a, b as c} from \"./y\";\nimport * as all from '../z'\nimport './bare'\nconst q = require('q')\nlet { m, n } = require(\"./mn\");\nvar no = load('n')\nimportant('x')\n// nothing",
    "b.ts": "export const one = 1\nexport function two() {}\nexport default function three() {}\nexports.four = 4\nmodule.exports = {\n  five,\n  six: seven\n}\nif (exports.x == 1) y()\nexport { z }",
    "c.py": "from .pkg.mod import f, g as h  # why\n    import os, sys\nimport\nfrom x\ndef go(a):\nclass _Own:\n  def inner():\nclass Seen(Base):",
    "d.go": 'package d\nimport (\n  "fmt"\n  m "net/http"\n)\nfunc Serve(x int) {}\nfunc (r *T) Not() {}\nvar small = 1\ntype Kind struct {',
    "E.java": "import java.util.List;\nimport static a.b.C.*;\n  import no.such;\npublic class E {\n  public static void main(String[] a) {\n  public E() {\n  public Map<String, Integer> all;\n  public final int X = 3;\n  private int y;",
    "F.cs": "using System.IO;\nusing (var x = y) {\nusing Z = A.B;\npublic struct S {\n  public Task Run(int a)\n  public int? Size { get; }",
}


def test_statements(spark):
    own = source.from_strings(spark, FILES)
    lines = source.lines(own)
    got = sorted((r.path, r.line_no, r.source, tuple(r.names)) for r in modules.imports(lines, own).collect() if r.line_no)
    assert got == sorted([
        ("a.js", 1, "./x", ("x",)), ("a.js", 2, "./y", ("a", "b as c")), ("a.js", 3, "../z", ("all",)), ("a.js", 4, "./bare", ()), ("a.js", 5, "q", ("q",)), ("a.js", 6, "./mn", ("m", "n")),
        ("c.py", 1, ".pkg.mod", ("f", "g as h")), ("c.py", 2, "os", ("os", "sys")), ("E.java", 1, "java.util.List", ()), ("E.java", 2, "a.b.C.*", ()), ("F.cs", 1, "System.IO", ()),
    ])
    assert sorted(r.source for r in modules.imports(lines, own).where("line_no IS NULL").collect()) == ["fmt", "net/http"]
    names = sorted((r.path, r.line_no, r.name) for r in modules.exports(lines, own).collect())
    assert names == sorted([
        ("b.ts", 1, "one"), ("b.ts", 2, "two"), ("b.ts", 3, "default"), ("b.ts", 4, "four"), ("b.ts", 5, "five"), ("b.ts", 5, "six"), ("b.ts", 9, "x"),
        ("c.py", 5, "go"), ("c.py", 8, "Seen"), ("d.go", 6, "Serve"), ("d.go", 9, "Kind"), ("E.java", 5, "main"), ("E.java", 7, "all"), ("E.java", 8, "X"), ("F.cs", 5, "Run"), ("F.cs", 6, "Size"),
    ])


def test_lines_are_taken_apart_once(spark):
    own = source.from_strings(spark, FILES)
    lines = source.lines(own)
    for found in (modules.imports(lines, own), modules.exports(lines, own)):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_resolution_takes_the_first_that_is_there(spark):
    """Every ending and index file against trying one after the other; an import is one row of the join, not one for each try."""
    ends = ["", *modules.EXTENSIONS, *["/index" + e for e in modules.INDEX]]
    there = {f"p/m{k}{e}" for k in range(len(ends)) for e in ends[k:]} | {"p/odd.js.js", "p/index.js", "p/odd.rb", "q.js"}
    asked = [("p/a.js", n, s, ["x"]) for n, s in enumerate([*[f"./m{k}" for k in range(len(ends) + 1)], "./odd", "./odd.js", "./odd.rb", ".", "../q", "../p/m3", "./m1.js", "react"])]
    found = spark.createDataFrame(asked, "path string, line_no int, source string, names array<string>")
    out = modules.resolved(found, spark.createDataFrame([(p,) for p in sorted(there)] * 2, "path string"))
    clean = {".": "p", "../q": "q", "../p/m3": "p/m3"}
    want = []
    for _, n, s, _ in asked:
        hits = [t for t in (clean.get(s, "p" + s[1:]) + e for e in ends) if s.startswith(".") and t in there]
        want += [(n, s, hits[0])] if hits else []
    assert sorted((r.line_no, r.source, r.target) for r in out.collect()) == want
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()

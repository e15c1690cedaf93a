"""Data flow from sources to sinks within files, by syntax tree.

One pass in the order of the text; what is tainted stays so. A call of a function of the same file is followed through a
summary: which of its parameters reach a sink, and whether it gives back what came in.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import described
from .syntax import OUT, Node, as_findings, deep, parse, text_of

# Defaults for rules that name no sources or sinks, by language: sources, sinks, sanitizers.
DEFAULTS: dict[str, tuple[list[str], list[str], list[str]]] = {
    "javascript": (
        ["req.body", "req.params", "req.query", "req.headers", "req.cookies", "req.files", "process.argv", "window.location", "document.URL"],
        [".query(", ".execute(", "eval(", "Function(", "setTimeout(", "setInterval(", ".innerHTML", ".outerHTML", "document.write", "document.writeln", "child_process.exec", "child_process.execSync", "child_process.spawn", "cp.exec", "cp.execSync", "cp.spawn", "fetch("],
        ["DOMPurify.sanitize", "escapeHtml", "htmlspecialchars", "encodeURIComponent", "he.encode", "validator.escape"],
    ),
    "typescript": (
        ["req.body", "req.params", "req.query", "req.headers", "process.argv"],
        [".query", "eval", ".innerHTML", ".exec", "document.write"],
        ["DOMPurify.sanitize", "escapeHtml"],
    ),
    "python": (
        ["request.args", "request.form", "request.json", "request.data", "request.headers", "request.cookies", "request.files", "sys.argv", "input", "input()"],
        [".execute", ".executemany", "eval", "exec", "os.system", "subprocess.call", "subprocess.run", "subprocess.Popen", "render_template_string", "pickle.loads"],
        ["bleach.clean", "html.escape", "urllib.parse.quote", "sqlalchemy.text"],
    ),
    "go": (
        ["r.Body", "r.URL.Query", "r.FormValue", "r.PostFormValue", "r.Header.Get", "os.Args", "req.Body"],
        [".Query", ".Exec", ".QueryRow", ".QueryContext", ".ExecContext", "exec.Command", "os/exec.Command", "template.Parse", "template.Execute"],
        ["html.EscapeString", "url.QueryEscape", "strconv.Quote"],
    ),
    "java": (
        ["request.getParameter", "req.getParameter", "request.getHeader", "request.getInputStream", "System.getenv", "args["],
        [".execute", ".executeQuery", ".executeUpdate", "Runtime.getRuntime().exec", "new ProcessBuilder", "readObject", ".eval("],
        ["PreparedStatement", "ESAPI.encoder", "org.owasp.encoder"],
    ),
    "csharp": (
        ["Request.QueryString", "Request.Form", "Request.Params", "Request.Headers", "Request.Cookies", "Environment.GetEnvironmentVariable", "args["],
        [".Execute", ".ExecuteNonQuery", ".ExecuteReader", "Process.Start", "new Process", "Assembly.Load", ".Deserialize"],
        ["HttpUtility.HtmlEncode", "WebUtility.HtmlEncode", "AntiXssEncoder", "SqlParameter"],
    ),
    "php": (
        ["$_GET", "$_POST", "$_REQUEST", "$_COOKIE", "$_FILES", "$_SERVER", "$argv"],
        ["mysql_query", "mysqli_query", "->query", "->exec", "->prepare", "eval(", "exec(", "system(", "shell_exec(", "passthru(", "proc_open(", "file_get_contents(", "fopen(", "include(", "require(", "echo ", "print ", "header(", "unserialize("],
        ["htmlspecialchars", "htmlentities", "strip_tags", "mysqli_real_escape_string", "PDO::quote", "escapeshellarg", "escapeshellcmd", "filter_input"],
    ),
    "rust": (
        ["std::io::stdin", "std::env::args", "std::env::var", "req.body", "req.params", "req.query"],
        ["Command::new", "std::fs::read", "std::fs::write", "File::open", "sqlx::query", "sql_query", "reqwest::get"],
        [" ammonia::clean", " pulldown_cmark"],
    ),
    "kotlin": (
        ["intent.getStringExtra", "intent.getData", "request.getParameter", "req.getParameter", "args["],
        [".execute", ".executeQuery", "Runtime.getRuntime().exec", "new ProcessBuilder", "readObject", ".eval("],
        ["PreparedStatement", "org.owasp.encoder", "HtmlCompat"],
    ),
    "c": (
        ["argv[", "getenv(", "fgets(", "scanf(", "read(", "recv(", "recvfrom("],
        ["system(", "popen(", "exec(", "sprintf(", "strcpy(", "strcat(", "memcpy(", "gets(", "fopen(", "open("],
        ["strncpy", "strncat", "snprintf", "strlcpy", "strlcat"],
    ),
    "cpp": (
        ["argv[", "std::getenv(", "std::cin", "getenv(", "recv(", "recvfrom("],
        ["system(", "popen(", "exec(", "sprintf(", "strcpy(", "strcat(", "memcpy(", "std::system(", "std::process::system("],
        ["std::string", "strncpy", "snprintf", "strlcpy"],
    ),
    "bash": (
        ["$1", "$2", "$@", "read ", "cat ", "curl ", "wget ", "env", "getopts"],
        ["eval", "exec", "system", "source", ".", "mysql", "psql", "rm -rf", "chmod", "chown", "tee"],
        ["quoted", "printf '%q'", "sed 's/[^a-zA-Z0-9]//g'", "tr -d"],
    ),
    "dart": (
        ["stdin", "args", "TextEditingController", "queryParameters", "headers", "uri.pathSegments", "MethodChannel"],
        ["eval", "execute", "rawQuery", "innerHtml", "loadUrl", "open", "File(", "http.get", "http.post", "Process.run", "Process.start"],
        ["HtmlEscape", "Uri.encodeComponent", "Uri.encodeFull", "RegExp.escape", "validator", "int.parse", "double.parse"],
    ),
    "elixir": (
        ["params", "conn.params", "conn.query_string", "System.get_env", "IO.gets", "File.read!", "recv"],
        ["Ecto.Adapters.SQL.query", "unsafe_fragment", "Code.eval_string", "Code.load_file", "System.cmd", ":os.cmd", "send_resp", "render", "File.write!", "File.rm!", "spawn"],
        ["HtmlEntities.encode", "URI.encode", "Regex.escape", "String.trim", "Integer.parse", "Float.parse", "Phoenix.HTML"],
    ),
    "lua": (
        ["arg", "io.read", "os.getenv", "socket.receive", "ngx.var", "ngx.req.get_uri_args", "ngx.req.get_post_args", "request"],
        ["os.execute", "io.popen", "loadstring", "load", "loadfile", "dofile", "require", "io.open", "socket.http.request", "luasql", "ngx.redirect"],
        ["ngx.escape_uri", "string.gsub", "string.match", "tonumber", "tostring", "ngx.quote_sql_str"],
    ),
    "scala": (
        ["request.queryString", "request.body", "params", "args", "scala.io.StdIn", "System.getenv", "request.headers", "request.path"],
        ["sql", "DB.withConnection", "raw", "slick.jdbc", "Runtime.exec", "ProcessBuilder", "Process", "scala.tools.nsc", "ObjectInputStream", "new File", "WS.url", "render"],
        ["HtmlFormat.escape", "UriEncoding.encodePath", "StringEscapeUtils", "play.api.libs.json.Json", "scala.xml.Utility.escape"],
    ),
    "solidity": (
        ["msg.data", "msg.sender", "msg.value", "tx.origin", "block.timestamp", "block.number", "block.coinbase", "block.difficulty"],
        ["call.value", "delegatecall", "selfdestruct", "send(", "transfer(", "call{value:", "address.call", "assembly", "create", "create2"],
        ["require", "assert", "revert", "check", "SafeMath", "OpenZeppelin", "onlyOwner", "nonReentrant"],
    ),
}
FIRST_ARGUMENT = (".query", ".execute", ".run")
_CALLS = {"call", "call_expression", "method_invocation"}
_ASSIGNS = {"assignment", "assignment_expression", "assignment_statement", "variable_declarator", "short_var_declaration", "augmented_assignment"}
_FUNCTIONS = {"function_definition", "function_declaration", "method_declaration", "arrow_function"}
_MEMBERS = {"attribute", "member_expression", "selector_expression", "field_access", "subscript"}


#: Names of our own beside the defaults, by language, in the same order. They are whole names of calls, or what follows their last point.
OWN: dict[str, tuple[list[str], list[str], list[str]]] = {
    "javascript": ([], ["exec"], ["escape", "sanitize", "parseInt"]),
    "typescript": ([], [], ["escape", "sanitize", "encodeURIComponent", "parseInt"]),
    "python": ([], ["subprocess.check_output", "subprocess.check_call"], ["escape", "shlex.quote", "int"]),
    "go": ([], [], ["strconv.Atoi"]),
    "java": (["getParameter", "getHeader"], ["exec", "println"], ["encode", "escape"]),
}


def register(language: str, sources: list[str], sinks: list[str], sanitizers: list[str]) -> None:
    """Defaults for one more language."""
    DEFAULTS[language] = (sources, sinks, sanitizers)


def child(node: Node, *names: str) -> Node | None:
    return next((c for n, c in node.children if n in names), None)


class Flow:
    """The analysis of one file for one set of sources, sinks and sanitizers."""

    def __init__(self, tree: Node, raw: bytes, sources: list[str], sinks: list[str], sanitizers: list[str], seeds: set[str] = frozenset(), own: tuple[list[str], list[str], list[str]] = ([], [], [])):
        self.own = tuple(map(frozenset, own))
        clean = lambda words: [w.rstrip("(") for w in words]
        self.raw, self.sources, self.sinks, self.sanitizers = raw, clean(sources), clean(sinks), clean(sanitizers)
        self.found: list[Node] = []
        self.summaries: dict[str, tuple[set[int], set[int]]] = {}
        self.functions = [(text_of(n, raw), f) for f in tree.all() if f.kind in _FUNCTIONS for n in [child(f, "name")] if n]
        for name, f in self.functions:
            self.summaries[name] = self._summary(f)
        self.tainted: set[str] = set(seeds)
        self._walk(tree, report=True)

    def _own(self, name: str, role: int) -> bool:
        """Whether a call's whole name, or what follows its last point, is one of our own sources (0), sinks (1) or sanitizers (2)."""
        return name in self.own[role] or name.rpartition(".")[2] in self.own[role]

    def text(self, n: Node) -> str:
        return text_of(n, self.raw)

    def _summary(self, f: Node) -> tuple[set[int], set[int]]:
        """Numbers of the parameters that reach a sink, and of those that are given back."""
        params, body = child(f, "parameters", "args"), f
        names = [self.text(p) for p in (params.all() if params else ()) if p.kind == "identifier"]
        reach, back = set(), set()
        for k, name in enumerate(names):
            self.tainted, before = {name}, len(self.found)
            self._walk(body, report=True)
            if len(self.found) > before:
                reach.add(k)
            del self.found[before:]
            values = [c for n in body.all() if n.kind == "return_statement" for _, c in n.children]
            if any(self.is_tainted(v) for v in values):
                back.add(k)
        return reach, back

    def _args(self, call: Node) -> list[Node]:
        args = child(call, "arguments")
        return [c for _, c in args.children] if args else []

    def is_tainted(self, n: Node) -> bool:
        if n.kind == "identifier":
            return self.text(n) in self.tainted
        if n.kind in _MEMBERS:
            text = self.text(n)
            return any(s in text for s in self.sources) or text in self.tainted or self._any(c for _, c in n.children[:1])
        if n.kind in _CALLS:
            function = child(n, "function")
            name = self.text(function) if function else ""
            if any(s in name for s in self.sources) or self._own(name, 0):
                return True
            own = self.summaries.get(name)
            if own and self._any(a for k, a in enumerate(self._args(n)) if k in own[1]):
                return True
            if name and (any(s in name or name in s for s in self.sanitizers) or self._own(name, 2)):
                return False
            if function and function.kind in _MEMBERS and self.is_tainted(function):
                return True
            return not own and self._any(self._args(n))
        if n.kind in ("comparison_operator", "boolean_operator") or any(c.kind == "comparison" for _, c in n.children):
            return False
        return self._any(c for _, c in n.children)

    def _any(self, nodes: Iterable[Node]) -> bool:
        # A loop: deep trees may not go through calls in C.
        for c in nodes:
            if self.is_tainted(c):
                return True
        return False

    def _walk(self, n: Node, report: bool) -> None:
        if n.kind in _ASSIGNS:
            left, right = child(n, "left", "name", "targets"), child(n, "right", "value")
            if left and right:
                if self.is_tainted(right):
                    self.tainted.update(self.text(x) for x in ([left] if left.kind in _MEMBERS else left.all()) if x.kind == "identifier" or x.kind in _MEMBERS)
                    if left.kind in _MEMBERS and any(s.lstrip(".") in self.text(left) for s in self.sinks):
                        self.found.append(n)
        elif n.kind in _CALLS:
            self._call(n)
        for _, c in n.children:
            self._walk(c, report)

    def _call(self, n: Node) -> None:
        function = child(n, "function")
        name = self.text(function) if function else ""
        args = self._args(n)
        if any(s in name for s in self.sinks) or self._own(name, 1):
            checked = args[:1] if any(name.endswith(x) for x in FIRST_ARGUMENT) else args
            if any(self.is_tainted(a) for a in checked):
                self.found.append(n)
                return
        own = self.summaries.get(name)
        if own and any(k in own[0] and self.is_tainted(a) for k, a in enumerate(args)):
            self.found.append(n)


def analyse(source: str, language: str, sources: list[str], sinks: list[str], sanitizers: list[str], seeds: set[str] = frozenset()) -> list[tuple[int, int, str]]:
    """(line, column, snippet) of each place where a source's value reaches a sink."""
    tree = parse(source, language)
    if tree is None:
        return []
    raw = source.encode("utf-8", "surrogatepass")
    none: tuple[list[str], list[str], list[str]] = ([], [], [])
    default, own = DEFAULTS.get(language, none), OWN.get(language, none)
    ours = ([] if sources else own[0], [] if sinks else own[1], [] if sanitizers or sources and sinks else own[2])
    with deep():
        flow = Flow(tree, raw, sources or default[0], sinks or default[1], sanitizers or ([] if sources and sinks else default[2]), seeds, ours)
    out = []
    for n in sorted({(n.start, n.end) for n in flow.found}):
        before = raw[: n[0]]
        out.append((before.count(b"\n") + 1, n[0] - (before.rfind(b"\n") + 1) + 1, raw[n[0] : n[1]].decode("utf-8", "replace")))
    return out


def findings(files: DataFrame, rules: list[dict[str, Any]], seeds: DataFrame | None = None) -> DataFrame:
    """Findings of taint rules; `seeds` (path, name) are names that other files taint."""
    wanted = []
    for r in rules:
        own = [(n, p) for n, p in enumerate(r["patterns"]) if p[0] == "taint"]
        if own:
            merge = lambda k: [x for _, p in own for x in p[k] or []]
            wanted.append((r["id"], own[0][0], merge(3), merge(4), merge(5), [x.lower() for x in r["languages"]]))
    rows = described(files).select("path", "language", "content")
    if seeds is not None:
        rows = rows.join(seeds.groupBy("path").agg(F.collect_set("name").alias("seeds")), "path", "left")
    else:
        rows = rows.withColumn("seeds", F.lit(None).cast("array<string>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, language, content, names in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content", "seeds"))):
                for rule, n, sources, sinks, sanitizers, spoken in wanted:
                    if spoken and "*" not in spoken and language not in spoken:
                        continue
                    for line, column, snippet in analyse(content or "", language, sources, sinks, sanitizers, set(names or ())):
                        out.append((path, rule, n, line, column, snippet, []))
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=["path", "rule_id", "pattern_ord", "line", "column", "snippet", "metavars"])

    return as_findings(rows.mapInArrow(run, OUT), rules, 2)

"""Syntax trees of source files, and queries over them.

Trees are small and irregular, so a file is parsed and queried in one Arrow batch function; files are independent and
spread over tasks. Python is parsed by the standard library; JavaScript, TypeScript, Go and Java by a tolerant reader that
knows strings, comments, calls, members, assignments, declarations, returns and functions, which is what queries name.
"""

from __future__ import annotations

import ast
import re
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fill
from ..sources.files import described


@dataclass
class Node:
    kind: str
    start: int
    end: int
    children: list[tuple[str, Node]] = field(default_factory=list)

    def all(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(c for _, c in reversed(n.children))


#: Frames of Python that reading a file may take; they lie on the heap.
DEEPEST = 200_000


@contextmanager
def deep() -> Iterator[None]:
    """Let trees be read and walked to a depth of DEEPEST frames."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, DEEPEST))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


# ---- Python ----

_PY = {
    ast.Call: "call", ast.Name: "identifier", ast.Attribute: "attribute", ast.Assign: "assignment", ast.AnnAssign: "assignment", ast.AugAssign: "augmented_assignment",
    ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition", ast.Return: "return_statement", ast.BinOp: "binary_operator", ast.JoinedStr: "string",
    ast.Compare: "comparison_operator", ast.BoolOp: "boolean_operator", ast.Subscript: "subscript", ast.ClassDef: "class_definition", ast.Import: "import_statement",
    ast.ImportFrom: "import_from_statement", ast.If: "if_statement", ast.Expr: "expression_statement", ast.Module: "module", ast.keyword: "keyword_argument", ast.FormattedValue: "interpolation",
    ast.List: "list", ast.Dict: "dictionary", ast.Tuple: "tuple", ast.Lambda: "lambda", ast.Try: "try_statement", ast.With: "with_statement", ast.For: "for_statement", ast.While: "while_statement",
}
_PY_FIELDS = {("Call", "func"): "function", ("Attribute", "value"): "object", ("Assign", "targets"): "left", ("Assign", "value"): "right", ("AnnAssign", "target"): "left", ("AnnAssign", "value"): "right", ("AugAssign", "target"): "left", ("AugAssign", "value"): "right", ("keyword", "value"): "value", ("Return", "value"): "value"}


def _python(source: str) -> Node | None:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    raw = source.encode("utf-8", "surrogatepass")
    starts = [0]
    for line in raw.split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)

    def at(n: ast.AST) -> tuple[int, int]:
        return starts[n.lineno - 1] + n.col_offset, starts[n.end_lineno - 1] + n.end_col_offset

    def make(n: ast.AST, start: int, end: int) -> Node:
        if hasattr(n, "lineno") and getattr(n, "end_lineno", None):
            start, end = at(n)
        kind = _PY.get(type(n), type(n).__name__.lower())
        if isinstance(n, ast.Constant):
            v = n.value
            kind = "string" if isinstance(v, (str, bytes)) else "true" if v is True else "false" if v is False else "none" if v is None else "integer" if isinstance(v, int) else "float"
        out = Node(kind, start, end)
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            name = re.compile(rb"\b(?:def|class)\s+").search(raw, start)
            a = name.end() if name else start
            out.children.append(("name", Node("identifier", a, a + len(n.name.encode()))))
        if isinstance(n, ast.arg):
            out.kind = "identifier"
            out.end = start + len(n.arg.encode())
            return out
        if isinstance(n, ast.Call):
            function = make(n.func, start, end)
            args = Node("argument_list", function.end, end)
            args.children = [("", make(x, start, end)) for x in [*n.args, *n.keywords]]
            out.children += [("function", function), ("arguments", args)]
            return out
        for name, value in ast.iter_fields(n):
            for x in value if isinstance(value, list) else [value]:
                if isinstance(x, ast.AST) and not isinstance(x, (ast.expr_context, ast.operator, ast.boolop, ast.cmpop, ast.unaryop)):
                    child = make(x, start, end)
                    if isinstance(x, ast.arguments):
                        child.kind = "parameters"
                    out.children.append((_PY_FIELDS.get((type(n).__name__, name), name), child))
        if isinstance(n, ast.Attribute):
            size = len(n.attr.encode())
            out.children.append(("attribute", Node("identifier", out.end - size, out.end)))
        return out

    return make(tree, 0, len(raw))


# ---- languages with braces ----

_TOKEN = re.compile(
    r"""(?P<space>\s+|//[^\n]*|/\*.*?\*/)|(?P<template>`(?:\\.|\$\{[^}]*\}|[^`\\])*`)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<number>\d[\w.]*)|(?P<word>[A-Za-z_$][\w$]*)|(?P<op>=>|:=|===|!==|==|!=|<=|>=|&&|\|\||\+=|[-+*/%&|^!<>=?:;,.(){}\[\]@#~])""",
    re.S,
)
_DECLARE = {"const", "let", "var", "final"}
_SKIP = {"new", "await", "typeof", "public", "private", "protected", "static", "async", "export", "default", "throw"}
_COMPARE = {"===", "!==", "==", "!=", "<", ">", "<=", ">=", "&&", "||"}
_KINDS = {
    "javascript": {"call": "call_expression", "member": "member_expression", "property": "property_identifier", "assign": "assignment_expression", "declare": "variable_declarator", "function": "function_declaration", "args": "arguments", "binary": "binary_expression", "template": "template_string"},
    "go": {"call": "call_expression", "member": "selector_expression", "property": "field_identifier", "assign": "assignment_statement", "declare": "short_var_declaration", "function": "function_declaration", "args": "argument_list", "binary": "binary_expression", "template": "raw_string_literal"},
    "java": {"call": "method_invocation", "member": "field_access", "property": "identifier", "assign": "assignment_expression", "declare": "variable_declarator", "function": "method_declaration", "args": "argument_list", "binary": "binary_expression", "template": "string_literal"},
}


class _Reader:
    """A recursive reader of expressions and statements; what it doesn't know it steps over."""

    def __init__(self, source: str, language: str):
        self.kinds = _KINDS["javascript" if language in ("javascript", "typescript") else language]
        self.language = language
        self.tokens: list[tuple[str, str, int, int]] = []
        raw, byte = 0, 0
        for m in _TOKEN.finditer(source):
            byte += len(source[raw : m.start()].encode("utf-8", "surrogatepass"))
            size = len(m.group().encode("utf-8", "surrogatepass"))
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup or "op", m.group(), byte, byte + size))
            raw, byte = m.end(), byte + size
        self.at = 0
        self.size = byte

    def peek(self, n: int = 0) -> tuple[str, str, int, int]:
        return self.tokens[self.at + n] if self.at + n < len(self.tokens) else ("end", "", self.size, self.size)

    def program(self) -> Node:
        out = Node("program", 0, self.size)
        while self.peek()[0] != "end":
            out.children.append(("", self.statement()))
        return out

    def block(self) -> Node:
        out = Node("statement_block", self.peek()[2], self.peek()[3])
        self.at += 1
        while self.peek()[0] != "end" and self.peek()[1] != "}":
            out.children.append(("", self.statement()))
        out.end = self.peek()[3]
        self.at += 1
        return out

    def statement(self) -> Node:
        kind, text, start, end = self.peek()
        if text == "{":
            return self.block()
        if text in ("function", "func") and kind == "word":
            return self.function()
        if text in _DECLARE and kind == "word":
            self.at += 1
            name = self.expression(False)
            out = Node(self.kinds["declare"], start, name.end, [("name", name)])
            if self.peek()[1] == "=":
                self.at += 1
                value = self.expression()
                out.children.append(("value", value))
                out.end = value.end
            return out
        if text == "return" and kind == "word":
            self.at += 1
            out = Node("return_statement", start, end)
            if self.peek()[1] not in (";", "}"):
                value = self.expression()
                out.children.append(("", value))
                out.end = value.end
            return out
        if text in _SKIP and kind == "word":
            self.at += 1
            return self.statement() if self.peek()[0] != "end" else Node("word", start, end)
        if kind == "op" and text not in ("(", "[", "!", "-", "@"):
            self.at += 1
            return Node("punctuation", start, end)
        left = self.expression()
        kind, text, _, _ = self.peek()
        if self.language == "java" and left.kind in ("identifier", "field_access") and kind == "word":
            # A type and a name: a declaration, or a method if a list of parameters and a block follow.
            name = Node("identifier", *self.peek()[2:])
            self.at += 1
            if self.peek()[1] == "(":
                return self.parameters(Node(self.kinds["function"], left.start, name.end, [("type", left), ("name", name)]))
            out = Node(self.kinds["declare"], left.start, name.end, [("name", name)])
            if self.peek()[1] == "=":
                self.at += 1
                value = self.expression()
                out.children.append(("value", value))
                out.end = value.end
            return out
        while self.peek()[1] == "," and self.language == "go":
            self.at += 1
            self.expression(False)
        if self.peek()[1] in ("=", ":=", "+="):
            declares = self.peek()[1] == ":="
            self.at += 1
            right = self.expression()
            return Node(self.kinds["declare" if declares else "assign"], left.start, right.end, [("left", left), ("right", right)])
        return Node("expression_statement", left.start, left.end, [("", left)])

    def function(self) -> Node:
        start = self.peek()[2]
        self.at += 1
        if self.language == "go" and self.peek()[1] == "(":
            self.skip("(", ")")
        out = Node(self.kinds["function"], start, self.peek()[3])
        if self.peek()[0] == "word":
            out.children.append(("name", Node("identifier", *self.peek()[2:])))
            self.at += 1
        return self.parameters(out)

    def parameters(self, out: Node) -> Node:
        params = Node("parameters", self.peek()[2], self.peek()[3])
        if self.peek()[1] == "(":
            depth = 0
            fresh = True
            while self.peek()[0] != "end":
                kind, text, a, b = self.peek()
                self.at += 1
                depth += (text == "(") - (text == ")")
                if depth == 0:
                    params.end = b
                    break
                last_of_two = self.language == "java" and kind == "word" and self.peek()[1] in (",", ")")
                if kind == "word" and (last_of_two if self.language == "java" else fresh):
                    params.children.append(("", Node("identifier", a, b)))
                    fresh = False
                fresh = fresh or text == ","
        out.children.append(("parameters", params))
        while self.peek()[0] != "end" and self.peek()[1] not in ("{", ";", "=>"):
            self.at += 1
        if self.peek()[1] == "=>":
            self.at += 1
        if self.peek()[1] == "{":
            body = self.block()
            out.children.append(("body", body))
            out.end = body.end
        return out

    def skip(self, opening: str, closing: str) -> None:
        depth = 0
        while self.peek()[0] != "end":
            depth += (self.peek()[1] == opening) - (self.peek()[1] == closing)
            self.at += 1
            if depth == 0:
                return

    def expression(self, operators: bool = True) -> Node:
        out = self.unary()
        while operators and self.peek()[0] == "op" and (self.peek()[1] in _COMPARE or self.peek()[1] in "+-*/%?:&|^" and self.peek()[1] != ""):
            if self.peek()[1] == ":" and self.language == "go":
                break
            compares = self.peek()[1] in _COMPARE
            operator = self.peek()
            self.at += 1
            right = self.unary()
            out = Node(self.kinds["binary"], out.start, right.end, [("left", out), ("operator", Node("comparison" if compares else "operator", *operator[2:])), ("right", right)])
        return out

    def unary(self) -> Node:
        while self.peek()[1] in ("!", "-", "&", "*", "new", "await", "typeof", "...") and self.peek()[0] != "end":
            self.at += 1
        kind, text, start, end = self.peek()
        self.at += kind != "end"
        if kind == "string":
            out = Node("interpreted_string_literal" if self.language == "go" else "string", start, end)
        elif kind == "template":
            out = Node(self.kinds["template"], start, end)
            if self.language in ("javascript", "typescript"):
                shift = 0
                for m in re.finditer(r"\$\{([^}]*)\}", text):
                    inner = _Reader(m.group(1), self.language)
                    shift = start + len(text[: m.start(1)].encode("utf-8", "surrogatepass"))
                    value = inner.expression()
                    for n in value.all():
                        n.start, n.end = n.start + shift, n.end + shift
                    out.children.append(("", Node("template_substitution", shift - 2, value.end + 1, [("", value)])))
        elif kind == "number":
            out = Node("number", start, end)
        elif text == "function" or text == "func" and self.peek()[1] == "(":
            self.at -= 1
            out = self.function()
        elif text == "(":
            out = Node("parenthesized_expression", start, end)
            self._list(out, ")")
            if self.peek()[1] == "=>":
                self.at += 1
                body = self.block() if self.peek()[1] == "{" else self.expression()
                names = [("", c) for _, c in out.children if c.kind == "identifier"]
                out = Node("arrow_function", start, body.end, [("parameters", Node("parameters", start, out.end, names)), ("body", body)])
        elif text == "[":
            out = Node("array", start, end)
            self._list(out, "]")
        elif text == "{":
            out = Node("object", start, end)
            self._list(out, "}")
        else:
            out = Node("identifier" if kind == "word" else "punctuation", start, end)
        while True:
            text = self.peek()[1]
            if text == "." and self.peek(1)[0] == "word":
                name = Node(self.kinds["property"], *self.peek(1)[2:])
                self.at += 2
                out = Node(self.kinds["member"], out.start, name.end, [("object", out), ("property", name)])
            elif text == "(" and out.kind not in ("number", "string"):
                args = Node(self.kinds["args"], self.peek()[2], self.peek()[3])
                self.at += 1
                self._list(args, ")")
                out = Node(self.kinds["call"], out.start, args.end, [("function", out), ("arguments", args)])
            elif text == "[":
                index = Node("subscript", out.start, self.peek()[3], [("object", out)])
                self.at += 1
                self._list(index, "]")
                out = index
            elif text == "=>" and out.kind == "identifier":
                self.at += 1
                body = self.block() if self.peek()[1] == "{" else self.expression()
                out = Node("arrow_function", out.start, body.end, [("parameters", Node("parameters", out.start, out.end, [("", out)])), ("body", body)])
            else:
                return out

    def _list(self, out: Node, closing: str) -> None:
        while self.peek()[0] != "end" and self.peek()[1] != closing:
            before = self.at
            if self.peek()[1] in (",", ";", ":"):
                self.at += 1
                continue
            child = self.statement() if self.peek()[1] in ("function", "func") else self.expression()
            if self.peek()[1] in ("=", ":="):
                self.at += 1
                right = self.expression()
                child = Node(self.kinds["assign"], child.start, right.end, [("left", child), ("right", right)])
            out.children.append(("", child))
            if self.at == before:
                self.at += 1
        out.end = self.peek()[3]
        self.at += self.peek()[0] != "end"


def parse(source: str, language: str) -> Node | None:
    """The tree of a text, or None if its language is unknown or it can't be read."""
    try:
        with deep():
            if language == "python":
                return _python(source)
            if language in ("javascript", "typescript", "go", "java"):
                return _Reader(source, language).program()
    except RecursionError:
        pass
    return None


def text_of(node: Node, raw: bytes) -> str:
    return raw[node.start : node.end].decode("utf-8", "replace")


# ---- queries ----


@dataclass
class Step:
    kind: str
    capture: str = ""
    name: str = ""
    children: list[Step] = field(default_factory=list)
    anchored: bool = False
    options: list[Step] = field(default_factory=list)


@dataclass
class Query:
    steps: list[Step]
    tests: list[tuple[str, str, str]]


_LEX = re.compile(r'\s+|;[^\n]*|"(?:\\.|[^"\\])*"|#[\w?-]+|@[\w.-]+|[A-Za-z_][\w-]*:?|[()\[\].*+?!]')


def compile_query(text: str) -> Query:
    """Patterns of node kinds with fields, captures, anchors and alternatives; predicates `#eq?`, `#not-eq?`, `#match?`."""
    tokens, at = [], 0
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m.group().strip() and not m.group().startswith(";"):
            tokens.append(m.group())
    pos = 0
    tests: list[tuple[str, str, str]] = []

    def peek() -> str:
        return tokens[pos] if pos < len(tokens) else ""

    def take(expected: str | None = None) -> str:
        nonlocal pos
        if pos >= len(tokens) or expected and tokens[pos] != expected:
            raise ValueError(f"expected {expected or 'more'}")
        pos += 1
        return tokens[pos - 1]

    def after(step: Step) -> Step:
        while peek().startswith("@") or peek() in ("*", "+", "?"):
            token = take()
            if token.startswith("@"):
                step.capture = token[1:]
        return step

    def node() -> Step | None:
        if peek() == "[":
            take()
            step = Step("|")
            while peek() != "]":
                one = node()
                if one:
                    step.options.append(one)
            take("]")
            return after(step)
        if peek().startswith('"'):
            return after(Step(take()))
        if peek() == "_":
            take()
            return after(Step("_"))
        take("(")
        if peek().startswith("#"):
            test, args = take(), []
            while peek() != ")":
                args.append(take())
            take(")")
            if test not in ("#eq?", "#not-eq?", "#match?", "#not-match?") or len(args) != 2:
                raise ValueError(f"unknown predicate {test}")
            tests.append((test, *args))
            return None
        if peek() == "(":  # a group with its predicates
            inner = None
            while peek() != ")":
                one = node()
                inner = inner or one
            take(")")
            return after(inner) if inner else None
        step = Step(take())
        anchored = False
        while peek() != ")":
            if peek() == ".":
                take()
                anchored = True
                continue
            name = take()[:-1] if peek().endswith(":") else ""
            child = node()
            if child:
                child.name, child.anchored = name, anchored
                step.children.append(child)
            anchored = False
        take(")")
        return after(step)

    steps = []
    while pos < len(tokens):
        one = node()
        if one:
            steps.append(one)
    if not steps:
        raise ValueError("no pattern")
    return Query(steps, tests)


def _bind(step: Step, node: Node, raw: bytes) -> Iterator[dict[str, Node]]:
    if step.kind == "|":
        for option in step.options:
            for found in _bind(option, node, raw):
                yield {**found, **({step.capture: node} if step.capture else {})}
        return
    if step.kind.startswith('"'):
        if text_of(node, raw) != step.kind[1:-1]:
            return
    elif step.kind not in ("_", node.kind):
        return

    def rest(k: int, first: int, found: dict[str, Node]) -> Iterator[dict[str, Node]]:
        if k == len(step.children):
            yield found
            return
        want = step.children[k]
        for i in range(first, len(node.children)):
            name, child = node.children[i]
            if want.name and want.name != name:
                continue
            for own in _bind(want, child, raw):
                yield from rest(k + 1, 0 if want.name else i + 1, {**found, **own})
            if want.anchored:
                return

    yield from rest(0, 0, {step.capture: node} if step.capture else {})


def run_query(query: Query, tree: Node, raw: bytes) -> Iterator[dict[str, Node]]:
    """Captures of each match, in the order of nodes."""

    def value(arg: str, found: dict[str, Node]) -> str:
        return text_of(found[arg[1:]], raw) if arg.startswith("@") and arg[1:] in found else arg[1:-1].encode().decode("unicode_escape") if arg.startswith('"') else ""

    for node in tree.all():
        for step in query.steps:
            for found in _bind(step, node, raw):
                ok = True
                for test, a, b in query.tests:
                    x = value(a, found)
                    same = re.search(b[1:-1].replace("\\\\", "\\"), x) is not None if "match" in test else x == value(b, found)
                    ok = ok and same != ("not" in test)
                if ok:
                    yield found


def primary(found: dict[str, Node]) -> Node:
    """The node that a finding stands at: the last named vuln, sink or danger, else the first."""
    named = [n for c, n in found.items() if c in ("vuln", "sink", "danger")]
    return named[-1] if named else next(iter(found.values()))


OUT = "path string, rule_id string, pattern_ord int, line int, column int, snippet string, metavars map<string,string>"


def matches(files: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    """OUT of the syntax patterns of `rules` over files (path, language, content)."""
    wanted = [(r["id"], n, p[2] or p[1], [x.lower() for x in r["languages"]]) for r in rules for n, p in enumerate(r["patterns"]) if p[0] in ("ast-query", "ast")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(rule, n, compile_query(q), spoken) for rule, n, q, spoken in wanted]
        for batch in batches:
            out: list[tuple] = []
            for path, language, content in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content"))):
                own = [c for c in compiled if not c[3] or "*" in c[3] or language in c[3]]
                tree = parse(content or "", language) if own else None
                if tree is None:
                    continue
                raw = content.encode("utf-8", "surrogatepass")
                for rule, n, query, _ in own:
                    for found in run_query(query, tree, raw):
                        if not found:
                            continue
                        at = primary(found)
                        lines = text_of(at, raw).split("\n")
                        snippet = "\n".join(lines[:3]) + ("\n..." if len(lines) > 3 else "")
                        before = raw[: at.start]
                        out.append((path, rule, n, before.count(b"\n") + 1, at.start - (before.rfind(b"\n") + 1) + 1, snippet, [(c, text_of(v, raw)) for c, v in found.items()]))
            types = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, types)], names=["path", "rule_id", "pattern_ord", "line", "column", "snippet", "metavars"])

    return files.select("path", "language", "content").mapInArrow(run, OUT)


def as_findings(found: DataFrame, rules: list[dict[str, Any]], phase: int, confidence_score: float = 0.0) -> DataFrame:
    """OUT with what findings take from their rule."""
    from .match import quality_of

    known = found.sparkSession.createDataFrame(
        [(r["id"], r["name"], r["severity"], r["category"], r["cwe"], r["message"], r["references"], r["confidence"], quality_of(r), r["rule_ord"]) for r in rules],
        "rule_id string, rule_name string, severity string, category string, cwe string, template string, references array<string>, confidence string, quality_score int, rule_ord int",
    )
    out = found.join(F.broadcast(known), "rule_id")
    return out.select(
        "rule_id", "rule_name", "severity", "category", "cwe", fill(F.col("template"), F.col("metavars")).alias("message"), F.col("path").alias("file"), "line", "column", "snippet",
        F.lit(False).alias("fix_available"), "references", "confidence", F.lit(confidence_score).alias("confidence_score"), "quality_score", "metavars", F.lit(phase).alias("phase"), "rule_ord", "pattern_ord",
    )


def findings(files: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    return as_findings(matches(described(files), rules), rules, 1)

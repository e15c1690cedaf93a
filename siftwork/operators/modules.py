"""Imports and exports as edges between files, resolution of imports, and tainted exports."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension
from .match import span

# Endings that an import may leave out, in the order they are tried; input sources.
EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".go", ".py")
INDEX = (".js", ".jsx", ".ts", ".tsx", ".mjs")
SOURCES = (
    r"req\.body", r"req\.params", r"req\.query", r"req\.headers", r"process\.argv", r"os\.Args", r"r\.FormValue", r"r\.URL\.Query",
    r"input\(", r"sys\.stdin", r"request\.(get_json|json|args|form)",
)
IMPORTS = "path, line_no, source, names"
KINDS = {
    "js": (".js", ".jsx", ".ts", ".tsx", ".mjs"), "go": (".go",), "py": (".py",), "java": (".java",), "cs": (".cs",),
}


#: Words after which a name is declared, and those that begin a type's own declaration.
JS_DECLARES, GO_DECLARES, PY_DECLARES = ("const", "let", "var", "function"), ("func", "var", "const", "type"), ("def", "class")
TYPES = {"java": ("class", "interface", "enum", "record"), "cs": ("class", "interface", "struct", "enum")}
NONE = "array<string>"


def _of(df: DataFrame, kind: str) -> DataFrame:
    return df.where(extension(F.col("path")).isin(*KINDS[kind]))


def _read(lines: DataFrame, text: Column, read: Callable[[Column], Column], name: str) -> DataFrame:
    """`lines` with `name`, which `read` makes of `text`, where it is not null; both are evaluated once a line."""
    return lines.withColumn(name, F.explode_outer(F.transform(F.array(text), read))).where(F.col(name).isNotNull())


def _tokens(text: Column) -> Column:
    """A line's quoted strings, words and single signs."""
    return F.regexp_extract_all(text, F.lit(r"""'[^']*'|"[^"]*"|\w+|\S"""), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def _list(tokens: Column) -> Column:
    """Tokens between commas, each joined to a name; `as` stays in it."""
    return F.filter(F.transform(F.split(F.array_join(tokens, " "), ","), lambda x: F.trim(x)), lambda x: x != "")


def _cut(tokens: Column, first: Column, last: Column) -> Column:
    """Tokens from place `first` to place `last`, counted from 1; none if they cross."""
    return F.when(last >= first, F.slice(tokens, first, F.greatest(last - first + 1, F.lit(0)))).otherwise(F.array().cast(NONE))


def _quoted(token: Column) -> Column:
    """What a quoted token holds, null for others and for nothing."""
    inside = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(token.startswith("'") | token.startswith('"'), F.when(inside != "", inside))


def _bound(tokens: Column) -> Column:
    """The names that a binding makes: `{a, b as c}`, `* as a`, `a`."""
    inner = F.filter(tokens, lambda x: ~x.isin("{", "}"))
    return F.when(F.get(tokens, F.lit(0)) == "*", _cut(tokens, F.lit(3), F.lit(3))).otherwise(_list(inner))


def _js_import(t: Column) -> Column:
    """`import ... from 'x'`, `import 'x'`, and `const ... = require('x')`: (source, names)."""
    start, source = F.array_position(t, "import").cast("int"), F.array_position(t, "from").cast("int")
    bare = _quoted(F.get(t, start))
    named = F.when(source > start, _quoted(F.get(t, source)))
    call = F.array_position(t, "require").cast("int")
    loaded = F.when((F.get(t, call) == "(") & (F.get(t, call + 2) == ")") & (F.get(t, F.greatest(call - 2, F.lit(0))) == "="), _quoted(F.get(t, call + 1)))
    # What stands before the sign, from the word that declares it.
    head = _cut(t, F.lit(1), call - 2)
    begin = F.greatest(*[F.array_position(head, w) for w in ("const", "let", "var")]).cast("int")
    imported = F.struct(F.coalesce(bare, named).alias("source"), F.when(bare.isNotNull(), F.array().cast(NONE)).otherwise(_bound(_cut(t, start + 1, source - 1))).alias("names"))
    required = F.struct(loaded.alias("source"), _bound(_cut(head, begin + 1, F.size(head))).alias("names"))
    return F.when((start > 0) & F.coalesce(bare, named).isNotNull(), imported).when((call > 3) & loaded.isNotNull() & (begin > 0), required)


def _py_import(text: Column) -> Column:
    """`from a import b, c` and `import a, b`, up to a comment; the first module of a plain one is its source."""
    w = _words(F.substring_index(text, "#", 1))
    at = F.array_position(w, "import").cast("int")
    names = _list(_cut(w, at + 1, F.size(w)))
    source = F.when(F.get(w, F.greatest(at - 3, F.lit(0))) == "from", F.get(w, F.greatest(at - 2, F.lit(0))))
    source = F.when(at >= 3, source)
    return F.when((at > 0) & (F.size(names) > 0), F.struct(F.coalesce(source, F.get(names, F.lit(0))).alias("source"), names.alias("names")))


def _dotted_import(text: Column, word: str) -> Column:
    """A line that begins with `word`, perhaps `static`, and a dotted name up to a semicolon."""
    w = F.filter(_words(F.substring_index(text, ";", 1)), lambda x: x != "static")
    plain = text.startswith(word) & F.contains(text, F.lit(";")) & (F.size(w) == 2) & (F.get(w, F.lit(0)) == word)
    name = F.get(w, F.lit(1))
    return F.when(plain & (F.regexp_replace(name, r"[\w.*]", "") == ""), F.struct(name.alias("source"), F.array().cast(NONE).alias("names")))


def imports(lines: DataFrame, files: DataFrame) -> DataFrame:
    """path, line_no (null for Go), source, names of every import. Lines are read by their tokens, the first statement of each."""
    text = F.col("text")
    # Only lines that hold the word that each form needs are taken apart.
    by_kind = {
        "js": (F.contains(text, F.lit("import")) | F.contains(text, F.lit("require")), _tokens(text), _js_import), "py": (F.contains(text, F.lit("import")), text, _py_import),
        "java": (text.startswith("import"), text, lambda x: _dotted_import(x, "import")), "cs": (text.startswith("using"), text, lambda x: _dotted_import(x, "using")),
    }
    out = None
    for kind, (may, value, read) in by_kind.items():
        found = _read(_of(lines, kind).where(may), value, read, "i").select("path", "line_no", "i.source", "i.names")
        out = found if out is None else out.unionByName(found)
    # Go's first block: of what its quotes part, every other piece.
    block = F.substring_index(F.get(F.split("content", r"import\s+\("), F.lit(1)), ")", 1)
    inside = F.filter(F.split(block, '"'), lambda x, i: (i % 2 == 1) & (x != ""))
    go = _of(files, "go").select("path", F.explode(inside).alias("source"))
    return out.unionByName(go.select("path", F.lit(None).cast("int").alias("line_no"), "source", F.array().cast(NONE).alias("names")))


def _name(word: Column) -> Column:
    """The letters, digits and underscores that a word begins with."""
    return F.regexp_extract(word, r"^\w+", 0)


def _js_export(t: Column) -> Column:
    at, member = F.array_position(t, "export").cast("int"), F.array_position(t, "exports").cast("int")
    after = F.get(t, at)
    declared = F.when(after.isin(*JS_DECLARES), F.nullif(_name(F.get(t, at + 1)), F.lit("")))
    put = F.when((F.get(t, member) == ".") & (F.get(t, member + 2) == "="), F.get(t, member + 1))
    return F.when((at > 0) & declared.isNotNull(), declared).when((at > 0) & (after == "default"), "default").when(member > 0, put)


def _declared(text: Column, words: tuple[str, ...]) -> Column:
    """The name after one of `words` at the beginning of a line."""
    w = F.split(text, r"\s+")
    return F.when(F.get(w, F.lit(0)).isin(*words), _name(F.get(w, F.lit(1))))


def _member(text: Column, types: tuple[str, ...], signs: str) -> Column:
    """The last word before a parameter list, value, body or end, of a public member with a type."""
    head = F.get(F.split(text, "[(={;]"), F.lit(0))
    w = F.filter(_words(head), lambda x: x != "static")
    fits = (F.get(w, F.lit(0)) == "public") & ~F.get(w, F.lit(1)).isin(*types) & (F.size(w) >= 3) & (F.translate(F.regexp_replace(head, r"\w|\s", ""), signs, "") == "")
    return F.when(fits, _name(F.element_at(w, -1)))


def exports(lines: DataFrame, files: DataFrame) -> DataFrame:
    """path, line_no, name of every export."""
    text, name = F.col("text"), F.col("name")
    out = None
    begins = lambda words: reduce(operator.or_, [text.startswith(w) for w in words])
    for kind, may, value, read, keep in (
        ("js", F.contains(text, F.lit("export")), _tokens(text), _js_export, F.lit(True)),
        ("go", begins(GO_DECLARES), text, lambda x: _declared(x, GO_DECLARES), F.substring(name, 1, 1).between("A", "Z")),
        ("py", begins(PY_DECLARES), text, lambda x: _declared(x, PY_DECLARES), ~name.startswith("_")),
        ("java", F.contains(text, F.lit("public")), text, lambda x: _member(x, TYPES["java"], "<>,[]"), F.lit(True)),
        ("cs", F.contains(text, F.lit("public")), text, lambda x: _member(x, TYPES["cs"], "<>,[]?"), F.lit(True)),
    ):
        found = _read(_of(lines, kind).where(may), value, read, "name").select("path", "line_no", "name").where("name <> ''").where(keep)
        out = found if out is None else out.unionByName(found)
    # An object that is exported whole may span lines; its names stand where it is first mentioned.
    pieces = F.split("content", r"module\.exports")
    given = F.filter(F.transform(pieces, lambda x: F.ltrim(F.regexp_replace(x, r"\s+", " "))), lambda x, i: (i > 0) & F.replace(x, F.lit(" "), F.lit("")).startswith("={") & F.contains(x, F.lit("}")))
    body = F.substring_index(F.substring_index(F.get(given, F.lit(0)), "}", 1), "{", -1)
    at = F.size(F.split(F.get(pieces, F.lit(0)), "\n"))
    whole = _of(files, "js").select("path", at.alias("line_no"), F.explode(F.split(body, ",")).alias("one"))
    whole = whole.select("path", "line_no", F.trim(F.substring_index("one", ":", 1)).alias("name")).where("name <> ''")
    return out.unionByName(whole)


def joined(folder: Column, relative: Column) -> Column:
    """A clean path of `relative` below `folder`: single points and what double points take back are gone."""
    parts = F.filter(F.split(F.concat(folder, F.lit("/"), relative), "/"), lambda x: ~x.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when((x == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.when(folder.startswith("/"), "/").otherwise(""), F.array_join(up, "/"))


def resolved(found: DataFrame, modules: DataFrame) -> DataFrame:
    """Relative imports with `target`, the module they name: as it stands, with an ending, or as an index file."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    base = joined(folder, F.col("source"))
    asked = found.where(F.col("source").startswith(".")).withColumn("_base", base)
    # A module under every name that it may be asked by: its own, without its ending, without its index file.
    target = F.col("target")
    cut = lambda e, n: F.when(target.endswith(e), F.struct(F.substring(target, F.lit(1), F.length(target) - len(e)).alias("_base"), F.lit(n).alias("_nth")))
    short = F.coalesce(*[cut(e, n) for n, e in enumerate(EXTENSIONS, 1)])
    index = F.coalesce(*[cut("/index" + e, n) for n, e in enumerate(INDEX, len(EXTENSIONS) + 1)])
    names = F.array_compact(F.array(F.struct(target.alias("_base"), F.lit(0).alias("_nth")), short, index))
    hits = asked.join(modules.select(F.col("path").alias("target")).select("target", F.inline(names)), "_base")
    order = Window.partitionBy("path", "source", "line_no").orderBy("_nth")
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*found.columns, "target")


def tainted_exports(found: DataFrame, files: DataFrame) -> DataFrame:
    """Exports with an input source in the five lines up to theirs or the five after."""
    pattern = "|".join(f"(?:{s})" for s in SOURCES)
    # No pattern spans lines or is tied to a line's ends, so files without a match have no line with one.
    some = files.where(F.col("content").rlike(pattern))
    near = found.join(some.select("path", F.split("content", "\n").alias("lines")), "path")
    return near.where(F.exists(span(F.col("lines"), F.col("line_no") - 4, F.col("line_no") + 5), lambda x: x.rlike(pattern))).drop("lines")


def tainted_names(found: DataFrame, modules: DataFrame, tainted: DataFrame) -> DataFrame:
    """path, name, module: imported names that another file taints, bare and after their module."""
    rows = resolved(found, modules).select("path", "target", "source", F.explode("names").alias("name"))
    t = tainted.select(F.col("path").alias("target"), F.col("name").alias("_name")).distinct()
    hit = rows.join(t, (rows["target"] == t["target"]) & ((F.col("name") == F.col("_name")) | (F.col("_name") == "default")))
    return hit.select("path", F.explode(F.array("name", F.concat_ws(".", F.regexp_extract("source", r"([^/.]+)[^/]*$", 1), "name"))).alias("name"), rows["target"].alias("module")).distinct()

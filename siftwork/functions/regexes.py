"""Patterns in the RE2 dialect, rewritten for Java's engine and for Python's."""

from __future__ import annotations

import re
from dataclasses import dataclass

LOOKAROUND = re.compile(r"\(\?<?[=!]")
NAMED = re.compile(r"\(\?P?<([A-Za-z_]\w*)>")


@dataclass(frozen=True)
class Pattern:
    """A pattern with its group names, as (name, number), in order."""

    source: str
    java: str
    python: str
    groups: tuple[tuple[str, int], ...]
    #: RE2 has no look-around.
    backtracks: bool


def _classes(source: str) -> str:
    """Escape what means something inside a class to Java alone: an opening bracket and `&&`."""
    out, inside, at = [], False, 0
    while at < len(source):
        c = source[at]
        if c == "\\":
            out.append(source[at : at + 2])
            at += 2
            continue
        if inside and c == "[" and not source.startswith("[:", at):
            out.append("\\[")
        elif inside and source.startswith("&&", at):
            out.append("\\&\\&")
            at += 1
        elif inside and c == "[":
            end = source.index(":]", at) + 2
            name = source[at + 2 : end - 2]
            out.append({"alpha": "a-zA-Z", "digit": "0-9", "alnum": "a-zA-Z0-9", "upper": "A-Z", "lower": "a-z", "space": r"\t\n\x0B\f\r ", "word": r"\w", "xdigit": "0-9A-Fa-f", "punct": r"!-/:-@\[-`{-~"}[name])
            at = end - 1
        else:
            out.append(c)
            if c == "[" and not inside:
                inside = True
                if source.startswith("^", at + 1):
                    out.append("^")
                    at += 1
                if source.startswith("]", at + 1):
                    out.append("\\]")
                    at += 1
            elif c == "]" and inside:
                inside = False
        at += 1
    return "".join(out)


def translate(source: str) -> Pattern:
    """Rewrite `source`; raises re.error where Python can't compile it."""
    body = _classes(source)
    compiled = re.compile(NAMED.sub(lambda m: f"(?P<{m[1]}>", body), re.ASCII)
    # Java's names hold no underscore; names are kept beside.
    java = NAMED.sub(lambda m: f"(?<{m[1].replace('_', 'U')}>", body)
    java = "(?d)" + java.replace(r"\z", r"\z")
    return Pattern(source, java, compiled.pattern, tuple(sorted(compiled.groupindex.items(), key=lambda x: x[1])), bool(LOOKAROUND.search(source)))


def glob(pattern: str) -> str:
    """A file name pattern as a Java expression: `*` and `?` stop at a slash, there is no `**`."""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and "]" in pattern[at + 2 :]:
            end = pattern.index("]", at + 2)
            out.append("[" + pattern[at + 1 : end].replace("\\", "\\\\") + "]")
            at = end
        elif c == "\\" and at + 1 < len(pattern):
            at += 1
            out.append(re.escape(pattern[at]))
        else:
            out.append(re.escape(c))
        at += 1
    return "^" + "".join(out) + "$"


def literal(source: str) -> str | None:
    """A lower-case string that every match holds, or None if none is plain to see; a cheap test before the pattern."""
    if "|" in source:
        return None
    plain = re.sub(r"\(\?[a-zA-Z]+\)", "", source)
    best, run, at, depth = "", "", 0, 0
    while at <= len(plain):
        c = plain[at] if at < len(plain) else ""
        following = plain[at + 1] if at + 1 < len(plain) else ""
        if c and (c.isalnum() or c in " _-=<>'\"/,:;@#%&!~`") and c.isascii() and depth == 0:
            if following and following in "*?{":
                c = ""
            else:
                run += c.lower()
                if following == "+":
                    best, run = max(best, run, key=len), ""
                at += 1
                continue
        best, run = max(best, run, key=len), ""
        here = plain[at] if at < len(plain) else ""
        if here == "\\":
            escaped = plain[at + 1 : at + 2]
            if escaped and not escaped.isalnum() and depth == 0 and plain[at + 2 : at + 3] not in ("*", "?", "{"):
                run = escaped
            at += 2
            continue
        if here == "[":
            end = plain.find("]", at + 2)
            at = end + 1 if end > 0 else len(plain) + 1
            continue
        if here == "{":
            end = plain.find("}", at)
            at = end + 1 if end > 0 else at + 1
            continue
        depth += (here == "(") - (here == ")")
        at += 1
    return best if len(best) >= 3 else None

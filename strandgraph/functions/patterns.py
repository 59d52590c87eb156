"""Patterns: literal prefixes of expressions, refused syntax, ignore files."""

from __future__ import annotations

import re

from strandgraph.schema import GraphError

_META = set("\\.+*?()|[]{}^$")


def literal_prefix(pattern: str) -> str:
    """The literal text that every match of ``pattern`` begins with, after an
    optional "^"; "" where there is none. A character that "*", "?" or "{" makes
    optional is not part of it."""
    body = pattern[1:] if pattern.startswith("^") else pattern
    out = ""
    for c in body:
        if c in _META:
            return out[:-1] if c in "*?{" else out
        out += c
    return out


def pushable_prefix(pattern: str) -> str:
    """A prefix that may be pushed down: only of anchored patterns without
    alternatives."""
    if not pattern.startswith("^") or "|" in pattern or "(?" in pattern:
        return ""
    return literal_prefix(pattern)


def checked(pattern: str) -> str:
    """``pattern`` if it is regular; look-around and back-references are not."""
    if re.search(r"\(\?(?:=|!|<=|<!|>)|\\[1-9]|\\k<|[*+?}]\+", pattern):
        raise GraphError("invalid_argument", "look-around, back-references and possessive quantifiers are not supported")
    try:
        re.compile(pattern)
    except re.error as e:
        raise GraphError("invalid_argument", f"bad pattern: {e}") from e
    return pattern


class Ignore:
    """Rules of ignore files, later ones first; ``base`` is the folder of a file."""

    def __init__(self):
        self.rules: list[tuple[str, re.Pattern, bool, bool]] = []

    def add(self, text: str, base: str = "") -> Ignore:
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[1:] if negated else line.removeprefix("\\")
            folder = line.endswith("/")
            line = line.rstrip("/")
            if line:
                self.rules.append((base, glob(line), negated, folder))
        return self

    def decides(self, path: str, is_dir: bool) -> bool | None:
        for base, rule, negated, folder in reversed(self.rules):
            inner = path if not base else path[len(base) + 1 :] if path.startswith(base + "/") else None
            if inner is not None and (is_dir or not folder) and rule.fullmatch(inner):
                return not negated
        return None

    def excluded(self, path: str, is_dir: bool = False) -> bool:
        """Whether the path or a folder above it is ignored; ".git" always is."""
        parts = path.split("/")
        if ".git" in parts:
            return True
        for i in range(1, len(parts) + 1):
            if self.decides("/".join(parts[:i]), is_dir or i < len(parts)):
                return True
        return False


def glob(line: str) -> re.Pattern:
    """The expression of one ignore rule."""
    anchored = "/" in line
    line = line.removeprefix("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.+", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            body = line[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif line[i] == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(line[i]), i + 1
    return re.compile(out if anchored else "(?:.*/)?" + out)

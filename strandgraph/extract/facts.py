"""What is extracted from one file."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Verbs of routes, calls that register a route without a verb in
# their name, and calls that open a group of routes.
HTTP_VERBS = ("get", "post", "put", "delete", "patch", "head", "options", "all")
ROUTE_REGISTRARS = ("route", "handlefunc", "handle", "add_route")
ROUTE_GROUPERS = ("group", "party")
SIGNATURE = 200


@dataclass
class Facts:
    """definitions: (label, name, qualified_name, start_line, end_line, signature,
    returns); calls: (from, callee, receiver, line, character); imports: (target,
    line); relations: (subtype, supertype, edge_type, line); routes: (method,
    path, handler, handler_receiver, line, end_line, framework); bindings:
    (variable, constructor); errors: (first line, last line)."""

    definitions: list = field(default_factory=list)
    calls: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    relations: list = field(default_factory=list)
    routes: list = field(default_factory=list)
    bindings: list = field(default_factory=list)
    errors: list = field(default_factory=list)

    def tidy(self) -> Facts:
        for name in ("definitions", "calls", "imports", "relations", "routes", "bindings", "errors"):
            setattr(self, name, list(dict.fromkeys(getattr(self, name))))
        return self


def module_prefix(path: str) -> str:
    stem = re.sub(r"\.[^.]*$", "", path)
    parts = [p for p in stem.split("/") if p not in ("", ".")]
    return ".".join(parts[:-1] if parts and parts[-1] in ("__init__", "index", "mod") else parts)


def signature(line: str) -> str:
    return line.strip().rstrip("{:").rstrip()[:SIGNATURE]


def unquote(s: str) -> str:
    return s[1:-1] if len(s) > 1 and s[0] == s[-1] and s[0] in "\"'`" else s


def joined(*parts: str) -> str:
    return ".".join(p for p in parts if p)


def column16(line: str, at: int) -> int:
    """A column in UTF-16 units."""
    return len(line[:at].encode("utf-16-le", "surrogatepass")) // 2


def join_route(prefix: str | None, path: str) -> str:
    prefix = (prefix or "").rstrip("/")
    return path if not prefix else prefix if path in ("", "/") else prefix + path


def route_method(name: str) -> str | None:
    """The verb that a registration's name says, "ANY" for a registrar, or None."""
    name = name.lower()
    name = name[4:] if name.startswith("http") and name[4:] in HTTP_VERBS else name
    return name.upper() if name in HTTP_VERBS else "ANY" if name in ROUTE_REGISTRARS else None


FRAMEWORKS = {"python": "decorator", "go": "router", "rust": "builder", "csharp": "attribute"}


def framework(language: str) -> str:
    return FRAMEWORKS.get(language, "router")

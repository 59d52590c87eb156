"""Shell, configuration, build files and markup, read by lines or tags."""

from __future__ import annotations

import posixpath
import re
from html.parser import HTMLParser

from strandgraph.extract.facts import Facts, column16, joined, module_prefix, signature, unquote


def _relative(path: str, target: str) -> str:
    """A relative include from the file's folder; as written where it is
    absolute, has variables, or leaves the repository."""
    if target.startswith("/") or "$" in target or target.startswith("~"):
        return target
    full = posixpath.normpath(posixpath.join(posixpath.dirname(path), target))
    return target if full.startswith("..") else full


def _sections(path: str, text: str, section: re.Pattern, pair: re.Pattern) -> Facts:
    out, prefix, lines = Facts(), module_prefix(path), text.split("\n")
    current, opened = "", []
    for i, line in enumerate(lines, 1):
        if m := section.match(line):
            current = m[1].strip().strip("[]").strip()
            opened.append([current, i, i])
        elif m := pair.match(line):
            out.definitions.append(("Field", unquote(m[1]), joined(prefix, current, unquote(m[1])), i, i, signature(line), None))
        if line.strip() and opened:
            opened[-1][2] = i
    out.definitions += [("Module", n, joined(prefix, n), a, z, signature(lines[a - 1]), None) for n, a, z in opened]
    return out.tidy()


def toml(path: str, text: str) -> Facts:
    return _sections(path, text, re.compile(r"^\s*(\[.*\])\s*(?:#.*)?$"), re.compile(r"""^\s*([\w.-]+|"[^"]*"|'[^']*')\s*="""))


def ini(path: str, text: str) -> Facts:
    return _sections(path, text, re.compile(r"^\s*(\[[^\]]*\])\s*$"), re.compile(r"^([^\s#;\[=:][^=:]*?)\s*[=:]"))


_YAML = re.compile(r"""^(\s*)(?:- +)?("[^"]*"|'[^']*'|[^\s#\-?:,\[\]{}&*!|>'"%@`][^:#]*?)\s*:(?:\s+(.*))?$""")


def yaml(path: str, text: str) -> Facts:
    out, prefix, lines = Facts(), module_prefix(path), text.split("\n")
    stack, block = [], None
    rows = []
    for i, line in enumerate(lines, 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        if block is not None and depth > block:
            if rows:
                rows[-1][4] = i
            continue
        block = None
        m = _YAML.match(line)
        for s in stack:
            if depth > s[0]:
                rows[s[2]][4] = i
        if not m:
            continue
        depth = len(m[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        name, value = unquote(m[2].strip()), (m[3] or "").split(" #")[0].strip()
        rows.append(["Field" if value and value[0] not in "|>&" else "Module", name, joined(prefix, *[s[1] for s in stack], name), i, i, signature(line), None])
        if value[:1] in ("|", ">"):
            rows[-1][0], block = "Field", depth
        elif not value or value[0] == "&":
            stack.append((depth, name, len(rows) - 1))
    out.definitions = [tuple(r) for r in rows]
    return out.tidy()


_SH_DEF = re.compile(r"^\s*(?:function\s+([\w:.-]+)\s*(?:\(\s*\))?|([\w:.-]+)\s*\(\s*\))\s*(\{)?")
_SH_WORDS = frozenset("if then else elif fi for while until do done case esac in function select time return exit break continue local export readonly declare set unset shift trap eval exec test true false echo printf cd read { } [ [[ ! :".split())


def bash(path: str, text: str) -> Facts:
    out, prefix, lines, stack = Facts(), module_prefix(path), text.split("\n"), []
    here_doc = None
    for i, raw in enumerate(lines, 1):
        if here_doc:
            here_doc = None if raw.strip() == here_doc else here_doc
            continue
        if m := re.search(r"<<-?\s*[\"']?(\w+)", raw):
            here_doc = m[1]
        line = re.sub(r"(^|\s)#.*$", "", raw)
        m = _SH_DEF.match(line)
        if m and (m[1] or m[2]) not in _SH_WORDS:
            name = m[1] or m[2]
            stack.append([name, i, 0])
            out.definitions.append(["Function", name, joined(prefix, *[s[0] for s in stack]), i, i, signature(raw), None])
            stack[-1].append(len(out.definitions) - 1)
            line = line[m.end() - (1 if m[3] else 0) :]
        for part in re.split(r"[;&|]+|\$\(|`|\bthen\b|\bdo\b|\belse\b", line):
            w = part.strip().lstrip("{( ").split()
            while w and (re.fullmatch(r"\w+=\S*", w[0]) or w[0] in ("if", "while", "until", "elif", "!", "time")):
                w = w[1:]
            if not w:
                continue
            if w[0] in ("source", ".") and len(w) > 1:
                out.imports.append((_relative(path, unquote(w[1])), i))
            elif re.fullmatch(r"[A-Za-z_][\w.-]*", w[0]) and w[0] not in _SH_WORDS:
                out.calls.append((joined(prefix, *[s[0] for s in stack]), w[0], None, i, column16(raw, max(raw.find(w[0]), 0))))
        for c in line:
            if stack and c in "{}":
                stack[-1][2] += 1 if c == "{" else -1
                if stack[-1][2] <= 0 and c == "}":
                    d = stack.pop()
                    out.definitions[d[3]][4] = i
    out.definitions = [tuple(d) for d in out.definitions]
    return out.tidy()


_TARGET = re.compile(r"^([A-Za-z0-9_./%$(){}-][^:=#\t]*?)\s*::?(?!=)\s*([^#=]*)(?:#.*)?$")
_VARIABLE = re.compile(r"^(?:export\s+|override\s+)?([A-Za-z_][\w.-]*)\s*(?:\?|\+|:{1,3}|!)?=")


def make(path: str, text: str) -> Facts:
    out, prefix, lines = Facts(), module_prefix(path), text.split("\n")
    last = None
    for i, line in enumerate(lines, 1):
        if line.startswith("\t"):
            if last is not None:
                out.definitions[last][4] = i
            continue
        if m := re.match(r"^-?s?include\s+(.+)$", line):
            out.imports += [(_relative(path, x), i) for x in m[1].split("#")[0].split()]
        elif m := _VARIABLE.match(line):
            out.definitions.append(["Field", m[1], joined(prefix, m[1]), i, i, signature(line), None])
            last = None
        elif m := _TARGET.match(line):
            needs = [x for x in m[2].split(";")[0].split() if x != "|"]
            for name in m[1].split():
                out.definitions.append(["Function", name, joined(prefix, name), i, i, signature(line), None])
                last = len(out.definitions) - 1
                out.calls += [(joined(prefix, name), x, None, i, max(line.find(x, m.end(1)), 0)) for x in needs]
    out.definitions = [tuple(d) for d in out.definitions]
    return out.tidy()


_COMMAND = re.compile(r"(?im)^[ \t]*([A-Za-z_]\w*)[ \t]*\(\s*([^\s()]*)")


def cmake(path: str, text: str) -> Facts:
    out, prefix, stack = Facts(), module_prefix(path), []
    clean = re.sub(r"(?m)#.*$", lambda m: " " * len(m[0]), text)
    lines = text.split("\n")
    for m in _COMMAND.finditer(clean):
        name, first = m[1], m[2].strip('"')
        line = clean.count("\n", 0, m.start(1)) + 1
        low = name.lower()
        if low in ("function", "macro") and first:
            out.definitions.append(["Function", first, joined(prefix, *[s[0] for s in stack], first), line, line, signature(lines[line - 1]), None])
            stack.append((first, len(out.definitions) - 1))
        elif low in ("endfunction", "endmacro"):
            if stack:
                out.definitions[stack.pop()[1]][4] = line
        elif low in ("include", "add_subdirectory"):
            if first:
                out.imports.append((_relative(path, first), line))
        else:
            column = m.start(1) - (clean.rfind("\n", 0, m.start(1)) + 1)
            out.calls.append((joined(prefix, *[s[0] for s in stack]), name, None, line, column))
    out.definitions = [tuple(d) for d in out.definitions]
    return out.tidy()


_ASSETS = {"script": "src", "link": "href", "img": "src", "iframe": "src", "source": "src", "embed": "src"}


def shipped(target: str) -> str | None:
    t = target.strip()
    if not t or "{{" in t or t[0] == "#" or t.startswith("//") or "://" in t or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", t):
        return None
    return re.split(r"[?#]", t)[0].lstrip("/") or None


class _Page(HTMLParser):
    def __init__(self, path: str, text: str):
        super().__init__(convert_charrefs=True)
        self.prefix, self.out = module_prefix(path), Facts()
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        line, a = self.getpos()[0], dict(attrs)
        if a.get("id"):
            self.out.definitions.append(("Field", a["id"], joined(self.prefix, a["id"]), line, line, signature((self.get_starttag_text() or "").split("\n")[0]), None))
        if tag in _ASSETS and (target := shipped(a.get(_ASSETS[tag]) or "")):
            self.out.imports.append((target, line))

    handle_startendtag = handle_starttag


def html(path: str, text: str) -> Facts:
    return _Page(path, text).out.tidy()

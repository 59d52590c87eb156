"""Languages with braces, from a token stream: a reader that follows braces and
knows how each language writes definitions, imports and type relations. Calls
are names before a parenthesis; what is no clear definition is a call or
nothing, never a guess."""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

from strandgraph.extract.facts import HTTP_VERBS, ROUTE_GROUPERS, Facts, column16, framework, join_route, joined, module_prefix, route_method, signature, unquote


@dataclass(frozen=True)
class Syntax:
    types: dict  # keyword -> label of a type-like definition
    functions: tuple = ()  # keywords before a function's name
    methods_bare: bool = False  # name(...) { in a type is a method
    functions_bare: bool = False  # type name(...) { outside of types is a function
    hash_comments: bool = False
    strings: str = r'"(?:\\.|[^"\\\n])*"' + r"|'(?:\\.|[^'\\\n])*'"
    inherits: tuple = ()  # words before INHERITS names
    implements: tuple = ()
    colon_bases: str = ""  # "": none; else how ": A, B" after a type's name reads
    prototypes: bool = False


C_STRINGS = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])+\''
JS_STRINGS = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`'
_JS = {"class": "Class"}
_TS = {"class": "Class", "interface": "Interface", "enum": "Enum"}
SYNTAX = {
    "javascript": Syntax(_JS, ("function",), methods_bare=True, strings=JS_STRINGS, inherits=("extends",)),
    "typescript": Syntax(_TS, ("function",), methods_bare=True, strings=JS_STRINGS, inherits=("extends",), implements=("implements",)),
    "go": Syntax({}, ("func",), strings=r'"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])+\''),
    "rust": Syntax({"struct": "Struct", "enum": "Enum", "trait": "Trait", "mod": "Module"}, ("fn",), strings=r'b?r#*"[^"]*"#*|b?"(?:\\.|[^"\\])*"|b?\'(?:\\.[^\']*|[^\'\\\n])\''),
    "c": Syntax({"struct": "Struct", "enum": "Enum"}, functions_bare=True, strings=C_STRINGS, prototypes=True),
    "cpp": Syntax({"struct": "Struct", "enum": "Enum", "class": "Class", "namespace": "Module"}, methods_bare=True, functions_bare=True, strings=C_STRINGS, prototypes=True),
    "java": Syntax({"class": "Class", "interface": "Interface", "enum": "Enum"}, methods_bare=True, strings=C_STRINGS, inherits=("extends",), implements=("implements",), prototypes=True),
    "csharp": Syntax({"class": "Class", "interface": "Interface", "struct": "Struct", "enum": "Enum", "record": "Class", "namespace": "Module"}, methods_bare=True, strings=r'@"(?:""|[^"])*"|\$?' + C_STRINGS, colon_bases="csharp", prototypes=True),
    "kotlin": Syntax({"class": "Class", "object": "Class", "interface": "Class"}, ("fun",), strings=r'"""(?:.|\n)*?"""|' + C_STRINGS, colon_bases="kotlin"),
    "dart": Syntax({"class": "Class", "mixin": "Trait", "extension": "Class", "enum": "Enum"}, methods_bare=True, functions_bare=True, strings=r"r?'''(?:.|\n)*?'''|" + JS_STRINGS, inherits=("extends",), implements=("implements", "with")),
    "perl": Syntax({}, ("sub",), hash_comments=True),
}
ALIASES = {"jsx": "javascript", "tsx": "typescript"}

KEYWORDS = frozenset("""if for while switch catch return else do case sizeof typeof instanceof new delete throw await yield
function func fn fun super assert try finally constructor import require in is as not and or""".split())
OWN_KEYWORDS = {
    "go": frozenset("go defer select range map chan".split()), "rust": frozenset("match loop unsafe move".split()), "kotlin": frozenset("when".split()),
    "csharp": frozenset("using lock fixed foreach nameof checked unchecked".split()), "java": frozenset("synchronized".split()), "cpp": frozenset("static_assert decltype alignof".split()),
    "perl": frozenset("sub foreach unless until elsif my our local".split()), "dart": frozenset("with".split()),
}
MODIFIERS = frozenset("const noexcept override final volatile async sync throws virtual abstract external mutable where try".split())
_ID = r"[A-Za-z_$][\w$]*"


@dataclass
class Token:
    kind: str
    text: str
    at: int
    line: int


_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Words after which a slash begins a regular expression.
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do await yield instanceof".split())


def template_end(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """(end, expressions) of the template string that begins at ``at``."""
    parts, k = [], at + 1
    while k < len(text) and text[k] != "`":
        if text[k] == "\\":
            k += 2
        elif text.startswith("${", k):
            start, depth, k = k + 2, 1, k + 2
            while k < len(text) and depth:
                c = text[k]
                if c == "`":
                    k = template_end(text, k)[0]
                    continue
                if c in "\"'":
                    m = re.compile(JS_STRINGS).match(text, k)
                    k = m.end() if m else k + 1
                    continue
                depth += (c == "{") - (c == "}")
                k += 1
            parts.append((start, k - 1 if not depth else k))
        else:
            k += 1
    return min(k + 1, len(text)), parts


def tokenize(text: str, s: Syntax) -> tuple[list[Token], bool]:
    """Tokens without comments; whether strings and comments all end. In scripts a
    regular expression is one token, and expressions in templates are tokens."""
    comment = r"#[^\n]*" if s.hash_comments else r"//[^\n]*|/\*(?:.|\n)*?(?:\*/|\Z)"
    pattern = re.compile(rf"(?P<space>\s+)|(?P<comment>{comment})|(?P<str>{s.strings})|(?P<id>{_ID})|(?P<num>\d[\w.]*)|(?P<op>=>|->|::|\?\.|:=|[^\s\w])|(?P<other>.)", re.S)
    script = s.strings == JS_STRINGS
    out, whole, lines = [], True, [m.end() for m in re.finditer("\n", text)]

    def read(at: int, stop: int):
        nonlocal whole
        while at < stop:
            if script and text[at] == "`":
                end, parts = template_end(text, at)
                out.append(Token("str", text[at : parts[0][0] if parts else end], at, bisect_right(lines, at) + 1))
                for lo, hi in parts:
                    read(lo, min(hi, stop))
                at = end
                continue
            if script and text[at] == "/" and (not out or out[-1].kind == "op" and out[-1].text not in (")", "]", "}") or out[-1].text in _BEFORE_REGEX):
                if m := _REGEX.match(text, at):
                    out.append(Token("str", m[0], at, bisect_right(lines, at) + 1))
                    at = m.end()
                    continue
            m = pattern.match(text, at)
            kind, t = m.lastgroup, m[0]
            if kind == "comment" and t.startswith("/*") and not t.endswith("*/"):
                whole = False
            if kind not in ("space", "comment", "other"):
                out.append(Token(kind, t, at, bisect_right(lines, at) + 1))
            at = m.end()

    read(0, len(text))
    return out, whole


class Reader:
    def __init__(self, language: str, path: str, text: str):
        self.language, self.s = language, SYNTAX[ALIASES.get(language, language)]
        self.family = ALIASES.get(language, language)
        self.text, self.lines, self.prefix = text, text.split("\n"), module_prefix(path)
        self.t, whole = tokenize(text, self.s)
        self.out = Facts()
        if not whole:
            self.out.errors.append((1, len(self.lines)))
        self.match = self._brackets()
        self.scopes: list[list] = []  # [end token, label, name, is function, row]
        self.words = KEYWORDS | OWN_KEYWORDS.get(self.family, frozenset())
        self.groups: dict[str, str] = {}
        self.defined: set[int] = set()

    def _brackets(self) -> dict[int, int]:
        pair, stack, out = {")": "(", "]": "[", "}": "{"}, [], {}
        for i, t in enumerate(self.t):
            if t.kind != "op":
                continue
            if t.text in "([{":
                stack.append(i)
            elif t.text in pair:
                if stack and self.t[stack[-1]].text == pair[t.text]:
                    out[i], out[stack[-1]] = stack[-1], i
                    stack.pop()
                elif t.text == "}":
                    self.out.errors.append((t.line, t.line))
        for i in stack:
            if self.t[i].text == "{":
                self.out.errors.append((self.t[i].line, self.t[i].line))
                out[i] = len(self.t) - 1
        return out

    def tok(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def kind(self, i: int) -> str:
        return self.t[i].kind if 0 <= i < len(self.t) else ""

    def here(self) -> str:
        return joined(self.prefix, *[s[2] for s in self.scopes if s[2]])

    def inside(self) -> str:
        """"type", "function" or "" by the innermost scope."""
        return ("function" if self.scopes[-1][3] else "type" if self.scopes[-1][1] not in ("Module", "") or self.scopes[-1][4] else "") if self.scopes else ""

    def column(self, i: int) -> int:
        start = self.text.rfind("\n", 0, self.t[i].at) + 1
        return column16(self.text[start:], self.t[i].at - start)

    def define(self, label, name, i, end, owner="", function=False, returns=None):
        qn = joined(self.here(), owner, name)
        last = self.t[min(end, len(self.t) - 1)].line
        self.out.definitions.append((label, name, qn, self.t[i].line, last, signature(self.lines[self.t[i].line - 1]), returns))
        self.defined.add(i)
        self.scopes.append([end, label, joined(owner, name), function, True])

    def body(self, i: int, stop: str = ";") -> int | None:
        """The token of the brace that opens a body from ``i`` on, before ``stop``."""
        while i < len(self.t):
            x = self.tok(i)
            if x == "{":
                return i
            if x in (stop, "}") or x == "=" and stop == ";":
                return None
            i = self.match.get(i, i) + 1 if x in "([" and i in self.match else i + 1
        return None

    def run(self) -> Facts:
        i = 0
        while i < len(self.t):
            while self.scopes and i > self.scopes[-1][0]:
                self.scopes.pop()
            i = self.step(i)
        return self.out.tidy()

    def step(self, i: int) -> int:
        x, kind = self.tok(i), self.kind(i)
        if kind != "id":
            if x == "#" and self.family in ("c", "cpp") and self.tok(i + 1) == "include":
                line = self.lines[self.t[i].line - 1]
                if m := re.search(r'include\s*(?:"([^"]+)"|<([^>]+)>)', line):
                    self.out.imports.append((m[1] or m[2], self.t[i].line))
                return next((k for k in range(i, len(self.t)) if self.t[k].line > self.t[i].line), len(self.t))
            if x == "[" and self.family == "csharp":
                return self.attribute(i)
            return i + 1
        if (n := self.imports(i)) is not None:
            return n
        before = self.tok(i - 1)
        if before not in (".", "->", "?.") and (n := self.types(i, x)) is not None:
            return n
        if x in self.s.functions and before != ".":
            if (n := self.function(i)) is not None:
                return n
        if self.family in ("javascript", "typescript") and x in ("const", "let", "var") and self.kind(i + 1) == "id":
            if (n := self.arrow(i)) is not None:
                return n
        if self.family == "go" and self.tok(i + 1) == ":=":
            self.binding(i)
        if self.tok(i + 1) == "(" or self.tok(i + 1) == "<" and self.generic_call(i):
            return self.named(i, x)
        if self.family == "csharp" and self.inside() == "type" and self.tok(i + 1) == "{" and re.fullmatch("get|set|init", self.tok(i + 2)) and before not in ("class", "namespace"):
            self.out.definitions.append(("Field", x, joined(self.here(), x), self.t[i].line, self.t[self.match.get(i + 1, i + 1)].line, signature(self.lines[self.t[i].line - 1]), None))
            return self.match.get(i + 1, i + 1) + 1
        if self.family == "csharp" and self.inside() == "type" and self.tok(i + 1) == "=>" and (self.kind(i - 1) == "id" or before in (">", "]", "?")):
            end = next((k for k in range(i, len(self.t)) if self.tok(k) == ";"), i)
            self.field(i, end)
            return i + 2
        if self.family == "dart" and (n := self.dart(i, x)) is not None:
            return n
        return i + 1

    def field(self, i: int, end: int):
        self.out.definitions.append(("Field", self.tok(i), joined(self.here(), self.tok(i)), self.t[i].line, self.t[end].line, signature(self.lines[self.t[i].line - 1]), None))

    def dart(self, i: int, x: str) -> int | None:
        """Getters, type aliases, enum constants and fields."""
        after, inside = self.tok(i + 1), self.inside()
        if x == "typedef":
            end = next((k for k in range(i, len(self.t)) if self.tok(k) == ";"), len(self.t) - 1)
            equals = next((k for k in range(i, end) if self.tok(k) == "="), None)
            head = range(i + 1, end) if equals is None else range(i + 1, equals)
            name = next((k for k in head if self.kind(k) == "id" and self.tok(k + 1) in ("(", "<", "=") and (equals is not None or self.tok(k + 1) == "(")), None)
            if name is not None:
                self.define("Type", self.tok(name), name, end)
                self.scopes.pop()
            return end + 1
        if x == "get" and self.kind(i + 1) == "id" and self.tok(i + 2) in ("=>", "{", "async", ";") and inside != "function":
            k = i + 2 + (self.tok(i + 2) == "async")
            end = self.match.get(k, k) if self.tok(k) == "{" else next((m for m in range(k, len(self.t)) if self.tok(m) == ";"), len(self.t) - 1)
            self.define("Method" if inside == "type" else "Function", self.tok(i + 1), i + 1, end, "", True)
            return k + 1
        if inside != "type" or i in self.defined:
            return None
        before = self.tok(i - 1)
        if self.scopes[-1][1] == "Enum" and (before == "{" or before == ",") and after in (",", "}", ";", "("):
            end = self.match.get(i + 1, i + 1) if after == "(" else i
            self.field(i, end)
            return end + 1
        typed = self.kind(i - 1) == "id" and before not in ("class", "extends", "with", "on", "implements", "return", "new") or before in (">", "?")
        if typed and after in (";", "="):
            end = next((m for m in range(i, len(self.t)) if self.tok(m) == ";"), i)
            self.field(i, end)
            return i + 2
        return None

    def generic_call(self, i: int) -> bool:
        if self.family not in ("typescript", "java", "csharp", "kotlin", "dart", "rust", "cpp"):
            return False
        m = re.compile(r"<[\w\s,.<>\[\]?:&*]*>\s*\(").match(self.text, self.t[i + 1].at)
        return bool(m) and "\n" not in m[0]

    def imports(self, i: int) -> int | None:
        x, f, line = self.tok(i), self.family, self.t[i].line
        start = i == 0 or self.t[i - 1].line < line or self.tok(i - 1) in ";{}"
        if not start:
            return None
        to_end = lambda: next((k for k in range(i, len(self.t)) if self.tok(k) == ";"), len(self.t) - 1)
        if f in ("javascript", "typescript") and x in ("import", "export"):
            for k in range(i + 1, min(i + 400, len(self.t))):
                if self.kind(k) == "str" and (self.tok(k - 1) in ("from", "import")):
                    self.out.imports.append((unquote(self.tok(k)), line))
                    return k + 1
                if self.tok(k) in (";", "(", "=", "class", "function", "const") or x == "export" and self.tok(i + 1) not in ("{", "*", "type"):
                    return None
        elif f == "go" and x == "import":
            if self.tok(i + 1) == "(":
                end = self.match.get(i + 1, len(self.t) - 1)
                self.out.imports += [(unquote(t.text), t.line) for t in self.t[i + 1 : end] if t.kind == "str"]
                return end + 1
            k = next((k for k in range(i, min(i + 4, len(self.t))) if self.kind(k) == "str"), None)
            if k:
                self.out.imports.append((unquote(self.tok(k)), line))
                return k + 1
        elif f == "rust" and x == "use":
            end = to_end()
            path = "".join(t.text for t in self.t[i + 1 : end])
            if re.fullmatch(r"[\w:]+", path):
                self.out.imports.append((path, line))
            return end + 1
        elif f in ("java", "kotlin", "csharp", "perl") and x == {"csharp": "using", "perl": "use"}.get(f, "import"):
            if m := re.match(r"\s*(?:import|using|use)\s+(?:static\s+|global::)?([A-Za-z_][\w.:]*)\s*(?:;|$|\s+as\b|qw|\(|\.\*)", self.text[self.t[i].at :].split("\n", 1)[0]):
                if f != "perl" or m[1][0].isupper():
                    self.out.imports.append((m[1].rstrip("."), line))
                return next((k for k in range(i, len(self.t)) if self.t[k].line > line or self.tok(k - 1) == ";" and k > i), len(self.t))
        elif f == "dart" and x in ("import", "export", "part") and self.kind(i + 1) == "str":
            self.out.imports.append((unquote(self.tok(i + 1)), line))
            return to_end() + 1
        return None

    def types(self, i: int, x: str) -> int | None:
        f = self.family
        if f == "rust" and x == "impl":
            return self.impl(i)
        if f == "go" and x == "type":
            return self.go_types(i)
        if f == "typescript" and x == "type" and self.kind(i + 1) == "id" and self.tok(i + 2) in ("=", "<"):
            end = next((k for k in range(i, len(self.t)) if self.tok(k) == ";" or k > i + 2 and self.t[k].line > self.t[k - 1].line and self.tok(k) in ("export", "const", "function", "type", "interface", "class")), len(self.t))
            self.define("Type", self.tok(i + 1), i + 1, end - 1)
            self.scopes.pop()
            return i + 3
        if x not in self.s.types or self.kind(i + 1) != "id":
            return None
        label, k = self.s.types[x], i + 1
        if x == "enum" and self.tok(k) in ("class", "struct"):
            k += 1
        if f == "csharp" and x == "record" and self.tok(k) in ("class", "struct"):
            k += 1
        name = self.tok(k)
        if x == "namespace":
            while self.tok(k + 1) in (".", "::"):
                k += 2
                name += "." + self.tok(k)
        if f == "rust" and x == "struct" and self.tok(k + 1) in (";", "("):
            end = next((n for n in range(k, len(self.t)) if self.tok(n) == ";"), k)
            self.define(label, name, k, end)
            return k + 1
        if f == "rust" and x == "mod" and self.tok(k + 1) == ";":
            self.define(label, name, k, k + 1)
            return k + 2
        brace = self.body(k + 1)
        if brace is None:
            if f == "kotlin" or f == "csharp" and x in ("record", "namespace"):
                end = len(self.t) - 1 if x == "namespace" else k
                self.bases(k + 1, next((n for n in range(k + 1, len(self.t)) if self.t[n].line > self.t[k].line or self.tok(n) == ";"), len(self.t)), x, name)
                self.define(label, name, k, end)
                return k + 1
            return None
        if f in ("c", "cpp") and any(self.tok(n) in ("(", ")") and x != "class" for n in range(k + 1, brace)):
            return None  # a function that returns the type
        self.bases(k + 1, brace, x, name)
        self.define(label, name, k, self.match.get(brace, len(self.t) - 1))
        return brace + 1

    def bases(self, i: int, end: int, keyword: str, name: str):
        own, mode, depth, k = joined(self.here(), name), None, 0, i
        after = {**dict.fromkeys(self.s.inherits, "INHERITS"), **dict.fromkeys(self.s.implements, "IMPLEMENTS")}
        while k < end:
            x = self.tok(k)
            if x in ("<", ">"):
                depth += 1 if x == "<" else -1
            elif x in "([" and k in self.match:
                k = self.match[k]
            elif depth == 0 and x in after:
                mode = after[x]
                if keyword == "interface" and self.family in ("java", "typescript"):
                    mode = "INHERITS"
            elif depth == 0 and x == ":" and (self.s.colon_bases or self.family == "cpp"):
                mode = "base"
            elif depth == 0 and x == "where":
                return
            elif depth == 0 and mode and self.kind(k) == "id" and self.tok(k + 1) not in (".", "::") and x not in ("public", "private", "protected", "virtual", "by"):
                edge = mode
                if mode == "base":
                    edge = {"kotlin": "INHERITS" if self.tok(k + 1) == "(" or self.tok(k + 1) == "<" and "(" in "".join(self.tok(n) for n in range(k, min(end, k + 8))) else "IMPLEMENTS"}.get(self.s.colon_bases, "IMPLEMENTS" if keyword == "struct" and self.family == "csharp" else "INHERITS")
                if self.family != "cpp":
                    self.out.relations.append((own, x, edge, self.t[k].line))
            k += 1

    def impl(self, i: int) -> int | None:
        brace = self.body(i + 1)
        if brace is None:
            return None
        head = [self.tok(k) for k in range(i + 1, brace)]
        flat, depth = [], 0
        for x in head:
            depth += (x == "<") - (x == ">")
            if depth == 0 and x != ">":
                flat.append(x)
        names = [x for x in flat if re.fullmatch(_ID, x)]
        if "for" in names:
            at = names.index("for")
            trait, target = names[:at], names[at + 1 :]
            target = target[: target.index("where")] if "where" in target else target
            if trait and target:
                self.out.relations.append((joined(self.here(), target[-1]), trait[-1], "IMPLEMENTS", self.t[i].line))
        self.scopes.append([self.match.get(brace, len(self.t) - 1), "impl", "", False, True])
        return brace + 1

    def go_types(self, i: int) -> int | None:
        group = self.tok(i + 1) == "("
        k, end = (i + 2, self.match.get(i + 1, len(self.t) - 1)) if group else (i + 1, i + 3)
        while k < end:
            if self.kind(k) == "id" and self.tok(k + 1) in ("struct", "interface") and self.tok(k + 2) == "{":
                last = self.match.get(k + 2, len(self.t) - 1)
                self.define({"struct": "Struct", "interface": "Interface"}[self.tok(k + 1)], self.tok(k), k, last)
                self.scopes.pop()
                k = last
            k += 1
        return max(k, i + 1) if group or k > i + 3 else None

    def function(self, i: int) -> int | None:
        f, k, owner = self.family, i + 1, ""
        if self.tok(k) == "*":
            k += 1
        if f == "go" and self.tok(k) == "(":
            close = self.match.get(k)
            if close is None:
                return None
            ids = [t.text for t in self.t[k + 1 : close] if t.kind == "id"]
            depth = [t.text for t in self.t[k + 1 : close]]
            if "[" in depth:
                ids = [t.text for t in self.t[k + 1 : k + 1 + depth.index("[")] if t.kind == "id"]
            owner, k = (ids[-1] if ids else ""), close + 1
        if f == "kotlin" and self.tok(k) == "<":
            k = next((n + 1 for n in range(k, min(k + 60, len(self.t))) if self.tok(n) == ">"), k)
        if f == "kotlin":
            while self.kind(k) == "id" and self.tok(k + 1) in (".", "?."):
                k += 2
        if self.kind(k) != "id":
            return None
        name, n = self.tok(k), k + 1
        if self.tok(n) == "<":
            n = next((m for m in range(n, min(n + 200, len(self.t))) if self.tok(m) == "("), n)
        close = self.match.get(n) if self.tok(n) == "(" else None
        if close is None and f != "perl":
            return None
        after = (close if close is not None else k) + 1
        returns = self.go_return(after) if f == "go" else None
        brace = self.body(after)
        if f == "kotlin" and (brace is None or self.t[brace].line > self.t[after - 1].line + 1 or any(self.tok(m) == "=" for m in range(after, brace))):
            brace = None
            expr = next((m for m in range(after, min(after + 12, len(self.t))) if self.tok(m) == "=" and self.t[m].line == self.t[after - 1].line), None)
            line = self.t[expr].line if expr else self.t[after - 1].line
            end = next((m - 1 for m in range(expr or after, len(self.t)) if self.t[m].line > line), len(self.t) - 1)
            end = max(end, after - 1)
        elif brace is None:
            end = next((m for m in range(after, len(self.t)) if self.tok(m) == ";"), after - 1) if f in ("rust", "typescript", "perl") else after - 1
        else:
            end = self.match.get(brace, len(self.t) - 1)
        label = "Method" if owner or self.inside() == "type" else "Function"
        self.define(label, name, k, end, owner, True, returns)
        return (brace if brace is not None else after - 1) + 1

    def go_return(self, i: int) -> str | None:
        if self.tok(i) == "(":
            i += 1
        if self.tok(i) == "*":
            i += 1
        if self.kind(i) != "id" or self.tok(i) in ("func", "chan", "map", "interface", "struct"):
            return None
        return self.tok(i + 2) if self.tok(i + 1) == "." else self.tok(i)

    def arrow(self, i: int) -> int | None:
        if self.tok(i + 2) not in ("=", ":"):
            return None
        eq = next((k for k in range(i + 2, min(i + 40, len(self.t))) if self.tok(k) == "="), None)
        if eq is None:
            return None
        k = eq + 1
        if self.tok(k) == "async":
            k += 1
        if self.tok(k) == "function":
            brace = self.body(k + 1)
        else:
            n = self.match.get(k, k) + 1 if self.tok(k) == "(" else k + 1 if self.kind(k) == "id" else None
            if n is None:
                return None
            if self.tok(n) == ":":
                n = next((m for m in range(n, min(n + 40, len(self.t))) if self.tok(m) == "=>"), n)
            if self.tok(n) != "=>":
                return None
            brace = n + 1 if self.tok(n + 1) == "{" else None
            if brace is None:
                end = next((m - 1 for m in range(n + 1, len(self.t)) if self.tok(m) == ";" or self.t[m].line > self.t[n].line and self.tok(m) in ("const", "let", "export", "function", "class", "import")), len(self.t) - 1)
                self.define("Function", self.tok(i + 1), i + 1, end, "", True)
                return n + 1
        if brace is None:
            return None
        self.define("Function", self.tok(i + 1), i + 1, self.match.get(brace, len(self.t) - 1), "", True)
        return brace + 1

    def binding(self, i: int):
        k = i + 2
        if self.tok(k) == "&":
            k += 1
        if self.kind(k) == "id" and self.tok(k + 1) == ".":
            k += 2
        if self.kind(k) == "id" and self.tok(k + 1) == "(":
            self.out.bindings.append((self.tok(i), self.tok(k)))
            if self.tok(k).lower() in ROUTE_GROUPERS and self.kind(k + 2) == "str":
                router = self.tok(k - 2) if self.tok(k - 1) == "." else ""
                self.groups[self.tok(i)] = join_route(self.groups.get(router), unquote(self.tok(k + 2)))

    def receiver(self, i: int) -> str | None:
        """The text before ".name": names, members, calls and indexes."""
        if self.tok(i - 1) not in (".", "->", "?."):
            return None
        k = i - 2
        while k >= 0:
            if self.tok(k) in ")]" and k in self.match:
                k = self.match[k] - 1
                if self.kind(k) == "id" and self.tok(k) not in self.words:
                    k -= 1
                elif self.tok(k) not in ")]":
                    break
                else:
                    continue
            elif self.kind(k) in ("id", "str", "num"):
                k -= 1
            else:
                break
            if self.tok(k) in (".", "->", "?.", "::"):
                k -= 1
            else:
                break
        start = self.t[max(k + 1, 0)].at
        return self.text[start : self.t[i - 1].at].strip() or None

    def named(self, i: int, x: str) -> int:
        """``x (``: a definition or a call."""
        n = i + 1 if self.tok(i + 1) == "(" else next((k for k in range(i + 1, min(i + 60, len(self.t))) if self.tok(k) == "("), i + 1)
        close = self.match.get(n)
        before, inside = self.tok(i - 1), self.inside()
        if close is None:
            return i + 1
        if x not in self.words or before in (".", "->", "?.") or x == "constructor" and inside == "type":
            if before not in (".", "->", "?.", "new", "return", "=", "(", ",", "await", "throw") and inside != "function":
                made = self.definition(i, x, n, close, inside)
                if made is not None:
                    return made
            if before not in ("new",) and x not in ("constructor",) and not (self.family == "rust" and before in ("struct",)):
                if not (self.family in ("c", "cpp", "java", "csharp", "dart") and inside == "type" and self.scopes and not self.scopes[-1][3] and before not in ("=", "=>", "(", ",", ".", "{")):
                    receiver = self.receiver(i)
                    self.out.calls.append((self.here(), x, receiver, self.t[i].line, self.column(i)))
                    self.route(i, x, n, close)
        return i + 1

    def definition(self, i, x, n, close, inside) -> int | None:
        f = self.family
        if inside == "type" and not self.s.methods_bare or inside == "" and not self.s.functions_bare:
            return None
        typed = self.kind(i - 1) == "id" and self.tok(i - 1) not in self.words or self.tok(i - 1) in (">", "*", "&", "]", "?", "~")
        constructor = inside == "type" and self.scopes and x == self.scopes[-1][2].split(".")[-1]
        owner = ""
        if f == "cpp" and self.tok(i - 1) == "::" and self.kind(i - 2) == "id":
            owner, typed = self.tok(i - 2), True
        if f not in ("javascript", "typescript", "dart") and not (typed or constructor):
            return None
        k = close + 1
        while self.kind(k) == "id" and self.tok(k) in MODIFIERS:
            if self.tok(k) in ("throws", "where"):
                brace = self.body(k)
                k = brace if brace is not None else next((m for m in range(k, len(self.t)) if self.tok(m) == ";"), k)
                break
            k = self.match.get(k + 1, k) + 1 if self.tok(k + 1) == "(" else k + 1
        if self.tok(k) == ":" and f in ("typescript", "cpp", "csharp", "dart"):
            brace = self.body(k)
            semi = next((m for m in range(k, len(self.t)) if self.tok(m) in (";", "}")), len(self.t) - 1)
            k = brace if brace is not None and brace < semi else semi
        if self.tok(k) == "->" and f == "cpp":
            brace = self.body(k)
            k = brace if brace is not None else k
        label = "Method" if inside == "type" or owner else "Function"
        if self.tok(k) == "{":
            self.define(label, x, i, self.match.get(k, len(self.t) - 1), owner, True)
            return n + 1
        if self.tok(k) == "=>" and f in ("csharp", "dart"):
            self.define(label, x, i, next((m for m in range(k, len(self.t)) if self.tok(m) == ";"), k), owner, True)
            return n + 1
        if self.tok(k) == ";" and (self.s.prototypes or f == "typescript" and inside == "type" and self.scopes[-1][1] in ("Interface", "Class")) and (typed or constructor or f == "typescript"):
            self.define(label, x, i, k, owner, True)
            return k
        return None

    def arguments(self, n: int, close: int) -> list[tuple[int, int]]:
        out, start, k = [], n + 1, n + 1
        while k < close:
            if self.tok(k) in "([{" and k in self.match:
                k = self.match[k]
            elif self.tok(k) == ",":
                out.append((start, k))
                start = k + 1
            k += 1
        return [*out, (start, close)] if start < close else out

    def handler(self, a: int, z: int) -> tuple[str | None, str | None, str | None]:
        """(name, receiver, verb of a wrapper) of an argument; a closure is none."""
        if self.kind(a) == "id" and self.tok(a + 1) == "(" and self.tok(a).lower() in HTTP_VERBS and self.match.get(a + 1) is not None:
            name, receiver, _ = self.handler(a + 2, self.match[a + 1])
            return name, receiver, self.tok(a)
        words = [self.tok(k) for k in range(a, z)]
        if all(re.fullmatch(_ID, w) or w in (".", "::") for w in words) and words and re.fullmatch(_ID, words[-1]):
            receiver = self.text[self.t[a].at : self.t[z - 2].at] if len(words) > 2 else None
            return words[-1], receiver or None, None
        return None, None, None

    def route(self, i, x, n, close):
        if self.family not in ("javascript", "typescript", "go", "rust") or self.tok(i - 1) not in (".", "?."):
            return
        method, args = route_method(x), self.arguments(n, close)
        if not method or not args or self.kind(args[0][0]) != "str" or args[0][1] != args[0][0] + 1:
            return
        path, router = unquote(self.tok(args[0][0])), self.tok(i - 2)
        prefix = self.groups.get(router)
        if not (path.startswith("/") or path == "" and prefix is not None):
            return
        name = receiver = verb = None
        if len(args) > 1:
            name, receiver, verb = self.handler(*args[-1])
        line = self.t[args[0][0]].line
        first = self.t[i].line == line
        self.out.routes.append((verb.upper() if verb and method == "ANY" else method, join_route(prefix, path), name, receiver, line, self.t[close].line if first else line, framework(self.family)))

    def attribute(self, i: int) -> int:
        close = self.match.get(i, i)
        m = re.match(r"\[\s*(\w+)\s*\(\s*\"([^\"]*)\"", self.text[self.t[i].at : self.t[close].at + 1])
        if m and route_method(m[1]) and m[2].startswith("/"):
            k = close + 1
            while self.tok(k) == "[":
                k = self.match.get(k, k) + 1
            name = next((self.tok(n) for n in range(k, min(k + 40, len(self.t))) if self.kind(n) == "id" and self.tok(n + 1) == "("), None)
            self.out.routes.append((route_method(m[1]), m[2], name, None, self.t[i].line, self.t[close].line, framework("csharp")))
        return close + 1 if close > i and self.inside() != "function" else i + 1


def one_branch(text: str) -> str:
    """C text with one branch of each conditional; directives and the other
    branches are blank, so lines and columns stay. The first branch counts, but
    the next one where the condition is a plain 0."""
    out, live, taken, going_on = [], [], [], False
    for line in text.split("\n"):
        m = re.match(r"\s*#\s*(if|ifdef|ifndef|elif|else|endif)\b\s*(.*?)\s*\\?\s*$", line)
        word = m[1] if m and not going_on else ""
        if word.startswith("if"):
            live.append(m[2] != "0")
            taken.append(live[-1])
        elif word in ("elif", "else") and live:
            live[-1] = not taken[-1] and m[2] != "0"
            taken[-1] = taken[-1] or live[-1]
        elif word == "endif" and live:
            live.pop()
            taken.pop()
        keep = not word and not going_on and all(live)
        out.append(line if keep else " " * len(line))
        going_on = (bool(word) or going_on) and line.rstrip("\r").endswith("\\")
    return "\n".join(out)


def extract(language: str, path: str, text: str) -> Facts:
    """The facts of one text. Where conditionals leave braces of C unbalanced, or
    branches hold several heads of one body, one branch of each is read."""
    out = Reader(language, path, text).run()
    if language in ("c", "cpp") and out.errors and re.search(r"(?m)^\s*#\s*if", text):
        flat = Reader(language, path, one_branch(text)).run()
        if len(flat.errors) < len(out.errors):
            return flat
    return out

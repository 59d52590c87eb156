"""Python, by its own parser; a file that does not parse is scanned by lines."""

from __future__ import annotations

import ast
import re
import warnings

from strandgraph.extract.facts import Facts, column16, framework, joined, module_prefix, route_method, signature


class _Visitor(ast.NodeVisitor):
    def __init__(self, path: str, text: str):
        self.prefix, self.text, self.lines = module_prefix(path), text, text.split("\n")
        self.out, self.stack = Facts(), []

    def here(self) -> str:
        return joined(self.prefix, *[n for n, _ in self.stack])

    def _define(self, node, label):
        qn = joined(self.here(), node.name)
        self.out.definitions.append((label, node.name, qn, node.lineno, node.end_lineno, signature(self.lines[node.lineno - 1]), None))
        for d in node.decorator_list:
            self.visit(d)
        self.stack.append((node.name, label))
        for child in ast.iter_child_nodes(node):
            if child not in node.decorator_list:
                self.visit(child)
        self.stack.pop()

    def visit_FunctionDef(self, node):
        for d in node.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and isinstance(d.func.value, ast.Name) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                method, path = route_method(d.func.attr), d.args[0].value
                if method and path.startswith("/"):
                    self.out.routes.append((method, path, node.name, None, d.lineno, node.end_lineno, framework("python")))
        self._define(node, "Method" if self.stack and self.stack[-1][1] == "Class" else "Function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node):
        for b in node.bases:
            if isinstance(b, ast.Name):
                self.out.relations.append((joined(self.here(), node.name), b.id, "INHERITS", node.lineno))
        self._define(node, "Class")

    def visit_Import(self, node):
        self.out.imports += [(a.name, node.lineno) for a in node.names]

    def visit_ImportFrom(self, node):
        if node.module and not node.level:
            self.out.imports.append((node.module, node.lineno))

    def visit_Call(self, node):
        f, receiver, name = node.func, None, None
        if isinstance(f, ast.Name):
            name, line, at = f.id, f.lineno, f.col_offset
        elif isinstance(f, ast.Attribute):
            name, receiver, line = f.attr, ast.get_source_segment(self.text, f.value), f.end_lineno
            at = f.end_col_offset - len(f.attr.encode())
        if name:
            raw = self.lines[line - 1].encode()[:at].decode("utf-8", "replace")
            self.out.calls.append((self.here(), name, receiver, line, column16(raw, len(raw))))
        self.generic_visit(node)


def extract(path: str, text: str) -> Facts:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return _by_lines(path, text, getattr(e, "lineno", None) or 1)
    v = _Visitor(path, text)
    try:
        v.visit(tree)
    except RecursionError:
        v.out.errors.append((1, len(v.lines)))
    return v.out.tidy()


_DEF = re.compile(r"^([ \t]*)(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)")
_IMPORT = re.compile(r"^\s*(?:from\s+([A-Za-z_][\w.]*)\s+import\b|import\s+([A-Za-z_][\w.]*))")


def _by_lines(path: str, text: str, bad: int) -> Facts:
    out, stack, lines = Facts(errors=[(bad, bad)]), [], text.split("\n")
    prefix, open_ = module_prefix(path), []
    for i, line in enumerate(lines, 1):
        m = _DEF.match(line)
        if line.strip() and (m or not line[:1].isspace()):
            depth = len(m[1].expandtabs()) if m else 0
            while stack and stack[-1][0] >= depth:
                stack.pop()
        if m:
            label = "Class" if m[2] == "class" else "Method" if stack and stack[-1][2] == "Class" else "Function"
            open_.append([label, m[3], joined(prefix, *[s[1] for s in stack], m[3]), i, i, signature(line), None, len(m[1].expandtabs())])
            stack.append((len(m[1].expandtabs()), m[3], label))
        if m := _IMPORT.match(line):
            out.imports.append((m[1] or m[2], i))
    for k, d in enumerate(open_):
        later = [x[3] for x in open_[k + 1 :] if x[7] <= d[7]]
        d[4] = max(d[3], (later[0] if later else len(lines) + 1) - 1)
        out.definitions.append(tuple(d[:7]))
    return out.tidy()

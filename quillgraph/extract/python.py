"""Python, by its own parser; texts that it refuses are scanned by indentation."""

from __future__ import annotations

import ast
import re

from .model import Found, env_signal, member_signal, unquoted


class _Walk:
    def __init__(self, text: str):
        self.lines = text.splitlines(keepends=True)
        self.out = Found()

    def literal(self, node: ast.AST | None) -> str | None:
        """A string argument as it is written, without its quotes; a prefix such as f stays with them."""
        if not isinstance(node, ast.JoinedStr) and not (isinstance(node, ast.Constant) and isinstance(node.value, (str, bytes))):
            return None
        first, last = node.lineno - 1, node.end_lineno - 1
        data = "".join(self.lines[first : last + 1]).encode()
        cut = len("".join(self.lines[first:last]).encode())
        return unquoted(data[node.col_offset : cut + node.end_col_offset].decode())

    def visit(self, node: ast.AST, scope: int | None, in_class: bool) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            for d in node.decorator_list:  # decorators stand outside of what they decorate
                self.visit(d, scope, False)
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if in_class else "function"
            self.out.symbols.append((node.name, kind, node.lineno, node.end_lineno))
            scope, held = len(self.out.symbols) - 1, set(map(id, node.decorator_list))
            for child in ast.iter_child_nodes(node):
                if id(child) not in held:
                    self.visit(child, scope, kind == "class" and child in node.body)
            return
        if isinstance(node, ast.Call):
            self.call(node, scope)
        elif isinstance(node, ast.Subscript) and isinstance(node.value, ast.Attribute) and node.value.attr == "environ":
            self.signal(env_signal(self.literal(node.slice)), node.lineno)
        for child in ast.iter_child_nodes(node):
            self.visit(child, scope, False)

    def signal(self, found: tuple | None, line: int) -> None:
        if found:
            self.out.signals.append((*found, line))

    def call(self, node: ast.Call, scope: int | None) -> None:
        f, first = node.func, node.args[0] if node.args else None
        if first is not None and any((k.value.lineno, k.value.col_offset) < (first.lineno, first.col_offset) for k in node.keywords):
            first = None
        text = self.literal(first)
        if isinstance(f, ast.Name):
            self.out.calls.append((scope, f.id, node.lineno))
            if f.id == "getenv":
                self.signal(env_signal(text), node.lineno)
        elif isinstance(f, ast.Attribute):
            self.out.calls.append((scope, f.attr, node.lineno))
            receiver = f.value.id if isinstance(f.value, ast.Name) else f.value.attr if isinstance(f.value, ast.Attribute) else None
            found = member_signal(f.attr, receiver, text, python=True)
            if not found and (f.attr == "getenv" or (f.attr == "get" and isinstance(f.value, ast.Attribute) and f.value.attr == "environ")):
                found = env_signal(text)
            self.signal(found, node.lineno)


def _scan(text: str) -> Found:
    out, open_ = Found(), []
    lines = text.splitlines()
    for n, line in enumerate(lines, 1):
        body = re.sub(r"#.*|'[^']*'|\"[^\"]*\"", "", line)
        if not body.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while open_ and indent <= open_[-1][0]:
            open_.pop()
        if m := re.match(r"\s*(?:async\s+)?(def|class)\s+(\w+)", body):
            kind = "class" if m[1] == "class" else "method" if open_ and out.symbols[open_[-1][1]][1] == "class" else "function"
            out.symbols.append((m[2], kind, n, n))
            open_.append((indent, len(out.symbols) - 1))
            body = body[m.end() :].partition(":")[2]
        for _, i in open_:
            name, kind, start, _end = out.symbols[i]
            out.symbols[i] = (name, kind, start, n)
        for c in re.finditer(r"([A-Za-z_]\w*)\s*\(", body):
            if c[1] not in {"if", "while", "for", "return", "and", "or", "not", "in", "print", "lambda", "yield", "assert", "del", "with", "elif", "except"} or c[1] == "print":
                out.calls.append((open_[-1][1] if open_ else None, c[1], n))
    return out


def parse_python(text: str, variant: str = "") -> Found:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return _scan(text)
    walk = _Walk(text)
    try:
        for child in tree.body:
            walk.visit(child, None, False)
    except RecursionError:
        return _scan(text)
    return walk.out

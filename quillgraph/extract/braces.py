"""C, TypeScript and JavaScript, Java, Kotlin: one tokenizer that knows comments and literals, and rules over matched brackets."""

from __future__ import annotations

import bisect
import re

from .model import DECORATOR_VERBS, Found, env_signal, member_signal, route, unquoted

_WORD = r"[A-Za-z_$¡-￿][\w$]*"
_TOKEN = re.compile(rf"//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<triple>\"\"\".*?(?:\"\"\"|\Z))|(?P<str>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<id>{_WORD})|(?P<num>\d[\w.]*)|(?P<op>=>|->|\?\.|::|===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|\.\.\.|[^\s\w])", re.S)
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "=>", "==", "===", "return", "typeof", "case"}

NOT_CALLS = {
    "c": set("if for while switch return sizeof do else case goto defined _Alignof typeof __attribute__".split()),
    "ts": set("if for while switch catch return typeof function super import await of in instanceof delete void new do else case throw yield async with constructor".split()),
    "java": set("if for while switch catch return super this synchronized new do else case throw try assert instanceof".split()),
    "kotlin": set("if for while when catch return super this throw try do else in is as fun constructor init get set by where".split()),
}


class Tokens:
    """kinds, texts, lines, and the partner of every bracket."""

    def __init__(self, text: str, templates: bool = False, directives: bool = False):
        self.kind: list[str] = []
        self.text: list[str] = []
        self.line: list[int] = []
        self.includes: list[tuple[str, int]] = []
        starts = [m.start() for m in re.finditer("\n", text)]
        at = 0
        while at < len(text):
            if text[at] in " \t\r\n\f\v":
                at += 1
                continue
            line = bisect.bisect_left(starts, at) + 1
            if directives and text[at] == "#" and not text[text.rfind("\n", 0, at) + 1 : at].strip():
                end = re.compile(r"(?:\\\r?\n|[^\n])*").match(text, at).end()
                if m := re.match(r'#\s*include\s*("[^"\n]*")', text[at:end]):
                    self.includes.append((m[1], line))
                at = end
                continue
            if templates and text[at] == "`":
                end = self._template(text, at)
                self._add("str", text[at:end], line)
                at = end
                continue
            if templates and text[at] == "/" and not text.startswith(("//", "/*"), at) and (not self.text or self.text[-1] in _BEFORE_REGEX) and (m := _REGEX.match(text, at)):
                self._add("re", m[0], line)
                at = m.end()
                continue
            m = _TOKEN.match(text, at)
            if not m:
                at += 1
                continue
            if m.lastgroup:
                self._add("str" if m.lastgroup == "triple" else m.lastgroup, m[0], line)
                self.last_line = line
            at = m.end()
        self.partner = [-1] * len(self.text)
        stack: list[int] = []
        for i, t in enumerate(self.text):
            if self.kind[i] != "op":
                continue
            if t in _OPEN:
                stack.append(i)
            elif t in _CLOSE:
                for j in range(len(stack) - 1, -1, -1):
                    if _OPEN[self.text[stack[j]]] == t:
                        self.partner[i], self.partner[stack[j]] = stack[j], i
                        del stack[j:]
                        break
        self.outer = [-1] * len(self.text)
        held: list[int] = []
        for i in range(len(self.text)):
            if self.kind[i] == "op" and self.text[i] in _CLOSE and held and self.partner[i] == held[-1]:
                held.pop()
            self.outer[i] = held[-1] if held else -1
            if self.kind[i] == "op" and self.text[i] in _OPEN and self.partner[i] > i:
                held.append(i)

    def _add(self, kind: str, text: str, line: int) -> None:
        self.kind.append(kind)
        self.text.append(text)
        self.line.append(line)

    @staticmethod
    def _template(text: str, at: int) -> int:
        depth, i = 0, at + 1
        while i < len(text):
            c = text[i]
            if c == "\\":
                i += 1
            elif c == "`" and not depth:
                return i + 1
            elif text.startswith("${", i):
                depth += 1
                i += 1
            elif c == "}" and depth:
                depth -= 1
            i += 1
        return len(text)

    def __len__(self) -> int:
        return len(self.text)

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) and self.kind[i] != "str" else ""

    def close(self, i: int) -> int:
        """The bracket that closes the one at i; the last token if none does."""
        return self.partner[i] if self.partner[i] > i else len(self.text) - 1

    def end_line(self, i: int) -> int:
        return self.line[i] + self.text[i].count("\n")

    def first_argument(self, paren: int) -> str | None:
        """The first argument if it is one string literal."""
        i = paren + 1
        if i < len(self) and self.kind[i] == "str" and self.at(i + 1) in (",", ")"):
            return unquoted(self.text[i])
        return None

    def chain_start(self, i: int) -> int:
        """The first token of the expression that ends with the name at i."""
        while self.at(i - 1) in (".", "?.", "->", "::"):
            j = i - 2
            while j >= 0 and self.at(j) in (")", "]") and 0 <= self.partner[j] < j:
                j = self.partner[j] - 1
            if j < 0 or self.kind[j] not in ("id", "str"):
                return max(j + 1, 0) if j + 1 < i else i
            i = j
        return i


class Defs:
    def __init__(self):
        self.rows: list[tuple[int, int, str, str, int, int]] = []

    def add(self, first: int, last: int, name: str, kind: str, tokens: Tokens, start_line: int | None = None) -> None:
        self.rows.append((first, last, name, kind, start_line or tokens.line[first], tokens.end_line(last)))

    def finish(self, calls: list[tuple[int, str, int]], signals: list[tuple]) -> Found:
        self.rows.sort(key=lambda r: (r[0], -r[1]))
        out = Found(symbols=[r[2:] for r in self.rows], signals=signals)
        for at, name, line in calls:
            inside = [k for k, r in enumerate(self.rows) if r[0] <= at <= r[1]]
            out.calls.append((inside[-1] if inside else None, name, line))
        return out


def _back(t: Tokens, i: int) -> int:
    """The first token of the declaration that holds token i: after the last ; { or } before it."""
    while i > 0 and not (t.kind[i - 1] == "op" and t.text[i - 1] in (";", "{", "}")):
        i -= 1
    return i


def parse_c(text: str, variant: str = "") -> Found:
    t, defs, bodies = Tokens(text, directives=True), Defs(), []
    i = 0
    while i < len(t):
        if t.at(i) == "(" and t.kind[i - 1] == "id" and i and t.text[i - 1] not in NOT_CALLS["c"] and t.partner[i] > i:
            end = t.partner[i]
            k = end + 1
            while t.at(k) == ")":  # a function that returns a pointer in parentheses
                k += 1
            if t.at(k) == "{":
                defs.add(_back(t, i - 1), t.close(k), t.text[i - 1], "function", t)
                bodies.append((k, t.close(k)))
                i = t.close(k)
        i += 1
    calls, signals = [], []
    for a, b in bodies:
        for j in range(a, b):
            if t.kind[j] == "id" and t.at(j + 1) == "(" and t.text[j] not in NOT_CALLS["c"]:
                calls.append((j, t.text[j], t.line[t.chain_start(j)]))
                if t.text[j] == "getenv" and t.at(j - 1) not in (".", "->") and (s := env_signal(t.first_argument(j + 1))):
                    signals.append((*s, t.line[j]))
    signals += [("import", unquoted(s), "out", "include", n) for s, n in t.includes if unquoted(s)]
    return defs.finish(calls, signals)


def _arrow_end(t: Tokens, i: int) -> int:
    """The last token of an expression that starts at i."""
    if t.at(i) == "{":
        return t.close(i)
    last = i
    while i < len(t):
        s = t.at(i)
        if t.kind[i] == "op" and s in _OPEN:
            i = t.close(i)
        elif s in (",", ";") or s in _CLOSE:
            break
        elif i > last and t.line[i] > t.end_line(last) and t.kind[i] == "id" and t.kind[last] in ("id", "num", "str") or (i > last and t.line[i] > t.end_line(last) and t.at(last) in (")", "]", "}") and t.kind[i] == "id"):
            break
        last = i
        i += 1
    return min(last, len(t) - 1)


def _function_value(t: Tokens, i: int) -> int:
    """If a function or arrow function starts at i, its last token; else -1."""
    if t.at(i) == "async":
        i += 1
    if t.at(i) == "function":
        while i < len(t) and t.at(i) != "(":
            i += 1
        i = t.close(i) + 1 if i < len(t) else i
        while i < len(t) and t.at(i) != "{":
            i += 1
        return t.close(i) if i < len(t) else -1
    if t.at(i) == "<":
        while i < len(t) and t.at(i) != "(":
            i += 1
    if t.at(i) == "(" and t.partner[i] > i:
        k = t.partner[i] + 1
        if t.at(k) == ":":
            k += 1
            while k < len(t) and t.at(k) not in ("=>", ";", "=", ",") and t.at(k) not in _CLOSE:
                k = t.close(k) + 1 if t.at(k) in _OPEN else k + 1
    elif i < len(t) and t.kind[i] == "id":
        k = i + 1
    else:
        return -1
    return _arrow_end(t, k + 1) if t.at(k) == "=>" and k + 1 < len(t) else -1


def parse_typescript(text: str, variant: str = "") -> Found:
    t, defs, named, class_bodies = Tokens(text, templates=True), Defs(), set(), set()
    for i in range(len(t)):
        if t.kind[i] != "id":
            continue
        word, before = t.text[i], t.at(i - 1)
        if word == "class" and before not in (".", "?.") and i + 1 < len(t) and t.kind[i + 1] == "id":
            k = i + 1
            while k < len(t) and t.at(k) != "{":
                k += 1
            if k < len(t):
                class_bodies.add(k)
                if t.text[i + 1] not in ("extends", "implements") and before not in ("=", "(", "return", ":", ","):
                    defs.add(i - 1 if before == "abstract" else i, t.close(k), t.text[i + 1], "class", t)
                    named.add(i + 1)
        elif word == "function" and before not in (".", "?."):
            k = i + 2 if t.at(i + 1) == "*" else i + 1
            expression = before in ("=", "(", ",", ":", "return", "=>", "[", "!", "?", "&&", "||") or (before == "async" and t.at(i - 2) in ("=", "(", ",", ":", "return", "=>", "["))
            if k < len(t) and t.kind[k] == "id":
                named.add(k)
                if not expression:
                    p = k + 1
                    while p < len(t) and t.at(p) != "(":
                        p += 1
                    b = t.close(p) + 1 if p < len(t) else p
                    while b < len(t) and t.at(b) not in ("{", ";"):
                        b += 1
                    if t.at(b) == "{":
                        defs.add(i - 1 if before == "async" else i, t.close(b), t.text[k], "function", t)
        elif word in ("const", "let", "var") and i + 1 < len(t) and t.kind[i + 1] == "id":
            k = i + 1
            while k < len(t) and t.kind[k] == "id":  # each declarator: name [: type] [= value]
                name = k
                k += 1
                if t.at(k) == ":":
                    while k < len(t) and t.at(k) not in ("=", ";", ",") and t.line[k] == t.line[name]:
                        k = t.close(k) + 1 if t.at(k) in _OPEN else k + 1
                if t.at(k) != "=":
                    break
                end = _function_value(t, k + 1)
                if end > 0:
                    defs.add(name, end, t.text[name], "function", t)
                else:
                    end = _arrow_end(t, k + 1) if k + 1 < len(t) else k
                if t.at(end + 1) != ",":
                    break
                k = end + 2
    for i in range(len(t)):
        if t.kind[i] != "id" or i in named:
            continue
        word, before = t.text[i], t.at(i - 1)
        direct = t.outer[i] in class_bodies
        if direct and t.at(i + 1) in ("=", ":") and (end := _field(t, i)) > 0:
            defs.add(_member_start(t, i), end, word, "function", t)
        elif t.at(i + 1) in ("(", "<") and (word not in NOT_CALLS["ts"] or word == "constructor") and before not in (".", "?.", "new", "function", "case", "=>") and (b := _method_body(t, i)) > 0:
            braces = t.outer[i] >= 0 and t.at(t.outer[i]) == "{"
            if braces and (direct or before in ("{", ",", "async", "*", "get", "set", "static")):
                defs.add(_member_start(t, i) if direct else i, t.close(b), word, "method", t)
                named.add(i)
    calls, signals = [], []
    for i in range(len(t)):
        if t.kind[i] != "id" or i in named:
            continue
        word, before = t.text[i], t.at(i - 1)
        paren = _call_paren(t, i)
        member = before in (".", "?.")
        line = t.line[t.chain_start(i)]
        if before == "new" and not member and word not in NOT_CALLS["ts"]:
            if t.at(i + 1) != ".":
                calls.append((i, word, t.line[i - 1]))
        elif paren > 0 and t.at(t.chain_start(i) - 1) != "new" and (member or word not in NOT_CALLS["ts"] | {"constructor"}):
            calls.append((i, word, line))
            literal, found = t.first_argument(paren), None
            if member:
                r = i - 2
                receiver = t.text[r] if r >= 0 and t.kind[r] == "id" else None
                found = member_signal(word, receiver, literal, python=False)
            elif word == "fetch" and (path := route(literal)):
                found = ("wire", path, "out", "get")
            elif word in DECORATOR_VERBS and before == "@" and (path := route(literal)):
                found = ("wire", path, "in", word.lower())
            elif word == "require" and literal:
                found = ("import", literal, "out", "require")
            if found:
                signals.append((*found, line))
        elif word == "env" and member and t.at(i - 2) in ("process", "meta"):
            name = t.text[i + 2] if t.at(i + 1) in (".", "?.") and i + 2 < len(t) and t.kind[i + 2] == "id" else unquoted(t.text[i + 2]) if t.at(i + 1) == "[" and i + 2 < len(t) and t.kind[i + 2] == "str" and t.at(i + 3) == "]" else None
            if found := env_signal(name):
                signals.append((*found, line))
        elif word == "import" and not member and t.at(i + 1) not in ("(", "."):
            k = i + 1
            while k < len(t) and t.kind[k] != "str" and t.at(k) != ";":
                k = t.close(k) + 1 if t.at(k) == "{" else k + 1
            if k < len(t) and t.kind[k] == "str" and (k == i + 1 or t.at(k - 1) == "from") and unquoted(t.text[k]):
                signals.append(("import", unquoted(t.text[k]), "out", "import", t.line[i]))
    return defs.finish(calls, signals)


def _call_paren(t: Tokens, i: int) -> int:
    """The parenthesis of a call of the name at i, behind type arguments or ?. if there are any; -1 if it is not called."""
    k = i + 1
    if t.at(k) == "?." and t.at(k + 1) == "(":
        return k + 1
    if t.at(k) == "<":
        depth = 0
        while k < len(t) and k < i + 40:
            depth += {"<": 1, ">": -1}.get(t.at(k), 0)
            if t.kind[k] not in ("id", "op") or t.at(k) in (";", "(", ")", "{", "}", "&&", "||", "="):
                return -1
            k += 1
            if not depth:
                break
    return k if t.at(k) == "(" else -1


def _method_body(t: Tokens, i: int) -> int:
    """The brace that opens the body of a method named at i; -1 if it is none."""
    p = _call_paren(t, i)
    if p < 0 or t.partner[p] < 0:
        return -1
    k = t.partner[p] + 1
    if t.at(k) == ":":
        k += 1
        while k < len(t) and t.at(k) not in ("{", ";", "=", ",", ")"):
            k = t.close(k) + 1 if t.at(k) in ("(", "[") else k + 1
    return k if t.at(k) == "{" else -1


def _member_start(t: Tokens, i: int) -> int:
    while t.at(i - 1) in ("async", "static", "public", "private", "protected", "readonly", "override", "get", "set", "*", "abstract", "declare"):
        i -= 1
    return i


def _field(t: Tokens, i: int) -> int:
    k = i + 1
    if t.at(k) == ":":
        while k < len(t) and t.at(k) not in ("=", ";", "}"):
            k = t.close(k) + 1 if t.at(k) in _OPEN else k + 1
    return _function_value(t, k + 1) if t.at(k) == "=" else -1


def parse_java(text: str, variant: str = "") -> Found:
    t, defs, bodies, named, calls = Tokens(text), Defs(), {}, set(), []
    for i in range(len(t) - 1):
        if t.at(i) in ("class", "interface", "enum", "record") and t.kind[i + 1] == "id" and t.at(i - 1) != "." and t.at(i + 2) in ("{", "<", "extends", "implements", "(", "permits"):
            k = i + 2
            while k < len(t) and t.at(k) != "{":
                k = t.close(k) + 1 if t.at(k) == "(" else k + 1
            if k < len(t):
                bodies[k] = t.text[i + 1]
                named.add(i + 1)
                defs.add(_back(t, i), t.close(k), t.text[i + 1], "class", t)
    for i in range(len(t) - 1):
        if t.kind[i] != "id" or i in named or t.text[i] in NOT_CALLS["java"] or t.at(i + 1) != "(":
            continue
        end = t.close(i + 1)
        before = t.at(i - 1)
        if t.outer[i] in bodies and before not in (".", "new", "@", "=") and t.at(_back(t, i)) != "=":
            k = end + 1
            while t.at(k) == "throws" or (k < len(t) and t.at(k) not in ("{", ";", "=", "}") and t.at(k - 1) in ("throws", ",", ".") or t.at(k) in (",", ".")):
                k += 1
            own = bodies[t.outer[i]] == t.text[i] and (t.at(i - 1) in ("{", "}", ";", "public", "private", "protected") or i - 1 < 0)
            if t.at(k) in ("{", ";") and (own or t.kind[i - 1] == "id" or before in (">", "]")):
                named.add(i)
                defs.add(_back(t, i), t.close(k) if t.at(k) == "{" else k, t.text[i], "constructor" if own else "method", t)
                continue
        if before == "@" or before == "new":
            continue
        calls.append((i, t.text[i], t.line[t.chain_start(i)]))
    for i in range(len(t) - 1):
        if t.at(i) == "new" and t.kind[i + 1] == "id":
            k = i + 1
            while t.at(k + 1) == "." and k + 2 < len(t):
                k += 2
            p = _call_paren(t, k)
            if p > 0:
                calls = [c for c in calls if c[0] != k]
                calls.append((k, t.text[k], t.line[i]))
    return defs.finish(sorted(calls), [])


def parse_kotlin(text: str, variant: str = "") -> Found:
    t, defs, bodies, named, calls = Tokens(text), Defs(), set(), set(), []
    for i in range(len(t) - 1):
        if t.at(i) in ("class", "interface", "object") and t.kind[i + 1] == "id" and t.at(i - 1) not in (".", "::"):
            k = i + 2
            while k < len(t) and (t.at(k) in ("(", "<", ":", ",", ".", ">", "?") or t.at(k - 1) in (":", ",", ".", "<", "by") or t.at(k) in ("constructor", "by", "where", "private", "internal", "protected")):
                k = t.close(k) + 1 if t.at(k) == "(" else k + 1
            has_body = t.at(k) == "{"
            if has_body:
                bodies.add(k)
            named.add(i + 1)
            defs.add(_modifiers(t, i), t.close(k) if has_body else max(k - 1, i + 1), t.text[i + 1], "class", t)
    for i in range(len(t) - 1):
        if t.at(i) != "fun":
            continue
        p = i + 1
        while p < len(t) and t.at(p) != "(":
            p += 1
        if p >= len(t) or t.kind[p - 1] != "id":
            continue
        named.add(p - 1)
        k = t.close(p) + 1
        if t.at(k) == ":":
            k += 1
            while k < len(t) and t.at(k) not in ("{", "=") and t.line[k] == t.line[k - 1]:
                k = t.close(k) + 1 if t.at(k) in ("(", "[") else k + 1
        if t.at(k) == "{":
            end = t.close(k)
        elif t.at(k) == "=":
            end = _arrow_end(t, k + 1) if k + 1 < len(t) else k
        else:
            end = k - 1
        defs.add(_modifiers(t, i), end, t.text[p - 1], "method" if t.outer[i] in bodies else "function", t)
    for i in range(len(t) - 1):
        if t.kind[i] == "id" and i not in named and t.text[i] not in NOT_CALLS["kotlin"] and t.at(i - 1) != "@":
            if _call_paren(t, i) > 0 or (t.at(i + 1) == "{" and t.at(i - 1) == "."):
                calls.append((i, t.text[i], t.line[t.chain_start(i)]))
    return defs.finish(calls, [])


def _modifiers(t: Tokens, i: int) -> int:
    words = {"public", "private", "protected", "internal", "open", "abstract", "final", "override", "suspend", "inline", "data", "sealed", "enum", "annotation", "inner", "companion", "operator", "infix", "tailrec", "external", "const", "value"}
    while t.at(i - 1) in words:
        i -= 1
    return i

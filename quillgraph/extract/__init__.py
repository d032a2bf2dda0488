"""Symbols, calls and contract signals of one source text.

`parse_source` picks the recognizer of the language from RULES; further languages are added there. A recognizer takes (text, variant)
and returns a `Found`. Places are 1-based lines; the enclosing index points into symbols, or is None at the top of the file.
"""

from __future__ import annotations

from collections.abc import Callable

from .braces import parse_c, parse_java, parse_kotlin, parse_typescript
from .model import Found
from .python import parse_python

RULES: dict[str, Callable[[str, str], Found]] = {"typescript": parse_typescript, "c": parse_c, "python": parse_python, "java": parse_java, "kotlin": parse_kotlin}


def parse_source(lang: str | None, variant: str | None, text: str) -> Found:
    rule = RULES.get(lang or "")
    return rule(text, variant or "") if rule else Found()

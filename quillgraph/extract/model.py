"""What recognizers find, and the rules that turn calls into contract signals."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# HTTP verbs, their decorators, and receivers that tell a server from a client.
HTTP_VERBS = frozenset("get post put patch delete options head all".split())
DECORATOR_VERBS = frozenset(v.capitalize() for v in HTTP_VERBS)
PY_ROUTE_VERBS = frozenset("get post put patch delete route".split())
SERVER_NAMES = frozenset("app router server route routes fastify express bp blueprint api ns".split())
CLIENT_NAMES = frozenset("axios http https client request requests httpx session got ky superagent".split())
# Methods that send or receive messages (lower case, without underscores).
SENDING = frozenset("publish emit send produce basicpublish sendtoqueue dispatch xadd".split())
RECEIVING = frozenset("subscribe on consume basicconsume addlistener xread".split())
# Environment variables too common to tell anything (exact case).
COMMON_ENV = frozenset("NODE_ENV PORT HOME PATH PWD USER SHELL LANG TERM TZ CI DEBUG NODE_OPTIONS HOSTNAME TMPDIR EDITOR LOGNAME SHLVL OLDPWD DISPLAY".split())


@dataclass
class Found:
    #: (name, kind, start line, end line)
    symbols: list[tuple[str, str, int, int]] = field(default_factory=list)
    #: (enclosing, name, line)
    calls: list[tuple[int | None, str, int]] = field(default_factory=list)
    #: (kind, token, role, label, line)
    signals: list[tuple[str, str, str, str, int]] = field(default_factory=list)


def unquoted(literal: str) -> str:
    return literal[1:-1] if len(literal) >= 2 and literal[0] in "`'\"" else literal


def route(literal: str | None) -> str | None:
    if not literal:
        return None
    if url := re.match(r"https?://[^/]+(/[^\s?#]*)", literal):
        return url[1]
    return re.split(r"[?#]", literal, maxsplit=1)[0] if literal.startswith("/") else None


def side(receiver: str | None) -> str:
    return "in" if receiver in SERVER_NAMES else "out" if receiver in CLIENT_NAMES else "unknown"


def member_signal(method: str, receiver: str | None, literal: str | None, python: bool) -> tuple[str, str, str, str] | None:
    """The route or message of a call `receiver.method(literal, ...)`: at most one, a route first."""
    verb, path = method.lower(), route(literal)
    if path and (verb in HTTP_VERBS or (python and verb in PY_ROUTE_VERBS)):
        return "wire", path, side(receiver), "get" if verb == "route" else verb
    plain = verb.replace("_", "")
    if literal and len(literal) >= 3 and not re.search(r"\s", literal) and plain in SENDING | RECEIVING:
        return "message", literal, "out" if plain in SENDING else "in", verb
    return None


def env_signal(name: str | None) -> tuple[str, str, str, str] | None:
    return ("state", name, "unknown", "env") if name and name not in COMMON_ENV else None

"""A project's small settings: posture, links to other projects, former links. JSON files on the driver."""

from __future__ import annotations

import json
import os
import time

POSTURES = ("off", "conservative", "balanced", "aggressive")
FOLDER = ".quillgraph"


def folder(project: str) -> str:
    return os.path.join(project, FOLDER)


def load(project: str) -> dict | None:
    try:
        with open(os.path.join(folder(project), "state.json"), encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return None
    return found if isinstance(found, dict) else None


def update(project: str, **values) -> dict:
    os.makedirs(folder(project), exist_ok=True)
    state = {"posture": "balanced", "links": [], "former": []} | (load(project) or {}) | values
    path = os.path.join(folder(project), "state.json")
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(state, f, indent=2, sort_keys=True)
    os.replace(path + ".new", path)
    return state


def set_posture(project: str, posture: str) -> dict:
    if posture not in POSTURES:
        raise ValueError(f"posture is one of {', '.join(POSTURES)}")
    return update(project, posture=posture)


def seed(project: str) -> dict:
    """State for a new project, and its folder kept out of git."""
    state = update(project)
    path = os.path.join(project, ".gitignore")
    lines = open(path, encoding="utf-8").read().splitlines() if os.path.exists(path) else []
    if f"{FOLDER}/" not in lines:
        with open(path, "a", encoding="utf-8") as f:
            f.write(("" if not lines or lines[-1] == "" else "\n") + f"{FOLDER}/\n")
    return state


def index_root(start: str, home: str | None = None) -> str | None:
    """The nearest directory up from `start` with state, not above home; one at home counts only for home itself."""
    home = os.path.realpath(home or os.path.expanduser("~"))
    at = start = os.path.realpath(start)
    while True:
        if os.path.isdir(folder(at)) and (at != home or start == home):
            return at
        if at == home or os.path.dirname(at) == at:
            return None
        at = os.path.dirname(at)


def member_roots(project: str) -> list[str]:
    """The project's own root first, then linked ones that exist, each once."""
    out: list[str] = []
    for p in [project, *((load(project) or {}).get("links") or [])]:
        real = os.path.realpath(p)
        if os.path.isdir(real) and real not in out:
            out.append(real)
    return out


def graphs_listing(project: str, known: list[str]) -> list[str]:
    """The projects among `known` that list `project` as a member."""
    real = os.path.realpath(project)
    return [k for k in known if os.path.realpath(k) != real and real in member_roots(k)]


def can_link(a: str, b: str) -> str | None:
    """Why two projects can't be linked; None if they can."""
    a, b = os.path.realpath(a), os.path.realpath(b)
    if not (os.path.isdir(a) and os.path.isdir(b)):
        return "missing"
    if a == b:
        return "same"
    if a.startswith(b + "/") or b.startswith(a + "/"):
        return "nested"
    mine, theirs = set(member_roots(a)) - {b}, set(member_roots(b)) - {a}
    if any(os.path.basename(x) == os.path.basename(y) and x != y for x in mine for y in theirs):
        return "name clash"
    return None


def link(a: str, b: str) -> None:
    """Makes two projects members of each other's graphs; safe to repeat after a crash."""
    if why := can_link(a, b):
        raise ValueError(f"cannot link: {why}")
    for own, other in ((a, b), (b, a)):
        links = (load(own) or {}).get("links") or []
        real = os.path.realpath(other)
        update(own, links=[*links, *([real] if real not in links else [])])


def unlink(a: str, b: str) -> None:
    """Ends a link on both sides and remembers it."""
    for own, other in ((a, b), (b, a)):
        state = load(own)
        if state is None:
            continue
        real = os.path.realpath(other)
        if real in (state.get("links") or []):
            former = [f for f in state.get("former") or [] if f["path"] != real] + [{"path": real, "at": int(time.time())}]
            update(own, links=[x for x in state["links"] if x != real], former=former)


def former_links(project: str) -> list[str]:
    return [f["path"] for f in (load(project) or {}).get("former") or []]


def forget_links(project: str) -> None:
    update(project, former=[])


def preview_link(a: str, b: str) -> dict:
    """What a link would do, without doing it."""
    return {"blocked": can_link(a, b), "members": sorted({*member_roots(a), *member_roots(b)})}


def preview_unlink(a: str, b: str) -> dict:
    real = os.path.realpath(b)
    return {"linked": real in ((load(a) or {}).get("links") or []), "members": [m for m in member_roots(a) if m != real]}


def registry_path(home: str | None = None) -> str:
    return os.path.join(home or os.path.expanduser("~"), FOLDER, "projects.json")


def registered(home: str | None = None) -> list[str]:
    """Known projects that still exist."""
    try:
        with open(registry_path(home), encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return []
    return [p for p in found if os.path.isdir(p)] if isinstance(found, list) else []


def register(project: str, home: str | None = None) -> list[str]:
    path, known = registry_path(home), registered(home)
    real = os.path.realpath(project)
    known = sorted({*known, real})
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(known, f, indent=2)
    os.replace(path + ".new", path)
    return known

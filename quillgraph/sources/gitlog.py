"""What git says changed; every failure reads as 'unknown'."""

from __future__ import annotations

import os
import subprocess

from .tree import language


def git(root: str, *args: str) -> str | None:
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, timeout=30).stdout
    except (OSError, subprocess.SubprocessError):
        return None


def changed_files(root: str, last: str | None) -> list[str] | None:
    """Absolute paths of source files changed since commit `last` or not committed; of renames the new path. None if git fails."""
    status = git(root, "status", "--porcelain")
    if status is None:
        return None
    names = {line[3:].split(" -> ")[-1].strip('"') for line in status.splitlines() if len(line) > 3}
    if last:
        diff = git(root, "diff", "--name-only", f"{last}..HEAD")
        if diff is None:
            return None
        names |= set(diff.split("\n")) - {""}
    return sorted(os.path.join(root, n) for n in names if language(n))


def divergence(root: str) -> tuple[int, int] | None:
    """Commits ahead of and behind the upstream branch; None if detached, without one, or in sync."""
    if (git(root, "symbolic-ref", "-q", "HEAD") or "").strip() == "":
        return None
    out = git(root, "rev-list", "--left-right", "--count", "HEAD...@{upstream}")
    ahead, behind = map(int, out.split()) if out else (0, 0)
    return (ahead, behind) if ahead or behind else None

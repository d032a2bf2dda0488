"""Source trees as a Spark data source.

`spark.read.format("source_tree").option("roots", json).load()` lists files on the driver, without following links and without entering
ignored directories (names that begin with a dot or an underscore are read like others), and reads their contents on executors. Roots must be
visible to all of them. Options: roots (JSON list), files (JSON list of absolute paths; only those are read), per_task (files in a task).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import SOURCES

# Directories that are never entered.
IGNORED = frozenset(
    "node_modules .git .runtime .quillgraph .codegraph .shipyard dist build out .next coverage vendor __pycache__ .venv venv .idea .vscode cmake-build-debug cmake-build-release "
    ".aws-sam .tox .eggs .pytest_cache .mypy_cache .ruff_cache .gradle target .mvn".split()
)
# Fixed values: (language, variant) by extension.
LANGUAGES = {e: ("typescript", e) for e in "ts mts cts tsx js jsx mjs cjs".split()} | {"c": ("c", ""), "h": ("c", "")} | {"py": ("python", ""), "java": ("java", ""), "kt": ("kotlin", ""), "kts": ("kotlin", "")}
# Files that make their directory a compartment.
MANIFESTS = frozenset("go.mod Cargo.toml pyproject.toml pom.xml build.gradle build.gradle.kts".split())
#: Longer files (in UTF-16 units) are listed without their content.
MOST_UNITS = 2_000_000


def language(name: str) -> tuple[str, str] | None:
    stem, dot, ext = name.rpartition(".")
    return LANGUAGES.get(ext.lower()) if dot else None


def is_boundary(directory: str, names: set[str], git_only: bool = False) -> bool:
    if ".git" in names:
        return True
    if git_only:
        return False
    if names & MANIFESTS:
        return True
    if "package.json" in names:
        try:
            with open(os.path.join(directory, "package.json"), encoding="utf-8") as f:
                spec = json.load(f)
        except (OSError, ValueError):
            return False
        return isinstance(spec, dict) and bool(spec.get("name") or spec.get("workspaces"))
    return False


def find_roots(root: str, git_only: bool = False) -> list[str]:
    """Compartment roots in and under `root`, with `git_only` those of repositories."""
    found = []
    for directory, inner, files in os.walk(root):
        if is_boundary(directory, {*inner, *files}, git_only):
            found.append(directory)
        inner[:] = sorted(d for d in inner if d not in IGNORED and not os.path.islink(os.path.join(directory, d)))
    return found


def compartment_of(path: str, roots: list[str], fallback: str) -> tuple[str, str]:
    """Name and root of the nearest compartment around a path; else of the fallback root."""
    around = [r for r in roots if path == r or path.startswith(r.rstrip("/") + "/")]
    root = max(around, key=len, default=fallback)
    return os.path.basename(root.rstrip("/")), root


def walk(roots: list[str]) -> Iterator[tuple[str, str, str, str]]:
    """abs, root, compartment, compartment root of every source file, each file once."""
    seen: set[str] = set()
    for root in roots:
        bounds = find_roots(root)
        for directory, inner, files in os.walk(root):
            inner[:] = sorted(d for d in inner if d not in IGNORED and not os.path.islink(os.path.join(directory, d)))
            for name in sorted(files):
                path = os.path.join(directory, name)
                if language(name) and os.path.isfile(path) and not os.path.islink(path) and (real := os.path.realpath(path)) not in seen:
                    seen.add(real)
                    yield (path, root, *compartment_of(path, bounds, root))


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, str, str, str]]):
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.only = set(json.loads(options["files"])) if "files" in options else None
        self.per_task = int(options.get("per_task", "200"))

    def partitions(self) -> list[InputPartition]:
        files = [f for f in walk(self.roots) if self.only is None or f[0] in self.only]
        return [_Files(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)] or [_Files([])]

    def read(self, partition: _Files):
        for path, root, name, own_root in partition.files:
            try:
                stat = os.stat(path)
                with open(path, encoding="utf-8", errors="replace", newline="") as f:
                    content = f.read()
            except OSError:
                continue
            lang, variant = language(path)
            units = len(content) + sum(1 for c in content if ord(c) > 0xFFFF)
            yield path, root, name, own_root, os.path.relpath(path, own_root), lang, variant, stat.st_mtime * 1000, stat.st_size, content if units <= MOST_UNITS else None


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SOURCES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, roots: list[str], files: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("roots", json.dumps(roots))
    return (reader if files is None else reader.option("files", json.dumps(files))).load()


def packages(spark: SparkSession, roots: list[str]) -> DataFrame:
    """name, root, package, entry of every compartment."""
    rows = []
    for root in roots:
        for r in find_roots(root) or [root]:
            spec = {}
            try:
                with open(os.path.join(r, "package.json"), encoding="utf-8") as f:
                    spec = json.load(f)
            except (OSError, ValueError):
                pass
            spec = spec if isinstance(spec, dict) else {}
            rows.append((os.path.basename(r.rstrip("/")), r, spec.get("name") or None, spec.get("module") or spec.get("main") or None))
    return spark.createDataFrame(rows, "name string, root string, package string, entry string").dropDuplicates(["name"])


def scope(root: str) -> str:
    """What a workspace holds: MULTI (two or more repositories), SINGLE or NO-GIT."""
    n = len(find_roots(root, git_only=True))
    return "MULTI" if n >= 2 else "SINGLE" if n else "NO-GIT"

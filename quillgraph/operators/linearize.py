"""One readable file out of a slice of the call graph: a root and what it calls, in reading order.

Spark bounds the slice (reach of the root); order and text are made on the driver from at most `most` symbols.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import TRIVIAL_NAMES, is_test_segment, is_trivial
from .traverse import neighbor_compartments, reach

# Methods to start from when a class or file is named.
ENTRY_NAMES = "execute invoke run handle process start onEvent dispatch main".split()
CONSTRUCTORS = ("<init>", "constructor", "__init__")
NOWHERE = 10**9
WORD = re.compile(r"\w+")
#: Bodies whose rows are made at a time.
BODIES = 256


class Unresolved(ValueError):
    pass


@dataclass
class Options:
    breadth: str = "medium"  # tight, medium, full
    depth: int = 4
    most: int = 60
    prune: bool = True
    ambiguous: str = "stub"  # skip, stub, follow
    include_tests: bool = False


def resolve_root(symbols: DataFrame, spec: str, file: str | None = None):
    """The symbol that `name`, `Class.method`, or a class or file name with an entry method stands for."""
    holder, _, method = spec.rpartition(".") if "." not in spec else spec.partition(".")
    name = method if holder else spec
    marked = symbols.withColumn("test", is_test_segment(F.col("file")))
    found = marked.where(F.col("name") == name)
    for part in (holder, file):
        if part:
            found = found.where(F.contains(F.lower("file"), F.lit(part.lower())))
    rows = found.orderBy("test", "compartment", "file", "start_line").limit(1).collect()
    if rows:
        return rows[0]
    around = marked.where(F.contains(F.lower("file"), F.lit(spec.lower())) & (F.col("kind") != "module"))
    hint = F.coalesce(*[F.when(F.col("name") == n, i) for i, n in enumerate(ENTRY_NAMES)])
    rows = around.withColumn("hint", hint).where("hint IS NOT NULL").orderBy("test", "hint", "compartment", "file", "start_line").limit(1).collect()
    if rows:
        return rows[0]
    names = [r[0] for r in around.select("name").distinct().orderBy("name").limit(100).collect()]
    raise Unresolved(f"'{spec}' is no single method; in matching files: {', '.join(names)}" if names else f"no symbol '{spec}'")


def merged_calls(edges: DataFrame) -> DataFrame:
    """src, dst, resolution, cnt: parallel calls as one, unique if any is."""
    unique = F.max((F.col("resolution") == "unique").cast("int")) == 1
    return edges.where("type = 'CALLS'").groupBy("src", "dst").agg(F.when(unique, "unique").otherwise(F.first("resolution")).alias("resolution"), F.sum(F.coalesce(F.expr("nullif(cnt, 0)"), F.lit(1))).alias("cnt"))


def first_line(body: list[str], token: str) -> int:
    pattern = re.compile(rf"\b{re.escape(token)}\b")
    return next((i for i, line in enumerate(body) if token and pattern.search(line)), NOWHERE)


class FirstLines:
    """The first line (from 0) of each of `names` in bodies, as `first_line` finds it; a body's words are taken once, for all names."""

    def __init__(self, names: list[str]):
        self.at = {n: i for i, n in enumerate(names) if WORD.fullmatch(n)}
        self.odd = [(i, n) for i, n in enumerate(names) if n and n not in self.at]  # not single words: each is sought by itself

    def of(self, body: str) -> Iterator[tuple[int, int]]:
        """(index of the name, line) of the names that the body has."""
        lines, left = body.split("\n"), set(self.at)
        for i, line in enumerate(lines):
            if met := left.intersection(WORD.findall(line)):
                yield from ((self.at[n], i) for n in met)
                left -= met
                if not left:
                    break
        for n, name in self.odd:
            if (i := first_line(lines, name)) != NOWHERE:
                yield n, i


def callees_in_order(callees: DataFrame) -> DataFrame:
    """src, name, line (from 1; null if the body doesn't have it), place (from 1) for rows (src, body, names): in the order of a linear
    reading, by first line in the body, then by name. A null body has no lines; no name or a null one gives no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BODIES):
                part = batch.slice(at, BODIES)
                names = part.column(2)
                coded = names.flatten().dictionary_encode()
                known = coded.dictionary.to_pylist()
                rank = np.empty(len(known), np.int64)
                rank[sorted(range(len(known)), key=known.__getitem__)] = np.arange(len(known))
                reader = FirstLines(known)
                lengths = pc.fill_null(pc.list_value_length(names), 0).to_numpy()
                row, code = np.repeat(np.arange(len(lengths)), lengths), coded.indices.fill_null(-1).to_numpy()
                first = np.full((len(lengths), len(known) + 1), NOWHERE, np.int64)  # the last column is for null names
                for i, body in enumerate(part.column(1).to_pylist()):
                    if lengths[i]:
                        for n, line in reader.of(body or ""):
                            first[i, n] = line
                row, code = row[code >= 0], code[code >= 0]
                line = first[row, code]
                order = np.lexsort((rank[code], line, row))
                row, code, line = row[order], code[order], line[order]
                place = np.arange(len(row)) - np.searchsorted(row, row) + 1
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), coded.dictionary.take(pa.array(code)), pa.array(line + 1, mask=line == NOWHERE), pa.array(place, pa.int32())], names=["src", "name", "line", "place"]
                )

    return callees.select("src", "body", "names").mapInArrow(run, "src string, name string, line long, place int")


class _Writer:
    def __init__(self, symbols: dict, calls: dict, allowed: set | None, body: Callable, options: Options, home: str):
        self.symbols, self.calls, self.allowed, self.body, self.o, self.home = symbols, calls, allowed, body, options, home
        self.done: set[str] = set()
        self.tree: list[str] = []
        self.out: list[str] = []
        self.cut = False

    def inlined(self, s) -> bool:
        return self.allowed is None or s["compartment"] in self.allowed

    def stub(self, s, pad: str) -> None:
        head = next((line.split("{")[0].strip() for line in self.body(s)[:6] if line.strip()), s["name"])
        self.out.append(f"{pad}// -> [{s['compartment']}] {head}  {s['file']}:{s['start_line']} (not inlined)")

    def emit(self, s, depth: int) -> None:
        pad = "  " * depth
        if s["id"] in self.done:
            self.out.append(f"{pad}// see {s['name']} above  {s['file']}:{s['start_line']}")
            return
        if len(self.done) >= self.o.most:
            if not self.cut:
                self.out.append(f"{pad}// cut off at {self.o.most} symbols")
            self.cut = True
            return
        self.done.add(s["id"])
        self.tree.append(f"{pad}{s['name']}  {s['file']}:{s['start_line']}")
        text = self.body(s)
        self.out += ["", f"{pad}// ---- {s['name']}  [{s['compartment']}]  {s['file']}:{s['start_line']}-{s['end_line']}", *(pad + line for line in text)]
        if depth >= self.o.depth:
            self.out.append(f"{pad}// depth {self.o.depth} reached, callees of {s['name']} left out")
            return
        groups: dict[str, list] = {}
        items = []
        for dst, resolution in self.calls.get(s["id"], ()):
            c = self.symbols.get(dst)
            if c is None or dst == s["id"] or (self.o.prune and (c["name"] in TRIVIAL_NAMES or c["trivial"])) or (c["test"] and not self.o.include_tests):
                continue
            if resolution == "unique":
                token = os.path.splitext(os.path.basename(c["file"]))[0] if c["name"] in CONSTRUCTORS else c["name"]
                items.append((first_line(text, token), c["name"], c["id"], c, None))
            else:
                groups.setdefault(c["name"], []).append(c)
        items += [(first_line(text, n), n, "", None, sorted(g, key=lambda c: c["id"])) for n, g in groups.items()]
        for _, name, _, c, group in sorted(items, key=lambda x: x[:3]):
            inner = pad + "  "
            if c is not None:
                self.emit(c, depth + 1) if self.inlined(c) else self.stub(c, inner)
            elif self.o.ambiguous == "follow":
                best = min(group, key=lambda c: c["compartment"] != self.home)
                self.emit(best, depth + 1) if self.inlined(best) else self.stub(best, inner)
            elif self.o.ambiguous == "stub":
                where = ", ".join(dict.fromkeys(f"{c['compartment']}:{os.path.basename(c['file'])}:{c['start_line']}" for c in group))
                self.out.append(f"{inner}// {name} is ambiguous: one of {where} (not inlined)")


def linearize(tables: dict[str, DataFrame], spec: str, file: str | None = None, options: Options | None = None, read: Callable[[str], str] | None = None) -> str:
    """The slice as text. `read` gives the content of an absolute path."""
    o = options or Options()
    o.depth, o.most = max(0, min(12, o.depth)), max(1, min(250, o.most))
    symbols, edges = tables["symbols"], tables["edges"]
    root = resolve_root(symbols, spec, file)
    spark = symbols.sparkSession
    members = []
    if root["kind"] in ("class", "module"):
        inside = symbols.where((F.col("compartment") == root["compartment"]) & (F.col("file") == root["file"]) & F.col("kind").isin("method", "function", "constructor") & (F.col("start_line") > root["start_line"]) & (F.col("start_line") <= root["end_line"]))
        members = list({r["name"]: r for r in reversed(inside.orderBy("start_line").collect())}.values())
        members.sort(key=lambda r: r["start_line"])
    starts = [r["id"] for r in members] or [root["id"]]
    seeds = spark.createDataFrame([(i,) for i in starts], "id string")
    slice_ = seeds.withColumn("depth", F.lit(0))
    if o.depth:
        slice_ = reach(edges, symbols, seeds, min(8, o.depth), "out", True)
    near = symbols.join(slice_.select("id").distinct(), "id", "left_semi").select("*", is_test_segment(F.col("file")).alias("test"), is_trivial(F.col("name")).alias("trivial"))
    by_id = {r["id"]: r for r in near.collect()}
    calls: dict[str, list] = {}
    for r in merged_calls(edges).join(slice_.select(F.col("id").alias("src")).distinct(), "src", "left_semi").orderBy("src", "dst").collect():
        calls.setdefault(r["src"], []).append((r["dst"], r["resolution"]))
    allowed = {"tight": {root["compartment"]}, "full": None}.get(o.breadth, ...)
    if allowed is ...:
        allowed = {r[0] for r in neighbor_compartments(edges, symbols, root["compartment"]).collect()}
    places = {r["name"]: r["root"] for r in tables["compartments"].select("name", "root").collect()}
    texts: dict[tuple, list[str]] = {}

    def body(s) -> list[str]:
        key = (s["compartment"], s["file"])
        if key not in texts:
            path = os.path.join(places.get(s["compartment"]) or "", s["file"])
            try:
                texts[key] = (read(path) if read else open(path, encoding="utf-8", errors="replace").read()).splitlines()
            except OSError:
                texts[key] = []
        return texts[key][s["start_line"] - 1 : s["end_line"]] if s["start_line"] > 0 else []

    w = _Writer(by_id, calls, allowed, body, o, root["compartment"])
    for s in [by_id[i] for i in starts]:
        w.emit(s, 0)
    files = {(by_id[i]["compartment"], by_id[i]["file"]) for i in w.done}
    head = [f"// slice of {root['name']} ({root['file']}:{root['start_line']}), breadth {o.breadth}, depth {o.depth}", f"// {len(w.done)} symbols in {len(files)} files" + (" (cut off)" if w.cut else ""), "// for reading only", "// calls:"]
    return "\n".join([*head, *(f"//   {t}" for t in w.tree), *w.out]) + "\n"

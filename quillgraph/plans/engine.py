"""The query tools over a stored graph, as DataFrames and as text."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import is_test, name_contains
from ..operators import contracts, drift, lookup, traverse
from ..operators.linearize import Options, linearize
from ..sources import gitlog, snapshot, state
from . import sqlguard

RENDER_DEPTH = 12


class Engine:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], project: str = "", meta: dict | None = None):
        self.spark, self.tables, self.project, self.meta = spark, tables, project, meta or {}

    @classmethod
    def open(cls, spark: SparkSession, project: str) -> Engine:
        folder = state.folder(project)
        return cls(spark, snapshot.read(spark, folder), project, snapshot.current(folder))

    # ---- symbols

    def find_symbol(self, name: str, compartment: str | None = None) -> DataFrame:
        return lookup.find_symbol(self.tables["symbols"], name, compartment)

    def _seed(self, name: str, compartment: str | None, file: str | None):
        """The symbol meant, or the matches if it is not clear which."""
        rows = lookup.symbol_matches(self.tables["symbols"], name, compartment, file).limit(lookup.MOST_MATCHES).collect()
        return (rows[0] if rows and (len(rows) == 1 or compartment or file) else None), rows

    @staticmethod
    def _unclear(name: str, rows: list) -> str:
        if not rows:
            return f"No symbol named {name}."
        return "\n".join([f"{name} is defined in {len(rows)} places; name a compartment or file:", *(f"  [{r['compartment']}] {r['file']}:{r['start_line']} ({r['kind']})" for r in rows)])

    def get_source(self, name: str, compartment: str | None = None, file: str | None = None, context: int = 0) -> str:
        seed, rows = self._seed(name, compartment, file)
        if seed is None:
            return self._unclear(name, rows)
        root = self.tables["compartments"].where(F.col("name") == seed["compartment"]).select("root").first()
        path = os.path.join(root[0] if root else "", seed["file"])
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                content = f.read()
        except OSError:
            return f"{path} can't be read."
        files = self.spark.createDataFrame([(seed["file"], content)], "file string, content string")
        spans = self.spark.createDataFrame([(seed["file"], seed["start_line"], seed["end_line"])], "file string, start_line long, end_line long")
        lines = lookup.source_lines(files, spans, context).orderBy("line").collect()
        cut = seed["end_line"] - seed["start_line"] + 1 > lookup.MOST_LINES
        return "\n".join([f"{seed['file']}:{seed['start_line']}-{seed['end_line']}", *(f"{r['line']}\t{r['text']}" for r in lines), *(["... cut off"] if cut else [])])

    # ---- graph

    def trace(self, name: str, direction: str = "out", compartment: str | None = None, file: str | None = None, depth: int = 3, include_tests: bool = False) -> str:
        """Callees (out) or callers (in) as a tree; more frequent calls first, each symbol opened once."""
        seed, rows = self._seed(name, compartment, file)
        if seed is None:
            return self._unclear(name, rows)
        symbols, edges = self.tables["symbols"], self.tables["edges"]
        found = traverse.reach(edges, symbols, self.spark.createDataFrame([(seed["id"],)], "id string"), depth, direction, include_tests)
        depths = {r["id"]: r["depth"] for r in found.collect()}
        ids = found.select("id")
        known = {r["id"]: r for r in symbols.join(ids, "id", "left_semi").collect()}
        adj = traverse.adjacency(edges, direction)
        inner = adj.join(ids.withColumnRenamed("id", "near"), "near", "left_semi").join(ids.withColumnRenamed("id", "far"), "far", "left_semi")
        kids: dict[str, list] = {}
        most = traverse.clamp(depth, 1, 8, 3)
        for r in inner.collect():
            if depths[r["near"]] <= most:
                kids.setdefault(r["near"], []).append(r)
        lines, opened, unclear = [], set(), 0

        def draw(i: str, level: int, mark: str) -> None:
            nonlocal unclear
            s = known[i]
            again = i in opened and kids.get(i)
            lines.append(f"{'  ' * level}{s['name']} [{s['compartment']}] {s['file']}:{s['start_line']}{mark}{' … (already shown)' if again else ''}")
            if i in opened or level >= RENDER_DEPTH:
                return
            opened.add(i)
            for r in sorted(kids.get(i, ()), key=lambda r: (-(r["cnt"] or 0), r["far"])):
                unclear += r["resolution"] == "ambiguous"
                draw(r["far"], level + 1, " ~ambiguous" if r["resolution"] == "ambiguous" else "")

        draw(seed["id"], 0, "")
        if len(lines) == 1:
            return f"{name} has no {'callees' if direction == 'out' else 'callers'} in the graph."
        return "\n".join(([f"{unclear} of these calls are ambiguous: an upper bound"] if unclear else []) + lines)

    def path_between(self, start: str, goal: str, start_compartment: str | None = None, goal_compartment: str | None = None, max_hops: int = 12) -> str:
        symbols = self.tables["symbols"]
        a, b = (lookup.symbol_matches(symbols, n, c).select("id") for n, c in ((start, start_compartment), (goal, goal_compartment)))
        rows = traverse.shortest_path(self.tables["edges"], a, b, max_hops).orderBy("hop").collect()
        if not rows:
            return f"No path from {start} to {goal}."
        ids = self.spark.createDataFrame([(r["id"],) for r in rows], "id string")
        names = {r["id"]: f"{r['compartment']}:{r['file']}:{r['name']}" for r in symbols.join(ids, "id", "left_semi").collect()}
        names |= {r["id"]: f":{r['file']}:{r['name']}" for r in self.tables["contracts"].join(ids, "id", "left_semi").collect()}
        return f"{len(rows) - 1} hop(s): " + " -> ".join(names.get(r["id"], r["id"]) for r in rows)

    def trace_contract(self, contract: str, token: str | None = None, include_tests: bool = False) -> str:
        symbols, refs = self.tables["symbols"], self.tables["edges"].where("type = 'REFERENCES'")
        named = self.tables["contracts"].where(name_contains(F.col("name"), contract))
        tokens = self.tables["contract_tokens"].join(named.select(F.col("id").alias("contract")), "contract", "left_semi")
        if token:
            tokens = tokens.where(F.col("token") == token)
        states = contracts.token_drift(tokens, refs, symbols, include_tests).orderBy("contract", "token").collect()
        found = contracts.contract_references(refs, symbols if include_tests else symbols.where(~is_test(F.col("file"))), named, contract, token).collect()
        heads = {r["id"]: r["name"] for r in named.collect()}
        if not heads:
            return f"No contract matches {contract}."
        out = []
        for cid, name in sorted(heads.items(), key=lambda x: x[1]):
            own = [r for r in states if r["contract"] == cid]
            by = {s: [r["token"] for r in own if r["status"] == s] for s in ("satisfied", "one-sided", "unreferenced")}
            flag = " DRIFT" if by["unreferenced"] else " (warning)" if by["one-sided"] else ""
            out.append(f"Contract {name}: {len(by['satisfied'])}/{len(own)} tokens satisfied, {len(by['one-sided'])} one-sided, {len(by['unreferenced'])} unreferenced{flag}")
            for s in ("unreferenced", "one-sided"):
                out += [f"  {s}: {t}" for t in by[s][:40]] + ([f"  ... {len(by[s]) - 40} more"] if len(by[s]) > 40 else [])
            places: dict[tuple, list[str]] = {}
            for r in found:
                if r["contract"] == name:
                    places.setdefault((r["compartment"], r["file"], r["start_line"], r["name"]), []).append(r["token"])
            for (c, f, line, n), ts in sorted(places.items()):
                ts = sorted(set(ts))
                out.append(f"  [{c}] {f}:{line} {n}: {', '.join(ts[:10])}" + (f", +{len(ts) - 10} more" if len(ts) > 10 else ""))
        notes = [] if include_tests else ["(test files left out)"]
        if self.meta.get("seams_stale"):
            notes.append("note: code that refers to contracts changed its structure since they were inferred; infer them again")
        return "\n".join(out + notes)

    def linearize(self, spec: str, file: str | None = None, options: Options | None = None) -> str:
        return linearize(self.tables, spec, file, options)

    # ---- whole graph

    def graph_stats(self) -> str:
        out = [f"{r['label']}: {r['n']}" for r in lookup.node_counts(self.tables).collect()]
        out += [f"{r['type']}: {r['n']}" for r in lookup.edge_counts(self.tables["edges"]).collect()]
        members = state.member_roots(self.project) if self.project else []
        roots = {r["name"]: r["owner"] for r in lookup.owner_roots(self.tables["compartments"], members, self.project).collect()}
        rows = lookup.symbols_per_compartment(self.tables["symbols"], self.tables["compartments"]).collect()
        linked = [r for r in rows if members and roots.get(r["compartment"]) not in (members[0], self.project)]
        for title, part in (("Own", [r for r in rows if r not in linked]), ("Linked", linked)):
            if part:
                out += ([f"{title}:"] if linked else []) + [f"  [{r['compartment']}] {r['n']} symbols" for r in part]
        return "\n".join(out)

    def stale(self) -> DataFrame:
        """Files of the project that changed since the build."""
        rows = []
        for root in state.member_roots(self.project):
            for path in gitlog.changed_files(root, None) or []:
                try:
                    s = os.stat(path)
                    rows.append((path, s.st_mtime * 1000, s.st_size))
                except OSError:
                    rows.append((path, None, None))
        known = lookup.absolute_paths(self.tables["files"], self.tables["compartments"]).join(self.tables["files"].select("id", "mtime", "size"), "id")
        return drift.stale_files(self.spark.createDataFrame(rows, "abs string, mtime_ms double, size long"), known.select("abs", "mtime", "size"))

    def graph_status(self) -> str:
        stale = self.stale().orderBy("abs").collect()
        settings = state.load(self.project) or {}
        out = [self.graph_stats(), f"posture: {settings.get('posture', 'unset')}", f"snapshot: {self.meta.get('snapshot')}"]
        out.append("fresh" if not stale else f"STALE: {len(stale)} file(s): " + ", ".join(r["abs"] for r in stale[:5]) + (" ..." if len(stale) > 5 else ""))
        out += [f"note: {k.replace('_', ' ')}" for k in ("structural_drift", "seams_stale") if self.meta.get(k)]
        if self.project and (d := gitlog.divergence(self.project)):
            out.append(f"upstream: {d[0]} ahead, {d[1]} behind")
        return "\n".join(out)

    def query_sql(self, query: str) -> str:
        meta = self.spark.createDataFrame([(k, str(v)) for k, v in sorted(self.meta.items())], "key string, value string")
        return sqlguard.answer(self.spark, self.tables | {"meta": meta}, query)

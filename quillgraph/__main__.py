"""Command line: python -m quillgraph COMMAND --project DIR ..."""

from __future__ import annotations

import argparse
import os
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import drawing, usage
from .operators.linearize import Options
from .plans import build
from .plans.engine import Engine
from .sources import snapshot, specs, state, tree, usagelog


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="quillgraph")
    ap.add_argument("command", choices="build update stats status find source callees callers path contract sql linearize gexf html seams apply-seams link unlink links former forget posture init usage global-usage scope".split())
    ap.add_argument("args", nargs="*")
    ap.add_argument("--project", default=os.getcwd())
    for name in ("compartment", "file", "token", "server", "mode", "contract"):
        ap.add_argument(f"--{name}")
    for name, default in (("depth", 3), ("context", 0), ("up", 3), ("down", 1), ("max", 60), ("hops", 12)):
        ap.add_argument(f"--{name}", type=int, default=default)
    ap.add_argument("--breadth", default="medium", choices=["tight", "medium", "full"])
    ap.add_argument("--ambiguous", default="stub", choices=["skip", "stub", "follow"])
    ap.add_argument("--include-tests", action="store_true")
    o = ap.parse_args(argv)
    project = os.path.realpath(o.project)
    roots, folder, a = state.member_roots(project), state.folder(project), o.args
    if o.command in ("link", "unlink"):
        (state.link if o.command == "link" else state.unlink)(project, a[0])
    elif o.command in ("links", "former"):
        print("\n".join(roots if o.command == "links" else state.former_links(project)))
    elif o.command == "forget":
        state.forget_links(project)
    elif o.command == "posture":
        print(state.set_posture(project, a[0])["posture"])
    elif o.command == "init":
        state.seed(project)
    elif o.command == "scope":
        print(tree.scope(project))
    else:
        spark = SparkSession.builder.appName("quillgraph").getOrCreate()
        if o.command == "build":
            state.update(project)
            state.register(project)
            snapshot.write(folder, build.build(spark, project, roots, o.server), members=roots[1:])
            print(Engine.open(spark, project).graph_stats())
        elif o.command == "update":
            stored = snapshot.read(spark, folder)
            files = [os.path.realpath(f) for f in a] or [r["abs"] for r in Engine.open(spark, project).stale().collect()]
            tables, flags = build.incremental(spark, stored, project, roots, files, o.server)
            snapshot.write(folder, tables, meta=flags)
            print(flags)
        elif o.command == "usage":
            log = usagelog.read_usage(spark, os.path.join(folder, "usage.jsonl"))
            patterns = log.where("kind = 'grep' AND pattern IS NOT NULL").select("pattern")
            gap = usage.adoption_gap(patterns, snapshot.read(spark, folder)["symbols"]).agg({"n": "sum"}).first()[0] if snapshot.current(folder) else 0
            print(usage.report(usage.summary(log).first().asDict(), usage.read_residency(usage.from_log(log)).agg({"recurring": "sum"}).first()[0], gap or 0))
        elif o.command == "global-usage":
            logs = [(p, path) for p in state.registered() if os.path.exists(path := os.path.join(state.folder(p), "usage.jsonl"))]
            parts = [usagelog.read_usage(spark, path).withColumn("project", F.lit(os.path.basename(p))) for p, path in logs]
            print(usage.global_report(usage.by_project(reduce(DataFrame.unionByName, parts)).collect() if parts else []))
        else:
            e = Engine.open(spark, project)
            if o.command in ("gexf", "html"):
                nodes, links = drawing.gather(e.tables, o.mode or ("contract" if o.contract else "wires" if o.command == "gexf" else "contracts"), o.contract, o.up, o.down, o.include_tests)
                with open(a[0], "w", encoding="utf-8") as f:
                    f.write(drawing.gexf(nodes, links) if o.command == "gexf" else drawing.html(nodes, links, os.path.basename(project)))
            elif o.command in ("seams", "apply-seams"):
                seams = build.infer_seams(e.tables)
                print(specs.format_seams(seams))
                if o.command == "apply-seams":
                    specs.apply(specs.synthesize(seams), os.path.join(specs.contracts_home(project), "inferred.asyncapi.yaml"), os.path.join(folder, "backups"))
            else:
                print({
                    "stats": e.graph_stats, "status": e.graph_status, "find": lambda: "\n".join(f"[{r['compartment']}] {r['file']}:{r['start_line']} {r['kind']} {r['name']}" for r in e.find_symbol(a[0], o.compartment).collect()),
                    "source": lambda: e.get_source(a[0], o.compartment, o.file, o.context), "callees": lambda: e.trace(a[0], "out", o.compartment, o.file, o.depth, o.include_tests),
                    "callers": lambda: e.trace(a[0], "in", o.compartment, o.file, o.depth, o.include_tests), "path": lambda: e.path_between(a[0], a[1], max_hops=o.hops), "contract": lambda: e.trace_contract(a[0], o.token, o.include_tests),
                    "sql": lambda: e.query_sql(a[0]), "linearize": lambda: e.linearize(a[0], o.file, Options(o.breadth, o.depth, o.max, True, o.ambiguous, o.include_tests)),
                }[o.command]())
    return 0


if __name__ == "__main__":
    sys.exit(main())

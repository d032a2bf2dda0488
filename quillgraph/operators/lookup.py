"""Symbol lookup, source slices and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .traverse import clamp

MOST_MATCHES, MOST_LINES = 100, 400


def symbol_matches(symbols: DataFrame, name: str, compartment: str | None = None, file: str | None = None) -> DataFrame:
    """Symbols of exactly this name, in order of compartment, file and line; modules never match."""
    found = symbols.where((F.col("name") == name) & (F.col("kind") != "module"))
    if compartment:
        found = found.where(F.col("compartment") == compartment)
    if file:
        found = found.where(F.instr("file", file) > 0)
    return found.orderBy("compartment", "file", "start_line", "id")


def find_symbol(symbols: DataFrame, name: str, compartment: str | None = None) -> DataFrame:
    return symbol_matches(symbols, name, compartment).limit(MOST_MATCHES)


def source_lines(files: DataFrame, spans: DataFrame, context: int = 0) -> DataFrame:
    """file, line, text of each span (file, start_line, end_line) in files (file, content), with lines around it; at most MOST_LINES each."""
    extra = max(0, min(20, int(context or 0)))
    known = spans.where("end_line >= start_line AND start_line > 0")
    rows = known.join(files, "file").withColumn("lines", F.split("content", "\n"))
    first = F.greatest(F.lit(1), F.col("start_line") - extra)
    last = F.least(F.size("lines").cast("long"), F.col("end_line") + extra, first + MOST_LINES - 1)
    rows = rows.withColumns({"first": first, "last": last}).where("last >= first")
    part = F.expr("slice(lines, int(first), int(last - first + 1))")
    return rows.select("file", "start_line", "first", F.posexplode(part).alias("i", "text")).select("file", "start_line", (F.col("first") + F.col("i")).alias("line"), "text")


def node_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """label, n for the node tables; those without rows are left out."""
    names = {"compartments": "Compartment", "files": "File", "symbols": "Symbol", "contracts": "Contract"}
    out = None
    for key, label in names.items():
        one = tables[key].agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n")
        out = one if out is None else out.union(one)
    return out.where("n > 0")


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def symbols_per_compartment(symbols: DataFrame, compartments: DataFrame) -> DataFrame:
    """compartment, root, n: symbols other than modules; the root is null for an unknown compartment."""
    n = symbols.where("kind <> 'module'").groupBy("project", "compartment").agg(F.count("*").alias("n"))
    known = compartments.select("project", F.col("name").alias("compartment"), "root")
    return n.join(known, ["project", "compartment"], "left").select("compartment", "root", "n").orderBy(F.desc("n"), "compartment")


def owner_roots(compartments: DataFrame, members: list[str], fallback: str) -> DataFrame:
    """name, root, owner: the longest member root that is the compartment's root or an ancestor of it."""
    owner = F.lit(fallback)
    for m in sorted(members, key=len):  # the longest is tested first
        m = m.rstrip("/")
        owner = F.when((F.col("root") == m) | F.startswith("root", F.lit(m + "/")), m).otherwise(owner)
    return compartments.select("name", "root", owner.alias("owner"))


def absolute_paths(files: DataFrame, compartments: DataFrame) -> DataFrame:
    known = compartments.select("project", F.col("name").alias("compartment"), "root")
    return files.join(known, ["project", "compartment"]).select("id", "compartment", "path", F.concat_ws("/", "root", "path").alias("abs"))


__all__ = ["absolute_paths", "clamp", "edge_counts", "find_symbol", "node_counts", "owner_roots", "source_lines", "symbol_matches", "symbols_per_compartment"]

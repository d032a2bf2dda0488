"""Resolution of calls by name, with preference for the caller's own file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import edge

#: A name with more candidates than this stands for nothing in particular.
MOST_CANDIDATES = 6


def resolve_calls(calls: DataFrame, symbols: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """src, dst, cnt, line (of the first call), resolution for calls (from_id, compartment, file, name, line).

    Candidates are the symbols of that name in the caller's compartment; if the caller's file has some, only those. Calls without
    candidates or with more than `most` are dropped, then those to the caller itself. Calls are first counted per caller and name. Those with
    candidates in their own file meet them by compartment, file and name; only the others meet candidates by compartment and name, and only
    names with at most `most` candidates. So no join makes more than `most` rows of one, however common a name is.
    """
    sites = calls.groupBy("from_id", "compartment", "file", "name").agg(F.count("*").alias("cnt"), F.min("line").alias("line"))
    defs = symbols.where("kind <> 'module'").select("compartment", "file", "name", F.col("id").alias("dst"))
    same = defs.groupBy("compartment", "file", "name").agg(F.count("*").alias("n"))
    every = same.groupBy("compartment", "name").agg(F.sum("n").alias("n"))
    columns = ["from_id", "dst", "cnt", "line", "n"]
    here = sites.join(same.where(F.col("n") <= most), ["compartment", "file", "name"]).join(defs, ["compartment", "file", "name"])
    away = sites.join(same, ["compartment", "file", "name"], "left_anti").drop("file")
    away = away.join(every.where(F.col("n") <= most), ["compartment", "name"]).join(defs.drop("file"), ["compartment", "name"])
    found = here.select(columns).unionByName(away.select(columns)).where("dst <> from_id")
    resolution = F.when(F.min("n") == 1, "unique").otherwise("ambiguous")
    return found.groupBy(F.col("from_id").alias("src"), "dst").agg(F.sum("cnt").alias("cnt"), F.min("line").alias("line"), resolution.alias("resolution"))


def resolve_with_store(calls: DataFrame, fresh: DataFrame, stored: DataFrame, changed: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """As `resolve_calls`, against fresh symbols and the stored ones of files that did not change (compartment, file)."""
    kept = stored.join(changed, ["compartment", "file"], "left_anti")
    columns = ["id", "compartment", "file", "name", "kind"]
    return resolve_calls(calls, fresh.select(columns).unionByName(kept.select(columns)), most)


def call_edges(resolved: DataFrame, project: str) -> DataFrame:
    return resolved.select(*edge("CALLS", F.col("src"), F.col("dst"), F.lit(project), cnt=F.col("cnt"), resolution=F.col("resolution"), evidence=F.lit("static")))

"""Reach, shortest paths and counted walks over edges, as loops over frontiers.

A hop is one join of the frontier with the adjacency and one anti-join against what was visited; each hop is cut from its
lineage. The number of hops is bounded by the tools' own limits, not by the graph.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_test
from ..tables import cut


def clamp(value, low: int, high: int, default: int) -> int:
    """A whole number between the limits; what is no number, or 0, is the default."""
    try:
        n = int(float(value) // 1)
    except (TypeError, ValueError, OverflowError):
        n = 0
    return max(low, min(high, n or default))


def adjacency(edges: DataFrame, direction: str = "out") -> DataFrame:
    """near, far, cnt, resolution of CALLS; direction 'in' swaps the ends."""
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    return edges.where("type = 'CALLS'").select(F.col(a).alias("near"), F.col(b).alias("far"), "cnt", "resolution")


def reach(edges: DataFrame, symbols: DataFrame, seeds: DataFrame, depth: int = 3, direction: str = "out", include_tests: bool = False) -> DataFrame:
    """id, depth of all symbols within depth + 1 hops of `seeds` (id); tests are neither listed nor passed unless asked for, the seeds always."""
    hops = clamp(depth, 1, 8, 3) + 1
    adj = adjacency(edges, direction).select("near", "far")  # each hop drops repeats, so that all edges need not be shuffled for it
    open_ = symbols if include_tests else symbols.where(~is_test(F.col("file")))
    adj = cut(adj.join(open_.select(F.col("id").alias("far")), "far", "left_semi"))
    seen = cut(seeds.select("id").distinct().withColumn("depth", F.lit(0)))
    frontier, parts = seen, [seen]
    for hop in range(1, hops + 1):
        new = adj.join(frontier.select(F.col("id").alias("near")), "near", "left_semi").select(F.col("far").alias("id")).distinct()
        frontier = cut(new.join(seen, "id", "left_anti").withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            break
        parts.append(frontier)
        seen = reduce(DataFrame.unionByName, parts)
    return reduce(DataFrame.unionByName, parts)


def shortest_path(edges: DataFrame, starts: DataFrame, goals: DataFrame, max_hops: int = 12, types: tuple[str, ...] = ("CALLS", "REFERENCES", "IMPORTS")) -> DataFrame:
    """hop, id of one shortest undirected path from any of `starts` to any of `goals` (id); empty if there is none within max_hops.

    Among equally short ones: the smallest goal, then from the goal back the smallest predecessor.
    """
    hops = clamp(max_hops, 1, 20, 12)
    one = edges.where(F.col("type").isin(*types)).select("src", "dst")
    both = cut(one.union(one.select("dst", "src")).where("src <> dst"))
    level = cut(starts.select("id").distinct().select("id", F.lit(None).cast("string").alias("prev"), F.lit(0).alias("hop")))
    levels = [level]
    goals = cut(goals.select("id").distinct())
    while True:
        hit = levels[-1].join(goals, "id", "left_semi").agg(F.min("id")).first()[0]
        if hit is not None or len(levels) > hops:
            break
        seen = reduce(DataFrame.unionByName, levels).select("id")
        new = both.join(levels[-1].select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("prev"))
        new = cut(new.join(seen, "id", "left_anti").withColumn("hop", F.lit(len(levels))))
        if new.isEmpty():
            break
        levels.append(new)
    path = []
    for hop in range(len(levels) - 1, -1, -1):
        if hit is None:
            break
        path.append((hop, hit))
        hit = levels[hop].where(F.col("id") == hit).select("prev").first()[0]
    return edges.sparkSession.createDataFrame(path[::-1], "hop int, id string")


def walks(edges: DataFrame, symbols: DataFrame, seeds: DataFrame, hops: int, direction: str = "out", include_tests: bool = False) -> DataFrame:
    """src, dst, walks: how many walks of up to `hops` calls from `seeds` (id) end with each call; counts instead of walks are carried on."""
    open_ = symbols if include_tests else symbols.where(~is_test(F.col("file")))
    open_ = open_.select("id")
    adj = adjacency(edges, direction).select("near", "far").join(open_.withColumnRenamed("id", "near"), "near", "left_semi").join(open_.withColumnRenamed("id", "far"), "far", "left_semi")
    adj = cut(adj)
    frontier = seeds.select("id").distinct().withColumn("n", F.lit(1).cast("long"))
    parts = []
    for _ in range(hops):
        step = cut(adj.join(frontier.withColumnRenamed("id", "near"), "near").select("near", "far", "n"))
        if step.isEmpty():
            break
        parts.append(step)
        frontier = step.groupBy(F.col("far").alias("id")).agg(F.sum("n").alias("n"))
    src, dst = ("near", "far") if direction == "out" else ("far", "near")
    if not parts:
        return edges.sparkSession.createDataFrame([], "src string, dst string, walks long")
    return reduce(DataFrame.unionByName, parts).groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.sum("n").alias("walks"))


def neighbor_compartments(edges: DataFrame, symbols: DataFrame, compartment: str | None = None) -> DataFrame:
    """compartment, neighbor: the compartments one call away from `compartment`, itself included; from each compartment if none is given."""
    of = symbols.select("id", "compartment")
    calls = edges.where("type = 'CALLS'").join(of.toDF("src", "a"), "src").join(of.toDF("dst", "b"), "dst").select("a", "b").distinct()
    own = symbols.select(F.col("compartment").alias("a"), F.col("compartment").alias("b")).distinct()
    out = calls.union(calls.select("b", "a")).union(own).distinct().toDF("compartment", "neighbor")
    return out if compartment is None else out.where(F.col("compartment") == compartment)

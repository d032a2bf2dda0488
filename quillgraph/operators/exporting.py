"""Nodes and links of the graph for drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import is_test
from .traverse import walks


def kept_symbols(symbols: DataFrame, include_tests: bool) -> DataFrame:
    return symbols if include_tests else symbols.where(~is_test(F.col("file")))


def collapse(links: DataFrame, distinct_tokens: bool = False) -> DataFrame:
    """One link per (source, target, type): summed count, distinct tokens, smallest contract and direction. With `distinct_tokens` a reference counts its tokens."""
    out = links.groupBy("source", "target", "type").agg(
        F.sum(F.coalesce(F.expr("nullif(count, 0)"), F.lit(1))).alias("count"), F.array_sort(F.collect_set("token")).alias("tokens"), F.min("contract").alias("contract"), F.min("direction").alias("direction")
    )
    if distinct_tokens:
        out = out.withColumn("count", F.when(F.col("type") == "REFERENCES", F.greatest(F.lit(1), F.size("tokens")).cast("long")).otherwise(F.col("count")))
    return out


def all_links(edges: DataFrame, symbols: DataFrame, types: tuple[str, ...] = ("CALLS", "WIRE"), include_tests: bool = False, contracts: DataFrame | None = None) -> DataFrame:
    """source, target, type, token, contract, direction, count of edges between nodes that are shown."""
    ids = kept_symbols(symbols, include_tests).select("id")
    if contracts is not None:
        ids = ids.union(contracts.select("id"))
    rows = edges.where(F.col("type").isin(*types)).join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return rows.select(F.col("src").alias("source"), F.col("dst").alias("target"), "type", "token", "contract", "direction", F.col("cnt").alias("count"))


def contract_walk(edges: DataFrame, symbols: DataFrame, contract: str, up: int = 3, down: int = 1, include_tests: bool = False) -> DataFrame:
    """The wires of one contract and the calls above and below them; a call counts once for each walk that ends with it."""
    wires = all_links(edges.where(F.col("contract") == contract), symbols, ("WIRE",), include_tests)
    seeds = wires.select(F.col("source").alias("id")).union(wires.select("target")).distinct()
    above = walks(edges, symbols, seeds, max(0, min(6, up)), "in", include_tests)
    below = walks(edges, symbols, seeds, max(0, min(4, down)), "out", include_tests)
    none = F.lit(None).cast("string")
    calls = above.unionByName(below).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit("CALLS").alias("type"), none.alias("token"), none.alias("contract"), none.alias("direction"), F.col("walks").alias("count"))
    return collapse(wires.unionByName(calls))

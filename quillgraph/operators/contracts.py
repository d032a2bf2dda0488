"""Contracts: seams from signals, references from text, wires between producers and consumers, drift."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import asyncapi_path, is_distinctive, is_test
from ..schemas import edge, module_id

MOST_PAIRS = 25
#: Tokens that one scan of the files looks for together.
TOKENS_PER_SCAN = 200_000


def sorted_set(column) -> F.Column:
    return F.array_sort(F.collect_set(column))


def cluster_seams(candidates: DataFrame) -> DataFrame:
    """kind, token, compartments, in_compartments, out_compartments, labels: distinctive tokens that two or more compartments share."""
    token = F.when(F.col("kind") == "wire", asyncapi_path(F.col("token"))).otherwise(F.col("token"))
    rows = candidates.where("kind <> 'import'").withColumn("token", token).where(is_distinctive(F.col("token")))
    out = rows.groupBy("kind", "token").agg(
        sorted_set("compartment").alias("compartments"),
        sorted_set(F.when(F.col("role") == "in", F.col("compartment"))).alias("in_compartments"),
        sorted_set(F.when(F.col("role") == "out", F.col("compartment"))).alias("out_compartments"),
        sorted_set("label").alias("labels"),
    )
    return out.where(F.size("compartments") >= 2).orderBy("kind", "token")


def merge_contracts(tokens: DataFrame) -> DataFrame:
    """One row per (contract, token) of rows (contract, name, file, ord, token, direction, producers, consumers), arrays last: the first
    known direction by `ord`, the union of roles, the contract's first name and file."""
    w = Window.partitionBy("contract").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = tokens.select("contract", "ord", F.first("name").over(w).alias("name"), F.first("file").over(w).alias("file")).select("contract", "name", "file").distinct()
    merged = tokens.groupBy("contract", "token").agg(
        F.min(F.when(F.col("direction").isNotNull(), F.struct("ord", "direction"))).alias("d"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("producers")))).alias("producers"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("consumers")))).alias("consumers"),
    )
    return merged.join(heads, "contract").select("contract", "name", "file", "token", F.col("d.direction").alias("direction"), "producers", "consumers")


def token_hits(texts: DataFrame, tokens: list[str], bounded: bool = True) -> DataFrame:
    """file_key, token, line for texts (file_key, content): each token that stands in the text, with the line of its first occurrence.

    A token with a slash counts anywhere; another one (if `bounded`) only if it stands somewhere between word boundaries, though the line is
    that of its first occurrence of any kind. All tokens are looked for in one pass over each text (Aho-Corasick), TOKENS_PER_SCAN at a time.
    """
    parts = [tokens[i : i + TOKENS_PER_SCAN] for i in range(0, len(tokens), TOKENS_PER_SCAN)] or [[]]
    out = None
    for part in parts:

        def run(batches: Iterator[pa.RecordBatch], part: list[str] = part) -> Iterator[pa.RecordBatch]:
            finder = ahocorasick.Automaton()
            for t in part:
                finder.add_word(t, t)
            finder.make_automaton()
            for batch in batches:
                rows = []
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    text = text or ""
                    first: dict[str, int] = {}
                    for end, t in finder.iter(text) if part else ():
                        first.setdefault(t, end - len(t) + 1)
                    for t, at in first.items():
                        if not bounded or "/" in t or re.search(rf"\b{re.escape(t)}\b", text, re.ASCII):
                            rows.append((key, t, text.count("\n", 0, at) + 1))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["file_key", "token", "line"])

        found = texts.select("file_key", "content").mapInArrow(run, "file_key string, token string, line long")
        out = found if out is None else out.unionByName(found)
    return out


def enclosing_symbols(places: DataFrame, symbols: DataFrame) -> DataFrame:
    """places (compartment, file, line, ...) with `symbol`: the smallest symbol around the line, the first by id of equals, else the file's module."""
    spans = symbols.where("kind <> 'module'").select("compartment", "file", "id", "start_line", "end_line")
    spots = places.select("compartment", "file", "line").distinct()
    inner = spots.join(spans, ["compartment", "file"]).where("start_line <= line AND line <= end_line")
    best = inner.groupBy("compartment", "file", "line").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), F.col("start_line"), F.col("id"))).alias("b"))
    best = best.select("compartment", "file", "line", F.col("b.id").alias("inner"))
    return places.join(best, ["compartment", "file", "line"], "left").withColumn("symbol", F.coalesce("inner", module_id(F.col("compartment"), F.col("file")))).drop("inner")


def reference_edges(hits: DataFrame, tokens: DataFrame, symbols: DataFrame, project: str) -> DataFrame:
    """REFERENCES for hits (compartment, file, token, line) and contract tokens (contract, token): one per symbol, contract and token."""
    placed = enclosing_symbols(hits, symbols).select("symbol", "token").distinct()
    found = placed.join(tokens.select("contract", "token").distinct(), "token")
    found = found.join(symbols.select(F.col("id").alias("symbol")), "symbol", "left_semi")  # a text without any symbol has no module either
    return found.select(*edge("REFERENCES", F.col("symbol"), F.col("contract"), F.lit(project), token=F.col("token"), evidence=F.lit("contract-match")))


def wire_edges(references: DataFrame, symbols: DataFrame, tokens: DataFrame, project: str, server: str | None = None, own: str | None = None, most: int = MOST_PAIRS) -> DataFrame:
    """WIRE edges from REFERENCES (src, dst, token) and merged tokens (contract, name, token, direction, producers, consumers).

    Producers and consumers are the token's if it names any; else the side of the `server` compartment and the other one, turned by the
    direction; else there is no wire. Only across compartments. Contracts are taken in order of id: of each contract and token the first
    `most` pairs by (producer, consumer) stay that no contract before it has wired for that token. The k-th contract of a token thus needs no
    more than its first k * `most` pairs, and these no more than as many first symbols of each compartment, and twice as many of all, on
    each side: so much is ranked before pairs are formed, whatever the size of the group.
    """
    side = symbols.select(F.col("id").alias("src"), "compartment")
    rows = references.select("src", F.col("dst").alias("contract"), "token").distinct().join(side, "src").join(tokens, ["contract", "token"])
    if own:
        rows = rows.where(F.col("compartment") != own)
    roles = (F.size("producers") > 0) | (F.size("consumers") > 0)
    is_server = F.lit(False) if server is None else F.col("compartment") == server
    from_server = F.coalesce(F.col("direction") == "s2c", F.lit(False))
    out = F.when(roles, F.array_contains("producers", F.col("compartment"))).when(F.lit(server is not None), F.when(from_server, is_server).otherwise(~is_server)).otherwise(False)
    into = F.when(roles, F.array_contains("consumers", F.col("compartment"))).when(F.lit(server is not None), F.when(from_server, ~is_server).otherwise(is_server)).otherwise(False)
    label = F.when(roles, "c2s").when(from_server, "s2c").when(F.col("direction").isNull(), "c2s?").otherwise("c2s")
    rows = rows.select("contract", "name", "token", "src", "compartment", out.alias("out"), into.alias("into"), label.alias("direction"))

    place = F.dense_rank().over(Window.partitionBy("token").orderBy("contract"))
    turns = rows.select("token", "contract").distinct().withColumn("turn", place)
    turns = turns.withColumn("turns", F.max("turn").over(Window.partitionBy("token")))
    rows = rows.join(turns, ["token", "contract"])

    def first(which: str) -> DataFrame:
        own_rank = F.row_number().over(Window.partitionBy("contract", "token", "compartment").orderBy("src"))
        kept = rows.where(which).withColumn("r", own_rank).where(F.col("r") <= most * F.col("turn"))
        all_rank = F.row_number().over(Window.partitionBy("contract", "token").orderBy("src"))
        return kept.withColumn("r", all_rank).where(F.col("r") <= 2 * most * F.col("turn")).drop("r", "out", "into")

    producers, consumers = first("out"), first("into")
    q = consumers.where("turns = 1").select("contract", "token", F.col("src").alias("q"), F.col("compartment").alias("qc"))
    pairs = producers.where("turns = 1").withColumnRenamed("src", "p").join(q, ["contract", "token"]).where("p <> q AND compartment <> qc")
    rank = F.row_number().over(Window.partitionBy("contract", "token").orderBy("p", "q"))
    columns = ["name", "token", "p", "q", "direction"]
    alone = pairs.withColumn("r", rank).where(F.col("r") <= most).select(columns)
    sides = producers.withColumn("side", F.lit(0)).unionByName(consumers.withColumn("side", F.lit(1))).where("turns > 1")
    shared = sides.groupBy("token").applyInPandas(_shared_token(most), "name string, token string, p string, q string, direction string")
    return alone.union(shared).select(*edge("WIRE", F.col("p"), F.col("q"), F.lit(project), token=F.col("token"), contract=F.col("name"), direction=F.col("direction"), evidence=F.lit("wire-derived")))


def _shared_token(most: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """The wires of a token that several contracts have, contract by contract; its rows are few (see `wire_edges`)."""
        wired: set[tuple[str, str]] = set()
        out = []
        for _, own in rows.sort_values("src").groupby("turn", sort=True):
            producers, consumers = own[own.side == 0], own[own.side == 1]
            fresh = ((p, q) for p, pc in zip(producers.src, producers.compartment, strict=True) for q, qc in zip(consumers.src, consumers.compartment, strict=True) if p != q and pc != qc and (p, q) not in wired)
            found = [pair for pair, _ in zip(fresh, range(most), strict=False)]
            wired.update(found)
            out += [(own.name.iloc[0], own.token.iloc[0], p, q, own.direction.iloc[0]) for p, q in found]
        return pd.DataFrame(out, columns=["name", "token", "p", "q", "direction"])

    return run


def token_drift(tokens: DataFrame, references: DataFrame, symbols: DataFrame, include_tests: bool = False) -> DataFrame:
    """contract, token, n (referencing compartments), status of each defined token: satisfied, one-sided or unreferenced."""
    seen = symbols if include_tests else symbols.where(~is_test(F.col("file")))
    refs = references.where("token IS NOT NULL").join(seen.select(F.col("id").alias("src"), "compartment"), "src")
    n = refs.groupBy(F.col("dst").alias("contract"), "token").agg(F.countDistinct("compartment").alias("n"))
    defined = tokens.select("contract", "token").distinct()
    out = defined.join(n, ["contract", "token"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n") == 0, "unreferenced").when(F.col("n") == 1, "one-sided").otherwise("satisfied"))


def contract_drift(drift: DataFrame) -> DataFrame:
    """contract, total, satisfied, one_sided, unreferenced, status (ok, one-sided, drift)."""
    number = lambda s: F.sum((F.col("status") == s).cast("long"))
    out = drift.groupBy("contract").agg(F.count("*").alias("total"), number("satisfied").alias("satisfied"), number("one-sided").alias("one_sided"), number("unreferenced").alias("unreferenced"))
    return out.withColumn("status", F.when(F.col("unreferenced") > 0, "drift").when(F.col("one_sided") > 0, "one-sided").otherwise("ok"))


def contract_links(references: DataFrame, symbols: DataFrame, contracts: DataFrame) -> DataFrame:
    """contract, a, b, tokens, functions: an edge for each two compartments that reference a contract; a contract with one or none has b or both null."""
    refs = references.select("src", F.col("dst").alias("contract"), "token").join(symbols.select(F.col("id").alias("src"), "compartment"), "src")
    sides = refs.groupBy("contract", "compartment").agg(F.collect_set("token").alias("tokens"), F.countDistinct("src").alias("functions"))
    a, b = sides.toDF("contract", "a", "ta", "fa"), sides.toDF("contract", "b", "tb", "fb")
    pairs = a.join(b, "contract").where("a < b").select("contract", "a", "b", F.array_sort(F.array_union("ta", "tb")).alias("tokens"), (F.col("fa") + F.col("fb")).alias("functions"))
    alone = sides.join(pairs.select("contract").distinct(), "contract", "left_anti").select("contract", F.col("compartment").alias("a"), F.lit(None).cast("string").alias("b"), F.array_sort("tokens").alias("tokens"), "functions")
    none = contracts.select(F.col("id").alias("contract")).join(sides.select("contract").distinct(), "contract", "left_anti")
    none = none.select("contract", F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), F.array().cast("array<string>").alias("tokens"), F.lit(0).cast("long").alias("functions"))
    return pairs.unionByName(alone).unionByName(none)


def contract_references(references: DataFrame, symbols: DataFrame, contracts: DataFrame, part: str, token: str | None = None) -> DataFrame:
    """contract, compartment, file, name, start_line, token of references to contracts whose name contains `part` (case-insensitive; % and _ are wild)."""
    from ..functions.predicates import name_contains

    found = references.join(symbols.select(F.col("id").alias("src"), "compartment", "file", F.col("name").alias("symbol"), "start_line"), "src")
    found = found.join(contracts.select(F.col("id").alias("dst"), F.col("name").alias("contract_name")), "dst").where(name_contains(F.col("contract_name"), part))
    if token:
        found = found.where(F.col("token") == token)
    return found.select(F.col("contract_name").alias("contract"), "compartment", "file", F.col("symbol").alias("name"), "start_line", "token").orderBy("contract", "compartment", "file", "start_line")

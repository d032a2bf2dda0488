"""From source trees to graph tables: a full build, and one for changed files only.

Each stage is a function of DataFrames. The one step in Python workers is extraction, once per file; calls, signals and files are kept beside
the graph, so an incremental build extracts only what changed and derives edges again from the same tables as a full build: both give
the same graph.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract import parse_source
from ..functions.predicates import is_distinctive
from ..operators import contracts, drift, imports, resolve
from ..schemas import CANDIDATES, CONTRACT_TOKENS, CONTRACTS, MODULE, RAW_CALLS, compartment_id, edge, file_id, module_id, symbol_id
from ..sources import snapshot, specs, tree
from ..tables import cut

_EXTRACT = (
    "compartment string, file string, lang string, symbols array<struct<name:string,kind:string,start_line:bigint,end_line:bigint>>, "
    "calls array<struct<from_id:string,name:string,line:bigint>>, signals array<struct<kind:string,token:string,role:string,label:string,line:bigint>>"
)


def extract(sources: DataFrame) -> DataFrame:
    """Symbols, calls and signals of each source file; a file that can't be parsed has none."""
    kinds = [
        pa.string(), pa.string(), pa.string(),
        pa.list_(pa.struct([("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64())])),
        pa.list_(pa.struct([("from_id", pa.string()), ("name", pa.string()), ("line", pa.int64())])),
        pa.list_(pa.struct([("kind", pa.string()), ("token", pa.string()), ("role", pa.string()), ("label", pa.string()), ("line", pa.int64())])),
    ]
    names = ["compartment", "file", "lang", "symbols", "calls", "signals"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for compartment, file, lang, variant, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    found = parse_source(lang, variant, content or "")
                except Exception:  # a recognizer's failure costs one file, not the build
                    found = parse_source(None, None, "")
                own = [f"sym:{compartment}:{file}:{n}:{a}" for n, _, a, _ in found.symbols]
                top = f"sym:{compartment}:{file}:{MODULE}:0"
                rows.append((
                    compartment, file, lang, [dict(zip(("name", "kind", "start_line", "end_line"), s, strict=True)) for s in found.symbols],
                    [{"from_id": top if e is None else own[e], "name": n, "line": line} for e, n, line in found.calls],
                    [dict(zip(("kind", "token", "role", "label", "line"), s, strict=True)) for s in found.signals],
                ))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return sources.select("compartment", F.col("rel_path").alias("file"), "lang", "variant", "content").mapInArrow(run, _EXTRACT)


def nodes(sources: DataFrame, found: DataFrame, project: str) -> dict[str, DataFrame]:
    p = F.lit(project).alias("project")
    c, f = F.col("compartment"), F.col("file")
    zero = F.lit(0).cast("long")
    own = found.select("compartment", "file", "lang", F.explode("symbols").alias("s"))
    symbols = own.select(symbol_id(c, f, F.col("s.name"), F.col("s.start_line")).alias("id"), p, "compartment", "file", F.col("s.name").alias("name"), F.col("s.kind").alias("kind"), "lang", F.col("s.start_line").alias("start_line"), F.col("s.end_line").alias("end_line"))
    modules = found.select(module_id(c, f).alias("id"), p, "compartment", "file", F.lit(MODULE).alias("name"), F.lit("module").alias("kind"), "lang", zero.alias("start_line"), zero.alias("end_line"))
    calls = found.select("compartment", "file", F.explode("calls").alias("c")).select("c.from_id", "compartment", "file", "c.name", "c.line")
    signals = found.select("compartment", "file", F.explode("signals").alias("s")).select("s.kind", "s.token", "s.role", "s.label", "compartment", "file", "s.line")
    return {
        "compartments": sources.groupBy("compartment").agg(F.min("compartment_root").alias("root")).select(compartment_id(c).alias("id"), p, c.alias("name"), "root"),
        "files": sources.select(file_id(c, F.col("rel_path")).alias("id"), p, "compartment", F.col("rel_path").alias("path"), "lang", F.col("mtime_ms").alias("mtime"), "size"),
        "symbols": symbols.unionByName(modules).dropDuplicates(["id"]), "raw_calls": calls, "candidates": signals,
    }


def contract_tables(spec_tokens: DataFrame, project: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """contracts, contract_tokens as stored, and the merged tokens that wires need."""
    merged = contracts.merge_contracts(spec_tokens)
    named = merged.select(F.col("contract").alias("id"), F.lit(project).alias("project"), "name", "file").distinct()
    tokens = merged.where("token IS NOT NULL").where(is_distinctive(F.col("token")))
    stored = tokens.select(F.lit(project).alias("project"), "contract", "token", "direction", F.array_join("producers", ",").alias("producers"), F.array_join("consumers", ",").alias("consumers"))
    return named, stored, tokens


def references(sources: DataFrame, tokens: DataFrame, symbols: DataFrame, project: str) -> DataFrame:
    wanted = [r[0] for r in tokens.select("token").distinct().orderBy("token").collect()]  # tokens of specifications: few
    texts = sources.where("content IS NOT NULL").select(F.to_json(F.struct("compartment", "rel_path")).alias("file_key"), "content")
    hits = contracts.token_hits(texts, wanted).withColumn("k", F.from_json("file_key", "compartment string, rel_path string"))
    hits = hits.select(F.col("k.compartment").alias("compartment"), F.col("k.rel_path").alias("file"), "token", "line")
    return contracts.reference_edges(hits, tokens, symbols, project)


def derived(tables: dict[str, DataFrame], refs: DataFrame, tokens: DataFrame, packages: DataFrame, project: str, server: str | None, own: str | None) -> DataFrame:
    """All edges of the nodes, calls, signals and references."""
    p = F.lit(project)
    symbols, files = tables["symbols"], tables["files"]
    parts = [
        files.select(*edge("IN_COMPARTMENT", F.col("id"), compartment_id(F.col("compartment")), p)),
        symbols.select(*edge("DEFINED_IN", F.col("id"), file_id(F.col("compartment"), F.col("file")), p)),
        resolve.call_edges(resolve.resolve_calls(tables["raw_calls"], symbols), project), refs,
        contracts.wire_edges(refs, symbols, tokens, project, server, own),
        imports.import_edges(tables["candidates"], files, packages, project),
    ]
    return reduce(DataFrame.unionByName, parts)


def build(spark: SparkSession, project: str, roots: list[str], server: str | None = None, own: str | None = None, spec_dirs: list[str] | None = None) -> dict[str, DataFrame]:
    """The graph of the roots (a project and its linked members), with the calls and signals that incremental builds need."""
    sources = cut(tree.read_tree(spark, roots))
    tables = {k: cut(v) for k, v in nodes(sources, cut(extract(sources)), project).items()}
    spec_tokens = cut(specs.read_specs(spark, specs.contract_dirs(roots) if spec_dirs is None else spec_dirs))
    tables["contracts"], tables["contract_tokens"], tokens = contract_tables(spec_tokens, project)
    refs = cut(references(sources, tokens, tables["symbols"], project))
    tables["edges"] = cut(derived(tables, refs, tokens, tree.packages(spark, roots), project, server, own))
    return snapshot.consistent(tables)


def incremental(spark: SparkSession, stored: dict[str, DataFrame], project: str, roots: list[str], files: list[str], server: str | None = None, own: str | None = None, spec_dirs: list[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, bool]]:
    """The stored graph after `files` (absolute paths; changed, new or deleted), and whether structure drifted and seams may be stale."""
    fresh = cut(tree.read_tree(spark, roots, files))
    roots_of = [(r["name"], r["root"]) for r in stored["compartments"].select("name", "root").collect()] + [(r[0], r[1]) for r in fresh.select("compartment", "compartment_root").distinct().collect()]
    places = []
    for path in files:
        around = [(n, r) for n, r in roots_of if path.startswith(r.rstrip("/") + "/")]
        if around:
            name, root = max(around, key=lambda x: len(x[1]))
            places.append((name, path[len(root.rstrip("/")) + 1 :]))
    changed = spark.createDataFrame(sorted(set(places)), "compartment string, file string")
    new = nodes(fresh, cut(extract(fresh)), project)
    keys = ["compartment", "file"]
    tables = {k: cut(stored[k].join(changed, keys, "left_anti").select(*[c for c in stored[k].columns]).unionByName(new[k])) for k in ("symbols", "raw_calls", "candidates")}
    tables["files"] = cut(stored["files"].join(changed.withColumnRenamed("file", "path"), ["compartment", "path"], "left_anti").select(*stored["files"].columns).unionByName(new["files"]))
    tables["compartments"] = cut(stored["compartments"].unionByName(new["compartments"]).dropDuplicates(["id"]).join(tables["files"].select(F.col("compartment").alias("name")).distinct(), "name", "left_semi").select(*stored["compartments"].columns))
    tables["contracts"], tables["contract_tokens"], tokens = contract_tables(cut(specs.read_specs(spark, specs.contract_dirs(roots) if spec_dirs is None else spec_dirs)), project)
    before = stored["edges"].where("type = 'REFERENCES'")
    held = stored["symbols"].join(changed, keys, "left_anti").select(F.col("id").alias("src"))
    known = tokens.select(F.col("contract").alias("dst"), "token")
    refs = before.join(held, "src", "left_semi").join(known, ["dst", "token"], "left_semi").select(*before.columns)
    refs = cut(refs.unionByName(references(fresh, tokens, tables["symbols"], project)))
    tables["edges"] = cut(derived(tables, refs, tokens, tree.packages(spark, roots), project, server, own))
    moved = cut(drift.structural_drift(stored["symbols"].join(changed, keys, "left_semi"), new["symbols"]))
    every = stored["symbols"].unionByName(tables["symbols"])
    flags = {"structural_drift": not moved.isEmpty()}
    flags["seams_stale"] = flags["structural_drift"] and not tables["contracts"].isEmpty() and not drift.stale_seams(moved, before, refs, every).isEmpty()
    return snapshot.consistent(tables), flags


def infer_seams(tables: dict[str, DataFrame]) -> list:
    return [r.asDict() for r in contracts.cluster_seams(tables["candidates"]).collect()]


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    from ..schemas import TABLES

    return {k: spark.createDataFrame([], v) for k, v in (TABLES | {"raw_calls": RAW_CALLS, "candidates": CANDIDATES, "contracts": CONTRACTS, "contract_tokens": CONTRACT_TOKENS}).items()}

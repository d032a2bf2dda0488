"""Tables of the graph and the identifiers of their rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = 1
MODULE = "<module>"

COMPARTMENTS = "id string, project string, name string, root string"
FILES = "id string, project string, compartment string, path string, lang string, mtime double, size long"
SYMBOLS = "id string, project string, compartment string, file string, name string, kind string, lang string, start_line long, end_line long"
CONTRACTS = "id string, project string, name string, file string"
CONTRACT_TOKENS = "project string, contract string, token string, direction string, producers string, consumers string"
EDGES = "type string, src string, dst string, project string, token string, cnt long, resolution string, evidence string, direction string, contract string"
RAW_CALLS = "from_id string, compartment string, file string, name string, line long"
CANDIDATES = "kind string, token string, role string, label string, compartment string, file string, line long"
USAGE = "t long, sessionId string, kind string, tool string, compartment string, file string, returnedTokens long, fileTokens long, savedTokens long, nodes long, pattern string, reason string"
SOURCES = "abs string, root string, compartment string, compartment_root string, rel_path string, lang string, variant string, mtime_ms double, size long, content string"

TABLES = {"compartments": COMPARTMENTS, "files": FILES, "symbols": SYMBOLS, "contracts": CONTRACTS, "contract_tokens": CONTRACT_TOKENS, "edges": EDGES}
EDGE_TYPES = ("IN_COMPARTMENT", "DEFINED_IN", "CALLS", "REFERENCES", "WIRE", "IMPORTS")


def _joined(*parts: Column | str) -> Column:
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def compartment_id(name: Column) -> Column:
    return _joined("compartment", name)


def file_id(compartment: Column, path: Column) -> Column:
    return _joined("file", compartment, path)


def symbol_id(compartment: Column, path: Column, name: Column, line: Column) -> Column:
    return _joined("sym", compartment, path, name, line.cast("string"))


def module_id(compartment: Column, path: Column) -> Column:
    return _joined("sym", compartment, path, MODULE, "0")


def contract_id(title: Column) -> Column:
    return _joined("contract", title)


def edge(kind: str, src: Column, dst: Column, project: Column, **props: Column) -> list[Column]:
    """The columns of an edge; those not given are null."""
    kinds = dict(x.split() for x in EDGES.split(", "))
    out = {"type": F.lit(kind), "src": src, "dst": dst, "project": project} | props
    return [out.get(c, F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]

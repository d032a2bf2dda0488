"""Drawings of gathered nodes and links: GEXF and a self-contained HTML page."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .contracts import contract_drift, contract_links, token_drift
from .exporting import all_links, collapse, contract_walk, kept_symbols

# Colours of compartments, in turn.
PALETTE = "#4e79a7 #f28e2b #e15759 #76b7b2 #59a14f #edc948 #b07aa1 #9c755f".split()


def gather(tables: dict[str, DataFrame], mode: str = "wires", contract: str | None = None, up: int = 3, down: int = 1, include_tests: bool = False) -> tuple[list[dict], list[dict]]:
    """Nodes and links. Modes: wires; all (calls and wires); functions (calls and references); contract; contracts (compartments with a link for each contract)."""
    symbols, edges, contracts = tables["symbols"], tables["edges"], tables["contracts"]
    if mode == "contracts":
        drift = {r["contract"]: r["status"] for r in contract_drift(token_drift(tables["contract_tokens"], edges.where("type = 'REFERENCES'"), symbols, include_tests)).collect()}
        names = {r["id"]: r["name"] for r in contracts.select("id", "name").collect()}
        nodes, links = {}, []
        for r in contract_links(edges.where("type = 'REFERENCES'"), kept_symbols(symbols, include_tests), contracts).collect():
            status = drift.get(r["contract"], "ok")
            ends = [f"compartment::{x}" for x in (r["a"], r["b"]) if x]
            nodes |= {e: {"id": e, "kind": "compartment", "compartment": e[13:], "name": e[13:], "file": "", "line": ""} for e in ends}
            if len(ends) < 2:
                lone = f"contract::{r['contract']}"
                nodes[lone] = {"id": lone, "kind": "contract", "compartment": "", "name": names.get(r["contract"], r["contract"]), "file": "", "line": "", "status": status}
                ends.append(lone)
            if len(ends) == 2:
                links.append({"source": ends[0], "target": ends[1], "type": "CONTRACT", "contract": names.get(r["contract"], r["contract"]), "tokens": r["tokens"], "count": r["functions"], "status": status})
        return sorted(nodes.values(), key=lambda n: n["id"]), links
    if mode == "contract":
        found = contract_walk(edges, symbols, contract or "", up, down, include_tests)
    elif mode == "functions":
        found = collapse(all_links(edges, symbols, ("CALLS", "REFERENCES"), include_tests, contracts), distinct_tokens=True)
    else:
        found = collapse(all_links(edges, symbols, ("CALLS", "WIRE") if mode == "all" else ("WIRE",), include_tests))
    links = [r.asDict() for r in found.orderBy("source", "target", "type").collect()]
    ids = symbols.sparkSession.createDataFrame(sorted({(x,) for r in links for x in (r["source"], r["target"])}), "id string")
    own = symbols.select("id", "kind", "compartment", "name", "file", F.col("start_line").alias("line"))
    own = own.unionByName(contracts.select("id", F.lit("contract").alias("kind"), F.lit("").alias("compartment"), "name", F.lit("").alias("file"), F.lit(None).cast("long").alias("line")))
    return [r.asDict() for r in own.join(ids, "id", "left_semi").orderBy("id").collect()], links


def _colors(nodes: list[dict]) -> dict[str, str]:
    return {c: PALETTE[i % len(PALETTE)] for i, c in enumerate(sorted({n["compartment"] or "" for n in nodes}))}


def gexf(nodes: list[dict], links: list[dict]) -> str:
    q = lambda x: escape("" if x is None else str(x), {'"': "&quot;", "'": "&apos;"})
    colors = _colors(nodes)
    names = ("kind", "compartment", "file", "line")
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<gexf xmlns="http://gexf.net/1.3" xmlns:viz="http://gexf.net/1.3/viz" version="1.3">', '<graph defaultedgetype="directed">', '<attributes class="node">']
    out += [f'<attribute id="{a}" title="{a}" type="string"/>' for a in names] + ["</attributes>", '<attributes class="edge">']
    out += [f'<attribute id="{a}" title="{a}" type="string"/>' for a in ("type", "tokens", "contract", "direction")] + ["</attributes>", "<nodes>"]
    for n in nodes:
        r, g, b = (int(colors[n["compartment"] or ""][i : i + 2], 16) for i in (1, 3, 5))
        values = "".join(f'<attvalue for="{a}" value="{q(n.get(a))}"/>' for a in names)
        out.append(f'<node id="{q(n["id"])}" label="{q(n["name"])}"><attvalues>{values}</attvalues><viz:color r="{r}" g="{g}" b="{b}"/></node>')
    out += ["</nodes>", "<edges>"]
    for i, e in enumerate(links):
        values = "".join(f'<attvalue for="{a}" value="{q(v)}"/>' for a, v in (("type", e["type"]), ("tokens", ", ".join(e.get("tokens") or [])), ("contract", e.get("contract")), ("direction", e.get("direction"))))
        out.append(f'<edge id="{i}" source="{q(e["source"])}" target="{q(e["target"])}" weight="{e.get("count") or 1}"><attvalues>{values}</attvalues></edge>')
    return "\n".join([*out, "</edges>", "</graph>", "</gexf>"]) + "\n"


_PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><svg id="g" width="1000" height="1000"></svg><script>
const data = {data};
const at = {{}}, n = data.nodes.length, svg = document.getElementById('g'), add = (k, v, t) => {{ const e = document.createElementNS('http://www.w3.org/2000/svg', k); for (const a in v) e.setAttribute(a, v[a]); if (t) e.textContent = t; svg.appendChild(e); return e; }};
data.nodes.forEach((x, i) => at[x.id] = [500 + 440 * Math.cos(6.2832 * i / n), 500 + 440 * Math.sin(6.2832 * i / n)]);
data.links.forEach(l => {{ const a = at[l.source], b = at[l.target]; if (a && b) add('line', {{x1: a[0], y1: a[1], x2: b[0], y2: b[1], stroke: l.status === 'drift' ? '#c00' : l.status === 'one-sided' ? '#e90' : '#999', 'stroke-width': Math.min(6, 1 + Math.log(1 + l.count))}}); }});
data.nodes.forEach(x => {{ const p = at[x.id]; add('circle', {{cx: p[0], cy: p[1], r: 6, fill: data.colors[x.compartment || ''] || '#c00'}}); add('text', {{x: p[0] + 8, y: p[1], 'font-size': 11}}, x.name); }});
</script></body></html>
"""


def html(nodes: list[dict], links: list[dict], title: str = "graph") -> str:
    """One page without outside resources."""
    data = json.dumps({"nodes": nodes, "links": links, "colors": _colors(nodes)}, ensure_ascii=False).replace("</", "<\\/")
    return _PAGE.format(title=escape(title), data=data)

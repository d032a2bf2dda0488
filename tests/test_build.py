import json
import os

import pytest
from pyspark.sql import functions as F
from trees import C_TREE, CLIENT, SERVER, SPEC, put

from quillgraph.__main__ import main
from quillgraph.operators import drawing
from quillgraph.operators.linearize import Options, Unresolved, linearize, resolve_root
from quillgraph.plans import build
from quillgraph.plans.engine import Engine
from quillgraph.sources import snapshot, specs, state, tree, usagelog


def edge_set(tables, kind):
    return {(r["src"], r["dst"]) for r in tables["edges"].where(F.col("type") == kind).collect()}


def everything(tables):
    return {k: sorted(map(tuple, tables[k].select(*sorted(tables[k].columns)).na.fill("~").collect()), key=str) for k in ("compartments", "symbols", "contracts", "contract_tokens", "edges")} | {"files": sorted(tuple(r) for r in tables["files"].select("id", "size").collect())}


@pytest.fixture(scope="module")
def c_tree(tmp_path_factory):
    return put(tmp_path_factory.mktemp("c") / "prog", C_TREE)


@pytest.fixture(scope="module")
def c_graph(spark, c_tree):
    return build.build(spark, c_tree, [c_tree])


@pytest.fixture(scope="module")
def shop(tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    put(root / "server", SERVER), put(root / "client", CLIENT), put(root, {"contracts/orders.asyncapi.yaml": SPEC, "contracts/broken.asyncapi.yaml": "a: [", "contracts/notes.yaml": "x: 1"})
    return str(root)


@pytest.fixture(scope="module")
def shop_graph(spark, shop):
    return build.build(spark, shop, [shop])


def test_tree_source(spark, tmp_path):
    root = put(tmp_path / "r", {"src/__init__.py": "a = 1\n", "_u.py": "b = 1\n", ".hid/c.py": "c = 1\n", "node_modules/n.py": "", "x.txt": "", "pkg/package.json": '{"name": "n"}', "pkg/deep/a.TS": "", "bad/package.json": "{", "bad/b.js": ""})
    os.symlink(os.path.join(root, "_u.py"), os.path.join(root, "link.py"))
    rows = {r["rel_path"]: (r["compartment"], r["lang"], r["size"]) for r in tree.read_tree(spark, [root, root]).collect()}
    assert rows == {"src/__init__.py": ("r", "python", 6), "_u.py": ("r", "python", 6), ".hid/c.py": ("r", "python", 6), "deep/a.TS": ("pkg", "typescript", 0), "bad/b.js": ("r", "typescript", 0)}
    assert tree.read_tree(spark, [root], [os.path.join(root, "_u.py")]).count() == 1
    assert tree.scope(root) == "NO-GIT"


def test_c_graph(c_graph):
    name = {r["id"]: r["name"] for r in c_graph["symbols"].collect()}
    calls = {(name[a], name[b]) for a, b in edge_set(c_graph, "CALLS")}
    assert calls == {("start", "near_by"), ("start", "far_off"), ("start", "twin"), ("far_off", "leaf"), ("check", "start")}
    assert {b for a, b in edge_set(c_graph, "CALLS") if name[b] == "twin"} == {"sym:prog:main.c:twin:8"}
    assert (c_graph["symbols"].count(), c_graph["files"].count()) == (11, 4)
    assert len(edge_set(c_graph, "DEFINED_IN")) == 11 and len(edge_set(c_graph, "IN_COMPARTMENT")) == 4


def test_engine_text(spark, c_graph):
    e = Engine(spark, c_graph)
    assert "2 places" in e.trace("twin") and "No symbol" in e.trace("nothing")
    out = e.trace("start")
    assert [line.split()[0] for line in out.splitlines()] == ["start", "near_by", "twin", "far_off", "leaf"]
    assert e.trace("leaf", "in").splitlines()[1].strip().startswith("far_off") and "check" not in e.trace("leaf", "in")
    assert "check" in e.trace("leaf", "in", include_tests=True)
    assert e.path_between("start", "leaf") == "2 hop(s): prog:main.c:start -> prog:util.c:far_off -> prog:util.c:leaf"
    assert e.get_source("leaf").splitlines() == ["util.c:1-1", "1\tint leaf(int x) { return x; }"]
    assert len(e.get_source("leaf", context=2).splitlines()) == 4
    assert "CALLS: 5" in e.graph_stats() and "Contract" not in e.graph_stats()
    assert json.loads(e.query_sql("select count(*) n from symbols where name = 'twin';")) == [{"n": 2}]
    assert e.find_symbol("twin").count() == 2
    assert json.loads(Engine(spark, c_graph, meta={"version": 1}).query_sql("select value from meta")) == [{"value": "1"}]


def test_incremental_equals_full(spark, tmp_path):
    root = put(tmp_path / "prog", C_TREE)
    stored = build.build(spark, root, [root])
    same, flags = build.incremental(spark, stored, root, [root], [os.path.join(root, "util.c")])
    assert everything(same) == everything(stored) and flags == {"structural_drift": False, "seams_stale": False}
    put(root, {"util.c": "\n\nint leaf(int x) { return x; }\nint far_off(int x) { return leaf(x) + fresh(x); }\nint fresh(int x) { return x; }\n"})
    os.unlink(os.path.join(root, "other.c"))
    put(root, {"new.c": "int brand_new(void) { return start(); }\n"})
    got, flags = build.incremental(spark, stored, root, [root], [os.path.join(root, f) for f in ("util.c", "other.c", "new.c")])
    assert everything(got) == everything(build.build(spark, root, [root])) and flags["structural_drift"]


def test_contracts_end_to_end(spark, shop, shop_graph):
    comp = {r["id"]: r["compartment"] for r in shop_graph["symbols"].collect()}
    refs = {(comp[r["src"]], r["token"]) for r in shop_graph["edges"].where("type = 'REFERENCES'").collect()}
    assert refs == {("server", "/api/orders"), ("client", "/api/orders")}
    wires = {(comp[a], comp[b]) for a, b in edge_set(shop_graph, "WIRE")}
    assert wires == {("client", "server")}
    assert edge_set(shop_graph, "IMPORTS") == {("sym:client:send.js:<module>:0", "sym:server:index.js:<module>:0")}
    tokens = {r["token"]: (r["direction"], r["producers"], r["consumers"]) for r in shop_graph["contract_tokens"].collect()}
    assert tokens == {"/api/orders": ("c2s", "client", "server"), "order_total": ("c2s", "", ""), "legacy_slot_id": ("c2s", "", "")}
    seams = {(s["kind"], s["token"], tuple(s["in_compartments"]), tuple(s["out_compartments"])) for s in build.infer_seams(shop_graph)}
    assert seams == {("wire", "/api/orders", ("server",), ("client",)), ("message", "order.created", ("client",), ("server",)), ("state", "ORDER_REGION_KEY", (), ())}
    text = Engine(spark, shop_graph).trace_contract("ORD")
    assert "infer them again" in Engine(spark, shop_graph, meta={"seams_stale": True}).trace_contract("orders") and "No contract" in Engine(spark, shop_graph).trace_contract("nope")
    assert "1/3 tokens satisfied, 0 one-sided, 2 unreferenced DRIFT" in text and "unreferenced: legacy_slot_id" in text
    # the token's first hit in the server is in a comment, so its module refers to it
    assert ("sym:server:routes.ts:<module>:0" in {a for a, _ in edge_set(shop_graph, "REFERENCES")})


def test_inferred_document_round_trip(spark, shop_graph, tmp_path):
    text = specs.synthesize(build.infer_seams(shop_graph))
    path = str(tmp_path / "contracts" / "inferred.asyncapi.yaml")
    assert specs.apply(text, path, str(tmp_path / "backup")) and not specs.apply(text, path, str(tmp_path / "backup"))
    assert specs.apply(text + "# x\n", path, str(tmp_path / "backup")) and len(os.listdir(tmp_path / "backup")) == 1
    rows = {r["token"]: (r["producers"], r["consumers"]) for r in specs.read_specs(spark, specs.contract_dirs([str(tmp_path)])).collect()}
    assert rows["/api/orders"] == (["client"], ["server"]) and rows["order.created"] == (["server"], ["client"])
    assert "order.created" in specs.format_seams(build.infer_seams(shop_graph))


def test_drawings(spark, shop_graph):
    for mode in ("wires", "all", "functions", "contracts", "contract"):
        nodes, links = drawing.gather(shop_graph, mode, "orders")
        assert nodes and links, mode
        assert "<edge " in drawing.gexf(nodes, links) and "http" not in drawing.html(nodes, links).replace("http://www.w3.org/2000/svg", "")
    nodes, links = drawing.gather(shop_graph, "contracts")
    assert [(x["source"], x["target"], x["status"]) for x in links] == [("compartment::client", "compartment::server", "drift")]


def test_linear_reading(spark, c_graph):
    text = linearize(c_graph, "start")
    places = [text.index(f"// ---- {n}") for n in ("start", "near_by", "far_off", "leaf", "twin")]
    assert places == sorted(places) and "5 symbols in 2 files" in text
    assert "depth 0 reached" in linearize(c_graph, "start", options=Options(depth=0))
    assert "cut off at 2" in linearize(c_graph, "start", options=Options(most=2))
    assert resolve_root(c_graph["symbols"], "main.start")["name"] == "start"
    with pytest.raises(Unresolved):
        resolve_root(c_graph["symbols"], "util")


def test_snapshots(spark, c_graph, tmp_path):
    folder = str(tmp_path / "g")
    snapshot.write(folder, c_graph)
    first = everything(snapshot.read(spark, folder))
    assert first == everything(c_graph)
    poisoned = c_graph | {"edges": c_graph["edges"].withColumn("cnt", F.expr("CAST(raise_error('x') AS BIGINT)"))}
    with pytest.raises(Exception, match="x"):
        snapshot.write(folder, poisoned)
    assert everything(snapshot.read(spark, folder)) == first and snapshot.current(folder)["snapshot"] == 1
    with open(os.path.join(folder, "current.json"), "w") as f:
        json.dump({"version": 99, "snapshot": 1}, f)
    with pytest.raises(snapshot.Refused):
        snapshot.write(folder, c_graph)
    with snapshot.locked(folder), pytest.raises(TimeoutError), snapshot.locked(folder, wait=0.1):
        pass
    with snapshot.locked(folder), snapshot.locked(folder, stale=-1, wait=0.1):
        pass


def test_a_member_is_not_lost(spark, shop, shop_graph, tmp_path):
    folder, member = str(tmp_path / "g"), os.path.join(shop, "client")
    snapshot.write(folder, shop_graph)
    fewer = shop_graph | {"compartments": shop_graph["compartments"].where("name <> 'client'")}
    with pytest.raises(snapshot.Refused):
        snapshot.write(folder, fewer, members=[member])
    snapshot.write(folder, fewer, members=[member], allow_fewer=True)
    assert snapshot.read(spark, folder)["edges"].where("dst = 'compartment:client'").count() == 0


def test_state_and_links(tmp_path):
    a, b = (put(tmp_path / x, {"f.py": ""}) for x in ("a", "b"))
    nested = put(tmp_path / "a" / "inner", {"f.py": ""})
    clash = put(tmp_path / "z" / "b", {"f.py": ""})
    assert state.can_link(a, nested) == "nested" and state.can_link(a, a) == "same" and state.can_link(a, str(tmp_path / "no")) == "missing"
    state.link(a, b), state.link(a, b)
    assert state.member_roots(a) == [a, b] and state.member_roots(b) == [b, a] and state.can_link(a, clash) == "name clash"
    assert state.graphs_listing(a, [a, b]) == [b] and state.preview_unlink(a, b) == {"linked": True, "members": [a]}
    state.unlink(a, b)
    assert state.member_roots(a) == [a] and state.former_links(b) == [a]
    state.forget_links(b)
    assert state.former_links(b) == []
    assert state.index_root(nested, str(tmp_path)) == a and state.index_root(str(tmp_path / "z"), str(tmp_path)) is None
    with pytest.raises(ValueError, match="posture"):
        state.set_posture(a, "loud")
    state.seed(a), state.seed(a)
    assert open(os.path.join(a, ".gitignore")).read().splitlines() == [".quillgraph/"]


def test_usage_log(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "usage.jsonl")
    assert not usagelog.append_event(path, "turn", "off") and not usagelog.append_event(path, "turn", None)
    assert usagelog.append_event(path, "use", "balanced", sessionId="s", tool="get_source", savedTokens=5)
    with open(path, "a") as f:
        f.write("\nnot json\n")
    usagelog.append_event(path, "turn", "balanced", sessionId="z")
    assert usagelog.read_usage(spark, path).count() == 2 and usagelog.read_usage(spark, path, "s").count() == 1
    monkeypatch.setenv(usagelog.KILL_SWITCH, "0")
    assert not usagelog.append_event(path, "turn", "balanced")


def test_registry(tmp_path):
    a = put(tmp_path / "a", {"f.py": ""})
    assert state.registered(str(tmp_path)) == [] and state.register(a, str(tmp_path)) == [a] == state.register(a, str(tmp_path))
    assert specs.contracts_home(a) == os.path.join(a, "contracts")


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path))
    root = put(tmp_path / "prog", C_TREE)
    run = lambda *a: (main([*a, "--project", root]), capsys.readouterr().out)[1]
    assert "Symbol: 11" in run("build") and "far_off" in run("callees", "start") and "[prog] util.c:1 function leaf" in run("find", "leaf")
    assert "structural_drift" in run("update", os.path.join(root, "util.c")) and "2 hop(s)" in run("path", "start", "leaf")
    main(["gexf", str(tmp_path / "x.gexf"), "--mode", "all", "--project", root])
    assert "start" in (tmp_path / "x.gexf").read_text()
    with open(os.path.join(root, state.FOLDER, "usage.jsonl"), "w") as f:
        f.write('{"t": 1, "kind": "use", "tool": "get_source", "savedTokens": 50, "sessionId": "s"}\n{"t": 2, "kind": "turn", "sessionId": "s"}\n{"t": 3, "kind": "grep", "pattern": "leaf"}\n')
    assert "about 55 tokens" in (text := run("usage")) and "1 for known symbols" in text and "prog: 50 tokens in 3 events" in run("global-usage")
    assert "posture" in run("status") and run("posture", "balanced").strip() == "balanced"

from pyspark.sql import functions as F

from quillgraph import schemas
from quillgraph.operators import contracts, drift, exporting, imports, linearize, resolve, traverse, usage

SYM = "id string, compartment string, file string, name string, kind string, start_line long, end_line long"


def symbols(spark, *rows):
    return spark.createDataFrame([(i, c, f, n, "module" if n == "<module>" else "function", 1, 9) for i, c, f, n in rows], SYM)


def edges(spark, *rows):
    return spark.createDataFrame([("CALLS", a, b, n, r) for a, b, n, r in rows], "type string, src string, dst string, cnt long, resolution string")


def test_calls_prefer_their_file_and_drop_the_ambiguous(spark):
    many = [(f"m{i}", "c", f"f{i}", "many") for i in range(7)]
    syms = symbols(spark, ("a", "c", "x", "a"), ("b1", "c", "x", "b"), ("b2", "c", "y", "b"), ("d1", "c", "y", "d"), ("d2", "c", "z", "d"), ("o", "other", "x", "far"), *many)
    calls = spark.createDataFrame([("a", "c", "x", n, i) for i, n in enumerate(["b", "b", "d", "many", "far", "a", "none"], 1)], schemas.RAW_CALLS)
    got = {(r["src"], r["dst"]): (r["cnt"], r["line"], r["resolution"]) for r in resolve.resolve_calls(calls, syms).collect()}
    assert got == {("a", "b1"): (2, 1, "unique"), ("a", "d1"): (1, 3, "ambiguous"), ("a", "d2"): (1, 3, "ambiguous")}
    six = syms.where("id <> 'm6'")
    assert resolve.resolve_calls(calls, six).where("dst LIKE 'm%'").count() == 6
    assert resolve.resolve_calls(calls, syms.limit(0)).count() == 0


def test_reach_counts_the_last_hop_and_passes_no_tests(spark):
    syms = symbols(spark, *[(x, "c", f"{x}.c", x) for x in "abcdef"], ("t", "c", "tests/t.c", "t"), ("u", "c", "u.c", "u"))
    e = edges(spark, ("a", "b", 1, "unique"), ("b", "c", 1, "unique"), ("c", "d", 1, "unique"), ("d", "a", 1, "unique"), ("a", "t", 1, "unique"), ("t", "u", 1, "unique"))
    seed = spark.createDataFrame([("a",)], "id string")
    reach = lambda *x: {r["id"]: r["depth"] for r in traverse.reach(e, syms, seed, *x).collect()}
    assert reach(1) == {"a": 0, "b": 1, "c": 2}
    assert reach(0) == {"a": 0, "b": 1, "c": 2, "d": 3} == reach("x")
    assert reach(1, "out", True) == {"a": 0, "b": 1, "t": 1, "c": 2, "u": 2}
    assert reach(1, "in") == {"a": 0, "d": 1, "c": 2}


def test_callers_mirror_callees(spark):
    names = "abcdefgh"
    syms = symbols(spark, *[(x, "c", "f.c", x) for x in names])
    e = edges(spark, *[(names[i], names[(i * 3 + k) % 8], 1, "unique") for i in range(8) for k in (1, 4)])
    one = lambda x, d: {r["id"] for r in traverse.reach(e, syms, spark.createDataFrame([(x,)], "id string"), 2, d).collect()}
    assert all((b in one(a, "out")) == (a in one(b, "in")) for a in "ae" for b in "bh")


def test_shortest_path(spark):
    e = edges(spark, ("a", "b", 1, "unique"), ("c", "b", 1, "unique"), ("c", "d", 1, "unique"), ("a", "x", 1, "unique"), ("x", "d", 1, "unique"), ("p", "q", 1, "unique"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    path = lambda a, b, *n: [r["id"] for r in traverse.shortest_path(e, a, b, *n).orderBy("hop").collect()]
    assert path(ids("a"), ids("d")) == ["a", "x", "d"]
    assert path(ids("a"), ids("q")) == [] == path(ids("a"), ids("d"), 1)
    assert path(ids("a"), ids("a")) == ["a"]
    assert path(ids("b", "p"), ids("q", "d")) == ["p", "q"]


def test_walks_are_counted(spark):
    syms = symbols(spark, *[(x, "c", "f.c", x) for x in "abcd"])
    e = edges(spark, ("a", "b", 1, "unique"), ("a", "c", 1, "unique"), ("b", "d", 1, "unique"), ("c", "d", 1, "unique"), ("d", "a", 1, "unique"))
    got = {(r["src"], r["dst"]): r["walks"] for r in traverse.walks(e, syms, spark.createDataFrame([("a",)], "id string"), 3).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 1, ("b", "d"): 1, ("c", "d"): 1, ("d", "a"): 2}


def wire(spark, n_out, n_in, compartments=2):
    syms = symbols(spark, *[(f"p{i:03}", f"out{i % compartments}", "f", f"p{i}") for i in range(n_out)], *[(f"q{i:03}", f"in{i % compartments}", "f", f"q{i}") for i in range(n_in)])
    refs = syms.select(F.col("id").alias("src"), F.lit("contract:x").alias("dst"), F.lit("/api/x").alias("token"))
    tokens = lambda ps, cs, d=None: spark.createDataFrame([("contract:x", "x", "/api/x", d, ps, cs)], "contract string, name string, token string, direction string, producers array<string>, consumers array<string>")
    return syms, refs, tokens


def test_wires_are_capped_after_order(spark):
    syms, refs, tokens = wire(spark, 40, 40)
    sides = tokens([f"out{i}" for i in range(2)], ["in0", "in1"])
    got = sorted((r["src"], r["dst"]) for r in contracts.wire_edges(refs, syms, sides, "p").collect())
    assert got == [("p000", f"q{i:03}") for i in range(25)]


def test_wires_of_a_token_in_several_contracts(spark):
    """Each contract has its own first 25 pairs, of those that none before it has wired."""
    syms, refs, _ = wire(spark, 10, 10)
    both = refs.union(refs.withColumn("dst", F.lit("contract:y"))).union(refs.where("src < 'p002' OR src > 'q'").withColumn("dst", F.lit("contract:z")))
    sides = [["out0", "out1"], ["in0", "in1"]]
    tokens = spark.createDataFrame([(f"contract:{c}", c, "/api/x", None, *sides) for c in "xyz"], "contract string, name string, token string, direction string, producers array<string>, consumers array<string>")
    got = [(r["contract"], r["src"], r["dst"]) for r in contracts.wire_edges(both, syms, tokens, "p").collect()]
    pairs = [(f"p{i:03}", f"q{j:03}") for i in range(10) for j in range(10)]
    assert sorted(got) == sorted([("x", *p) for p in pairs[:25]] + [("y", *p) for p in pairs[25:50]])


def test_a_common_name_is_joined_file_by_file(spark):
    """Of n files that each define and call `init`, joins make in the order of n rows."""
    n = 400
    defs = symbols(spark, *[(f"i{k}", "c", f"f{k}", "init") for k in range(n)], *[(f"m{k}", "c", f"f{k}", f"main{k}") for k in range(n)])
    calls = spark.createDataFrame([(f"m{k}", "c", f"f{k}", "init", 1) for k in range(n)], "from_id string, compartment string, file string, name string, line long")
    out = resolve.resolve_calls(calls, defs)
    assert {(r["src"], r["dst"], r["resolution"]) for r in out.collect()} == {(f"m{k}", f"i{k}", "unique") for k in range(n)}
    plan = out._jdf.queryExecution().executedPlan()
    made, seen, todo = [], 0, [plan]
    while todo:
        node = todo.pop()
        if "Adaptive" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
            continue
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if "Join" in node.nodeName():
            seen += 1
            made.append(node.metrics().apply("numOutputRows").value())
    assert seen >= 2 and max(made) <= 2 * n


def test_wires_cross_compartments_only(spark):
    syms = symbols(spark, ("x1", "X", "f", "a"), ("x2", "X", "f", "b"), ("y1", "Y", "f", "c"))
    refs = syms.select(F.col("id").alias("src"), F.lit("contract:x").alias("dst"), F.lit("/api/x").alias("token"))
    _, _, tokens = wire(spark, 1, 1)
    got = {(r["src"], r["dst"]) for r in contracts.wire_edges(refs, syms, tokens(["X", "Y"], ["X"]), "p").collect()}
    assert got == {("y1", "x1"), ("y1", "x2")}
    server = lambda d: {(r["src"], r["dst"], r["direction"]) for r in contracts.wire_edges(refs, syms, tokens([], [], d), "p", "Y").collect()}
    assert server("s2c") == {("y1", "x1", "s2c"), ("y1", "x2", "s2c")} and server(None) == {("x1", "y1", "c2s?"), ("x2", "y1", "c2s?")}
    assert contracts.wire_edges(refs, syms, tokens([], []), "p").count() == 0


def test_drift(spark):
    tokens = spark.createDataFrame([("c", t) for t in ("both", "one", "none")] + [("d", "both")], "contract string, token string")
    syms = symbols(spark, ("a", "A", "f", "a"), ("b", "B", "f", "b"), ("t", "B", "tests/f", "t"))
    refs = spark.createDataFrame([("a", "c", "both"), ("b", "c", "both"), ("a", "c", "one"), ("t", "c", "one")], "src string, dst string, token string")
    got = {(r["contract"], r["token"]): r["status"] for r in contracts.token_drift(tokens, refs, syms).collect()}
    assert got == {("c", "both"): "satisfied", ("c", "one"): "one-sided", ("c", "none"): "unreferenced", ("d", "both"): "unreferenced"}
    assert contracts.token_drift(tokens, refs, syms, True).where("token = 'one'").first()["status"] == "satisfied"
    total = {r["contract"]: (r["total"], r["satisfied"] + r["one_sided"] + r["unreferenced"], r["status"]) for r in contracts.contract_drift(contracts.token_drift(tokens, refs, syms)).collect()}
    assert total == {"c": (3, 3, "drift"), "d": (1, 1, "drift")}


def test_first_hit_gives_the_line(spark):
    texts = spark.createDataFrame([("k", "xorder_id\norder_id /api/x\n/api/x")], "file_key string, content string")
    got = {(r["token"], r["line"]) for r in contracts.token_hits(texts, ["order_id", "/api/x", "pi/", "rder_i"]).collect()}
    assert got == {("order_id", 1), ("/api/x", 2), ("pi/", 2)}


def test_enclosing_symbol_is_the_smallest(spark):
    syms = spark.createDataFrame([("big", "c", "f", "big", "class", 1, 20), ("in", "c", "f", "in", "method", 5, 9), ("sym:c:f:<module>:0", "c", "f", "<module>", "module", 0, 0)], SYM)
    places = spark.createDataFrame([("c", "f", x) for x in (6, 12, 30)], "compartment string, file string, line long")
    assert {r["line"]: r["symbol"] for r in contracts.enclosing_symbols(places, syms).collect()} == {6: "in", 12: "big", 30: "sym:c:f:<module>:0"}


def test_contracts_with_one_title_are_merged(spark):
    rows = [("c", "n1", "f1", 0, "t", None, ["a"], []), ("c", "n2", "f2", 1, "t", "s2c", ["b"], ["z"]), ("c", "n2", "f2", 1, "u", "c2s", [], [])]
    df = spark.createDataFrame(rows, "contract string, name string, file string, ord int, token string, direction string, producers array<string>, consumers array<string>")
    got = {r["token"]: (r["name"], r["file"], r["direction"], r["producers"], r["consumers"]) for r in contracts.merge_contracts(df).collect()}
    assert got == {"t": ("n1", "f1", "s2c", ["a", "b"], ["z"]), "u": ("n1", "f1", "c2s", [], [])}


def test_contract_links(spark):
    syms = symbols(spark, ("a", "A", "f", "a"), ("a2", "A", "f", "a2"), ("b", "B", "f", "b"))
    refs = spark.createDataFrame([("a", "c", "x"), ("a2", "c", "y"), ("b", "c", "x"), ("a", "d", "z")], "src string, dst string, token string")
    names = spark.createDataFrame([("c",), ("d",), ("e",)], "id string")
    got = {(r["contract"], r["a"], r["b"], tuple(r["tokens"]), r["functions"]) for r in contracts.contract_links(refs, syms, names).collect()}
    assert got == {("c", "A", "B", ("x", "y"), 3), ("d", "A", None, ("z",), 1), ("e", None, None, (), 0)}


def test_imports(spark):
    cand = spark.createDataFrame([("import", t, "out", "import", "app", "src/main.js", 1) for t in ("@x/lib", "@x/lib/deep", "../../lib/util", "./own", "react", "../../lib/gone")], schemas.CANDIDATES)
    files = spark.createDataFrame([("lib", "index.js"), ("lib", "util.ts"), ("app", "src/own.js"), ("app", "src/main.js")], "compartment string, path string")
    packs = spark.createDataFrame([("app", "/w/app", "@x/app", None), ("lib", "/w/lib", "@x/lib", None)], "name string, root string, package string, entry string")
    got = {(r["src"], r["dst"]) for r in imports.import_edges(cand, files, packs, "p").collect()}
    assert got == {("sym:app:src/main.js:<module>:0", f"sym:lib:{f}:<module>:0") for f in ("index.js", "util.ts")}


def test_staleness_and_drift(spark):
    disk = spark.createDataFrame([("same", 10.5, 1), ("time", 12.1, 1), ("size", 10.0, 2), ("gone", None, None), ("new", 1.0, 1)], "abs string, mtime_ms double, size long")
    held = spark.createDataFrame([(n, 10.0, 1) for n in ("same", "time", "size", "gone")], "abs string, mtime double, size long")
    assert {r["abs"]: r["why"] for r in drift.stale_files(disk, held).collect()} == {"time": "time", "size": "size", "gone": "missing", "new": "new"}
    before, after = symbols(spark, ("1", "c", "f", "foo"), ("2", "c", "f", "bar")), symbols(spark, ("3", "c", "f", "qux"), ("4", "c", "f", "bar"))
    assert {(r["name"], r["side"]) for r in drift.structural_drift(before, after).collect()} == {("foo", "before"), ("qux", "after")}
    assert drift.structural_drift(before, before).count() == 0


def recurring(spark, *rows):
    return usage.read_residency(spark.createDataFrame([(i, *r, 1000.0) for i, r in enumerate(rows)], "tag long, session string, t long, kind string, saved double")).agg(F.sum("recurring")).first()[0]


def test_residency(spark):
    turns = lambda s, *ts: [(s, t, "turn") for t in ts]
    read, bound = (lambda s, t: (s, t, "read")), (lambda s, t: (s, t, "boundary"))
    assert recurring(spark, read("a", 100), *turns("a", *range(101, 106))) == 1500
    assert recurring(spark, read("a", 100), *turns("a", 101, 102, 103), bound("a", 104), *turns("a", 105, 106, 107, 108)) == 1300
    assert recurring(spark, read("a", 100), *turns("a", 101, 102), bound("a", 103), read("a", 104), *turns("a", 105, 106, 107)) == 2500
    assert recurring(spark, read("A", 100), read("B", 101), *turns("A", 102, 104), *turns("B", 103, 105, 107)) == 2500
    assert recurring(spark, read("A", 100), read("B", 101), *turns("B", 102), bound("B", 103), *turns("A", 104), *turns("B", 105), *turns("A", 106, 108)) == 2400
    assert recurring(spark, read(None, 100), *turns("b", 101, 102)) == 1200
    assert recurring(spark, read("a", 100), bound("a", 100), *turns("a", 100, 101)) == 1100


def test_residency_is_the_same_in_small_blocks(spark, monkeypatch):
    rows = [(i, "s" if i % 5 else None, i * 7 % 101, ("read", "turn", "boundary", "turn")[i % 4], 10.0) for i in range(200)]
    df = spark.createDataFrame(rows, "tag long, session string, t long, kind string, saved double")
    whole = sorted(map(tuple, usage.read_residency(df).select("tag", "residency").collect()))
    monkeypatch.setattr(usage, "EVENTS_PER_BLOCK", 7)
    assert sorted(map(tuple, usage.read_residency(df).select("tag", "residency").collect())) == whole
    plain = {}
    for tag, s, t, kind, _ in rows:
        if kind == "read":
            line = [r for r in rows if r[1] == s or s is None]
            end = min([r[2] for r in line if r[3] == "boundary" and r[2] > t], default=10**9)
            plain[tag] = sum(r[3] == "turn" and t < r[2] < end for r in line)
    assert dict(whole) == plain


def test_summary_and_gap(spark):
    log = spark.createDataFrame([(1, "s", "use", "get_source", 5, 9, 100, 0), (2, "s", "use", "trace_callers", 0, 0, 0, 4), (3, "z", "use", "find_symbol", 0, 0, 0, 0), (4, "s", "turn", None, None, None, None, None)], "t long, sessionId string, kind string, tool string, returnedTokens long, fileTokens long, savedTokens long, nodes long")
    r = usage.summary(log).first()
    assert (r["events"], r["get_source_calls"], r["saved_tokens"], r["trace_nodes"], r["other_uses"], r["turns"]) == (4, 1, 100, 4, 1, 1)
    assert usage.summary(log, "z").first()["events"] == 1
    pats = spark.createDataFrame([("foo",), ("foo",), ("a b",), ("nope",)], "pattern string")
    assert [tuple(r) for r in usage.adoption_gap(pats, symbols(spark, ("1", "c", "f.c", "foo"), ("2", "d", "f.c", "foo"))).collect()] == [("foo", 2, "c/f.c")]
    gap = usage.adoption_gap(pats, symbols(spark, ("1", "c", "f.c", "foo")))
    assert usage.gap_tokens(gap, spark.createDataFrame([("c/f.c", "abcdefg")], "path string, content string")).first()["tokens"] == 4
    assert usage.report(r.asDict() | {"events": 0}).startswith("No use") and usage.global_report([]).startswith("No use")
    both = usage.by_project(spark.createDataFrame([("a", 10), ("a", 5), ("b", None)], "project string, savedTokens long"))
    assert {(r["project"], r["events"], r["saved_tokens"]) for r in both.collect()} == {("a", 2, 15), ("b", 1, 0), (None, 3, 15)}


def test_collapse(spark):
    links = spark.createDataFrame([("a", "b", "CALLS", None, None, None, 2), ("a", "b", "CALLS", None, None, None, 3), ("a", "c", "REFERENCES", "x", None, None, None), ("a", "c", "REFERENCES", "y", None, None, None), ("a", "c", "REFERENCES", "y", None, None, None)], "source string, target string, type string, token string, contract string, direction string, count long")
    assert {(r["target"], r["count"], tuple(r["tokens"])) for r in exporting.collapse(links, True).collect()} == {("b", 5, ()), ("c", 2, ("x", "y"))}


def test_callees_in_order(spark):
    names = ["b", "a", "x-y", "é1", "zz", "", None, "a"]
    rows = [("1", "zz a\nb.x-y é1\na", names), ("2", None, names), ("3", "aa b_ \n\nzza", ["zz", "b"]), ("4", "a", []), ("5", "a", None), (None, "b a\r\na", ["a", "b"]), ("7", "x\ny-x-y", ["x-y"])]
    got = linearize.callees_in_order(spark.createDataFrame(rows, "src string, body string, names array<string>").coalesce(1)).collect()
    want = []
    for src, body, own in rows:
        for place, (line, n) in enumerate(sorted((linearize.first_line((body or "").split("\n"), n), n) for n in own or () if n is not None), 1):
            want.append((src, n, None if line == linearize.NOWHERE else line + 1, place))
    assert list(map(tuple, got)) == want


def test_callees_in_order_reads_a_body_once(monkeypatch):
    """Names in any number are not sought one by one."""
    reader = linearize.FirstLines([f"n{i}" for i in range(20_000)])
    monkeypatch.setattr(linearize, "first_line", None)
    assert dict(reader.of("\n".join(f"n{i} n{i + 1} m{i}" for i in range(0, 19_000, 2)))) == {i: i // 2 for i in range(19_000)}

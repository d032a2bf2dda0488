"""Properties that hold for any graph or text."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.extract import RULES, parse_source
from quillgraph.operators import resolve, traverse
from quillgraph.schemas import RAW_CALLS

PIECES = ["class A {", "}", "(", ")", "fun f", "def f():\n", "function g", "=>", "'", '"', "`", "/*", "*/", "//", "\n", "new B", ".get('/x')", "#include \"a\"", "{", "=", "int", "@Get", "import", ";", " ", ","]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(sorted(RULES)), st.lists(st.sampled_from(PIECES), max_size=40))
def test_any_text_is_read(lang, pieces):
    text = "".join(pieces)
    found = parse_source(lang, "", text)
    lines = text.count("\n") + 1
    assert all(1 <= a <= b <= lines for _, _, a, b in found.symbols)
    assert all((e is None or 0 <= e < len(found.symbols)) and 1 <= line <= lines for e, _, line in found.calls)


def test_random_graphs(spark):
    rng = random.Random(11)
    rows = [(f"s{i}", f"c{i % 3}", f"f{rng.randrange(4)}", f"n{rng.randrange(9)}", "function", 1, 2) for i in range(60)]
    symbols = spark.createDataFrame(rows, "id string, compartment string, file string, name string, kind string, start_line long, end_line long")
    calls = [(a[0], a[1], a[2], f"n{rng.randrange(10)}", rng.randrange(50)) for a in rng.choices(rows, k=200)]
    got = resolve.resolve_calls(spark.createDataFrame(calls, RAW_CALLS), symbols)
    want = {}
    for i, c, f, n, line in calls:
        there = [r for r in rows if r[1] == c and r[3] == n]
        there = [r for r in there if r[2] == f] or there
        if 1 <= len(there) <= 6:
            for r in there:
                if r[0] != i:
                    k = want.setdefault((i, r[0]), [0, line, "unique" if len(there) == 1 else "ambiguous"])
                    k[0] += 1
                    k[1] = min(k[1], line)
    assert {(r["src"], r["dst"]): [r["cnt"], r["line"], r["resolution"]] for r in got.collect()} == want
    edges = resolve.call_edges(got, "p")
    assert edges.join(symbols.select(F.col("id").alias("src"), F.col("compartment").alias("a")), "src").join(symbols.select(F.col("id").alias("dst"), F.col("compartment").alias("b")), "dst").where("a <> b").count() == 0
    near = {}
    for a, b in want:
        near.setdefault(a, set()).add(b)
    level, seen = {"s0"}, {"s0": 0}
    for hop in range(1, 4):
        level = {b for a in level for b in near.get(a, ())} - set(seen)
        seen |= dict.fromkeys(level, hop)
    assert {r["id"]: r["depth"] for r in traverse.reach(edges, symbols, spark.createDataFrame([("s0",)], "id string"), 2).collect()} == seen

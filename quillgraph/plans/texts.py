"""Queries of extraction, imports and source trees: source texts made from every part, with the SQL of what they must hold.

A part's language is its key modulo 5; {k} is its key and {s} its size. ROWS states for each language what its text defines, calls and signals.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import imports, linearize
from ..sources import tree
from ..tables import table
from . import build

LANGUAGES = ("python", "typescript", "c", "java", "kotlin")
SUFFIX = {"python": ".py", "typescript": ".ts", "c": ".c", "java": ".java", "kotlin": ".kt"}
TEXTS = {
    "python": 'import os\nfrom lib{k} import helper\n\nclass Box{k}:\n    def get{k}(self):\n        return helper(self)\n\n@app.get("/api/parts{k}")\ndef run{k}(x):\n    Box{k}()\n    return os.environ["PART_KEY_{k}"]\n',
    "typescript": "import x from './lib{k}';\n// not{k}() is a comment\nexport function run{k}() {\n  fetch('/api/items{k}');\n  return helper{s}();\n}\napp.post('/api/orders{k}', () => run{k}());\nbus.publish('part.made{k}');\n",
    "c": '#include "lib{k}.h"\nint proto{k}(int x);\n\nint leaf{k}(int x) {\n    return x;\n}\n\nint run{k}(void) {\n    leaf{k}(1); /* gone{k}(2) */\n    return far{s}(2);\n}\n',
    "java": "package p;\n\npublic class App{k} {\n    int helper{k}() {\n        return 1;\n    }\n    int run{k}() {\n        return helper{k}() + far{s}();\n    }\n}\n",
    "kotlin": "package p\n\nfun helper{k}() = 1\n\nclass Svc{k} {\n    fun run{k}(): Int {\n        return helper{k}()\n    }\n}\n",
}
#: (name, kind, start line, end line) of symbols; (name of the caller, name, line) of calls; (kind, token, role, label, line) of signals.
ROWS = {
    "symbols": {
        "python": [("Box{k}", "class", 4, 6), ("get{k}", "method", 5, 6), ("run{k}", "function", 9, 11)], "typescript": [("run{k}", "function", 3, 6)], "c": [("leaf{k}", "function", 4, 6), ("run{k}", "function", 8, 11)],
        "java": [("App{k}", "class", 3, 10), ("helper{k}", "method", 4, 6), ("run{k}", "method", 7, 9)], "kotlin": [("helper{k}", "function", 3, 3), ("Svc{k}", "class", 5, 9), ("run{k}", "method", 6, 8)],
    },
    "calls": {
        "python": [("get{k}", "helper", 6), ("<module>", "get", 8), ("run{k}", "Box{k}", 10)], "typescript": [("run{k}", "fetch", 4), ("run{k}", "helper{s}", 5), ("<module>", "post", 7), ("<module>", "run{k}", 7), ("<module>", "publish", 8)],
        "c": [("run{k}", "leaf{k}", 9), ("run{k}", "far{s}", 10)], "java": [("run{k}", "helper{k}", 8), ("run{k}", "far{s}", 8)], "kotlin": [("run{k}", "helper{k}", 7)],
    },
    "signals": {
        "python": [("wire", "/api/parts{k}", "in", "get", 8), ("state", "PART_KEY_{k}", "unknown", "env", 11)],
        "typescript": [("import", "./lib{k}", "out", "import", 1), ("wire", "/api/items{k}", "out", "get", 4), ("wire", "/api/orders{k}", "in", "post", 7), ("message", "part.made{k}", "out", "publish", 8)], "c": [("import", "lib{k}.h", "out", "include", 1)],
    },
}


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for every part: its brand's compartment, its key as a name."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    lang = F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (F.col("p_partkey") % 5 + 1).cast("int"))
    content = F.element_at(F.create_map(*[F.lit(x) for pair in TEXTS.items() for x in pair]), lang)
    content = F.replace(F.replace(content, F.lit("{k}"), key), F.lit("{s}"), size)
    path = F.concat(F.lit("f"), key, F.element_at(F.create_map(*[F.lit(x) for pair in SUFFIX.items() for x in pair]), lang))
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("compartment"), path.alias("rel_path"), lang.alias("lang"), F.lit("").alias("variant"), content.alias("content"))


def extract_symbols(spark, sf_dir):
    found = build.extract(sources(spark, sf_dir)).select("compartment", "file", "lang", F.explode("symbols").alias("s"))
    return found.select("compartment", "file", "lang", "s.name", "s.kind", "s.start_line", "s.end_line")


def extract_calls(spark, sf_dir):
    found = build.extract(sources(spark, sf_dir)).select("compartment", "file", F.explode("calls").alias("c"))
    return found.select("compartment", "file", F.regexp_extract("c.from_id", ":([^:]*):[0-9]+$", 1).alias("caller"), "c.name", "c.line")


def extract_signals(spark, sf_dir):
    found = build.extract(sources(spark, sf_dir)).select("compartment", "file", F.explode("signals").alias("s"))
    return found.select("compartment", "file", "s.kind", "s.token", "s.role", "s.label", "s.line")


def import_edges(spark, sf_dir):
    """Every customer is a file of its nation's compartment. It imports the package of the nation (its own + its key) modulo 25, those of even key by the
    name and a path in it, others by a relative path."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("n"), "n_nationkey").alias("name"))
    packages = nation.select("name", F.concat(F.lit("/src/"), "name").alias("root"), F.concat(F.lit("@acme/"), "name").alias("package"), F.lit("./lib/main.ts").alias("entry"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("compartment"), ((F.col("c_nationkey") + F.col("c_custkey")) % 25).alias("to"))
    token = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("@acme/n"), "to", F.lit("/part"))).otherwise(F.concat(F.lit("../../n"), "to", F.lit("/./x/../lib/main")))
    candidates = customer.select(F.lit("import").alias("kind"), token.alias("token"), "compartment", F.concat(F.lit("src/c"), "c_custkey", F.lit(".ts")).alias("file"))
    files = candidates.select("compartment", F.col("file").alias("path")).unionByName(nation.select(F.col("name").alias("compartment"), F.lit("lib/main.ts").alias("path")))
    return imports.import_edges(candidates, files, packages, "tables").select("type", "src", "dst", "evidence")


IMPORT_SQL = """SELECT DISTINCT 'IMPORTS' AS type, 'sym:n' || c_nationkey || ':src/c' || c_custkey || '.ts:<module>:0' AS src, 'sym:n' || (c_nationkey + c_custkey) % 25 || ':lib/main.ts:<module>:0' AS dst, 'import' AS evidence
FROM customer WHERE (c_nationkey + c_custkey) % 25 <> c_nationkey"""


def callees_in_order(spark, sf_dir):
    """For every document as a body, the words of benchmark items as callees in the order in which a linear reading takes them."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("name")).where("name RLIKE '^[a-z]{3,4}$'").distinct()
    callees = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("src"), F.col("text").alias("body")).withColumn("names", F.lit(sorted(r[0] for r in words.collect())))
    return linearize.callees_in_order(callees)


ORDER_SQL = r"""WITH words AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE regexp_matches(w, '^[a-z]{3,4}$')),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
met AS (SELECT doc_id, w, min(line) AS line FROM (SELECT doc_id, line, unnest(string_split_regex(x, '[^\p{L}\p{N}_]+')) AS w FROM lines) GROUP BY doc_id, w),
found AS (SELECT d.doc_id, words.w, met.line FROM documents d CROSS JOIN words LEFT JOIN met ON met.doc_id = d.doc_id AND met.w = words.w)
SELECT CAST(doc_id AS VARCHAR) AS src, w AS name, CAST(line AS BIGINT) AS line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line NULLS LAST, w) AS INTEGER) AS place FROM found"""


def source_tree(spark, sf_dir):
    """The source files of the tree that lies beside this package, with the compartments around them."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "fixtures", "shop")
    return tree.read_tree(spark, [root]).select("compartment", "rel_path", "lang", F.col("size").cast("long").alias("size"), F.size(F.split("content", "\n")).cast("long").alias("lines"))


TREE_SQL = """SELECT compartment, rel_path, lang, CAST(size AS BIGINT) AS size, CAST(lines AS BIGINT) AS lines FROM (VALUES
  ('api', 'src/index.js', 'typescript', 84, 5), ('worker', 'index.js', 'typescript', 30, 2), ('worker', 'lib/poll.py', 'python', 25, 3), ('worker', 'lib/leaf.c', 'c', 30, 2), ('api', 'src/App.java', 'java', 33, 4)) t(compartment, rel_path, lang, size, lines)"""


def _rows_sql(what: str, columns: str) -> str:
    """One row for each part and each row of its language in ROWS."""
    values = ", ".join(f"({LANGUAGES.index(lang)}, '{lang}', '{SUFFIX[lang]}', {', '.join(str(x) if isinstance(x, int) else repr(x) for x in row)})" for lang, rows in ROWS[what].items() for row in rows)
    names = columns.split()
    filled = [f"CAST({c} AS BIGINT) AS {c}" if c.endswith("line") else f"replace(replace({c}, '{{k}}', CAST(p_partkey AS VARCHAR)), '{{s}}', CAST(p_size AS VARCHAR)) AS {c}" for c in names]
    lang = "lang, " if what == "symbols" else ""
    return f"SELECT p_brand AS compartment, 'f' || p_partkey || suffix AS file, {lang}{', '.join(filled)} FROM part JOIN (VALUES {values}) t(n, lang, suffix, {', '.join(names)}) ON p_partkey % 5 = n"


QUERIES = {"extract_symbols": extract_symbols, "extract_calls": extract_calls, "extract_signals": extract_signals, "import_edges": import_edges, "linearize_order": callees_in_order, "source_tree": source_tree}
ORACLE_SQL = {
    "extract_symbols": _rows_sql("symbols", "name kind start_line end_line"), "extract_calls": _rows_sql("calls", "caller name line"), "extract_signals": _rows_sql("signals", "kind token role label line"),
    "import_edges": IMPORT_SQL, "linearize_order": ORDER_SQL, "source_tree": TREE_SQL,
}

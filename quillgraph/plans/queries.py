"""The queries of the graph operators over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import contracts, drift, exporting, lookup, resolve, traverse, usage
from ..schemas import module_id
from ..tables import cut, table
from . import projection as G
from . import texts
from .sqlguard import query_sql

# ---------------------------------------------------------------- shared SQL

SYMBOLS = """symbols AS (
  SELECT 'sym:' || p_brand || ':' || p_type || ':' || p_name || ':' || (p_partkey + 1) AS id, p_brand AS compartment, p_type AS file, p_name AS name, 'function' AS kind,
         p_partkey + 1 AS start_line, p_partkey + 1 + p_size AS end_line, p_partkey AS key FROM part
)"""
CALLS = """calls AS (
  SELECT a.id AS from_id, a.compartment, a.file, b.name, l.line FROM (
    SELECT l_partkey AS k, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, CAST(l_linenumber AS BIGINT) AS line FROM lineitem) l
  JOIN symbols a ON a.key = l.k JOIN symbols b ON b.key = l.n
)"""
EDGES = """sites AS (SELECT from_id, compartment, file, name, count(*) AS cnt, min(line) AS line FROM calls GROUP BY ALL),
met AS (
  SELECT s.*, d.id AS dst, count(*) OVER w AS every, sum(CASE WHEN d.file = s.file THEN 1 ELSE 0 END) OVER w AS here, d.file AS def_file
  FROM sites s JOIN symbols d USING (compartment, name) WINDOW w AS (PARTITION BY s.from_id, s.name)
),
edges AS (
  SELECT from_id AS src, dst, CAST(sum(cnt) AS BIGINT) AS cnt, min(line) AS line,
         CASE WHEN min(CASE WHEN here > 0 THEN here ELSE every END) = 1 THEN 'unique' ELSE 'ambiguous' END AS resolution
  FROM met WHERE (here = 0 OR def_file = file) AND (CASE WHEN here > 0 THEN here ELSE every END) <= 6 AND dst <> from_id GROUP BY from_id, dst
)"""
GRAPH = f"{SYMBOLS}, {CALLS}, {EDGES}"
CANDIDATES = r"""candidates AS (
  SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS compartment, CAST(page_id AS VARCHAR) AS file, regexp_extract(t, '^([^?#]*)', 1) AS token, 'out' AS role
  FROM (SELECT url, page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS t FROM pages)
  UNION ALL
  SELECT regexp_extract(url, '^https?://([^/]+)', 1), CAST(page_id AS VARCHAR), regexp_extract(url, '^https?://[^/]+(/[^\s?#]*)', 1), 'in' FROM pages WHERE regexp_extract(url, '^https?://[^/]+(/[^\s?#]*)', 1) <> ''
)"""
_ROUTES = ", ".join(f"'{r if r != '/' else ''}'" for r in P.GENERAL_ROUTES)
DISTINCT = f"(regexp_replace(lower(token), '/+$', '') NOT IN ({_ROUTES}) AND length(token) >= 5)"
MENTIONS = f"""{CANDIDATES}, mentions AS (
  SELECT DISTINCT 'sym:' || compartment || ':' || file || ':<module>:0' AS src, 'contract:' || lower(substring(token, 2, 1)) AS dst, lower(substring(token, 2, 1)) AS name, token, compartment
  FROM candidates WHERE {DISTINCT}
)"""
USAGE = r"""usage AS (
  SELECT event_id AS tag, user_id AS session, epoch_us(ts) AS t, value AS saved, replace(p_name, ' ', '_') AS pattern,
         CASE event_type WHEN 'purchase' THEN 'read' WHEN 'click' THEN 'turn' WHEN 'view' THEN 'turn' WHEN 'error' THEN 'boundary' WHEN 'signup' THEN 'grep' END AS kind
  FROM events LEFT JOIN part ON p_partkey = CAST(json_extract_string(props, '$.k') AS BIGINT)
)"""


# ---------------------------------------------------------------- pieces


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CALLS of the projected graph, computed once for the steps that follow."""
    return cut(resolve.call_edges(resolve.resolve_calls(G.calls(spark, sf_dir), G.symbols(spark, sf_dir)), G.PROJECT))


def _busiest(edges: DataFrame) -> DataFrame:
    """The caller with the most edges."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


SEED = "seed AS (SELECT src AS id FROM edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"


def _csv(column: str):
    return F.array_join(F.array_sort(column), ",")


# ---------------------------------------------------------------- resolution and traversal


def resolve_calls(spark, sf_dir):
    return resolve.resolve_calls(G.calls(spark, sf_dir), G.symbols(spark, sf_dir))


def resolve_counts(spark, sf_dir):
    return resolve_calls(spark, sf_dir).groupBy("resolution").agg(F.count("*").alias("edges"), F.sum("cnt").alias("calls"))


def resolve_incremental(spark, sf_dir):
    """The largest brand's symbols as fresh ones of changed files, the others as stored: the edges are those of a full build."""
    every = G.symbols(spark, sf_dir)
    brand = every.agg(F.max("compartment")).first()[0]
    fresh = every.where(F.col("compartment") == brand)
    return resolve.resolve_with_store(G.calls(spark, sf_dir), fresh, every, fresh.select("compartment", "file").distinct())


def _trace(direction: str):
    def run(spark, sf_dir):
        edges, symbols = _edges(spark, sf_dir), G.symbols(spark, sf_dir)
        found = traverse.reach(edges, symbols, _busiest(edges), 3, direction)
        return found.join(symbols, "id").select("depth", "id", "compartment", "file", "name")

    return run


def _trace_sql(near: str, far: str) -> str:
    return f"""WITH RECURSIVE {GRAPH}, {SEED},
reach AS (SELECT id, 0 AS depth FROM seed UNION SELECT e.{far}, r.depth + 1 FROM reach r JOIN edges e ON e.{near} = r.id WHERE r.depth < 4)
SELECT CAST(min(depth) AS INTEGER) AS depth, id, compartment, file, name FROM reach JOIN symbols USING (id) GROUP BY id, compartment, file, name"""


def path_between(spark, sf_dir):
    """From the first caller to the last callee of its compartment."""
    edges = _edges(spark, sf_dir)
    start = edges.agg(F.min("src")).first()[0]
    goal = edges.where(F.split("dst", ":")[1] == (start or "::").split(":")[1]).agg(F.max("dst")).first()[0]
    one = lambda v: spark.createDataFrame([(v,)] if v else [], "id string")
    return traverse.shortest_path(edges, one(start), one(goal))


PATH_SQL = f"""WITH RECURSIVE {GRAPH},
both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
ends AS (SELECT (SELECT min(src) FROM edges) AS s, (SELECT max(dst) FROM edges WHERE split_part(dst, ':', 2) = split_part((SELECT min(src) FROM edges), ':', 2)) AS g),
walk AS (SELECT s AS id, 0 AS hop FROM ends UNION SELECT b, hop + 1 FROM walk JOIN both_ways ON a = id WHERE hop < 12),
level AS (SELECT id, min(hop) AS hop FROM walk GROUP BY id),
back AS (
  SELECT id, hop FROM level JOIN ends ON id = g
  UNION ALL
  SELECT (SELECT min(l.id) FROM level l JOIN both_ways w ON w.a = l.id WHERE w.b = back.id AND l.hop = back.hop - 1), hop - 1 FROM back WHERE hop > 0
)
SELECT CAST(hop AS INTEGER) AS hop, id FROM back"""


def export_contract_walk(spark, sf_dir):
    """Calls up to three hops above and one below the busiest symbol, each with the number of walks."""
    edges, symbols = _edges(spark, sf_dir), G.symbols(spark, sf_dir)
    seed = _busiest(edges)
    above, below = traverse.walks(edges, symbols, seed, 3, "in"), traverse.walks(edges, symbols, seed, 1, "out")
    return above.unionByName(below).groupBy("src", "dst").agg(F.sum("walks").alias("walks"))


WALK_SQL = f"""WITH {GRAPH}, {SEED},
up1 AS (SELECT e.src, e.dst, 1 AS n FROM edges e JOIN seed ON e.dst = seed.id),
up2 AS (SELECT e.src, e.dst, sum(p.n) AS n FROM edges e JOIN up1 p ON e.dst = p.src GROUP BY ALL),
up2n AS (SELECT src, sum(n) AS n FROM up2 GROUP BY src),
up3 AS (SELECT e.src, e.dst, p.n FROM edges e JOIN up2n p ON e.dst = p.src),
down AS (SELECT e.src, e.dst, 1 AS n FROM edges e JOIN seed ON e.src = seed.id)
SELECT src, dst, CAST(sum(n) AS BIGINT) AS walks FROM (SELECT * FROM up1 UNION ALL SELECT * FROM up2 UNION ALL SELECT * FROM up3 UNION ALL SELECT * FROM down) GROUP BY src, dst"""


def neighbor_compartments(spark, sf_dir):
    """The compartments one reference away from each: calls stay inside a compartment, so the edges are pages that link to another host's route."""
    pages = G.page_symbols(spark, sf_dir)
    own = G.candidates(spark, sf_dir).select(module_id(F.col("compartment"), F.col("file")).alias("id"), "token", "role").distinct()
    edges = own.where("role = 'out'").withColumnRenamed("id", "src").join(own.where("role = 'in'").withColumnRenamed("id", "dst"), "token").select("src", "dst", F.lit("CALLS").alias("type"))
    return traverse.neighbor_compartments(edges, pages)


NEIGHBOR_SQL = f"""WITH {CANDIDATES}, met AS (SELECT DISTINCT a.compartment AS x, b.compartment AS y FROM candidates a JOIN candidates b ON a.token = b.token AND a.role = 'out' AND b.role = 'in')
SELECT x AS compartment, y AS neighbor FROM met UNION SELECT y, x FROM met UNION SELECT compartment, compartment FROM candidates"""


# ---------------------------------------------------------------- lookup


def find_symbol(spark, sf_dir):
    """Symbols of the most common name, the first 100."""
    symbols = G.symbols(spark, sf_dir)
    top = symbols.where("kind <> 'module'").groupBy("name").count().orderBy(F.desc("count"), "name").first()
    return lookup.find_symbol(symbols, top[0] if top else "").select("id", "compartment", "file", "name", "start_line", "end_line")


def get_source_lines(spark, sf_dir):
    """Every line of every document but the first and the last, numbered: consecutive spans of as many lines as one call gives."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("content"))
    ends = docs.select("file", (F.size(F.split("content", "\n")) - 1).cast("long").alias("last")).where("last >= 2")
    spans = ends.select("file", "last", F.explode(F.expr(f"sequence(2L, last, {lookup.MOST_LINES}L)")).alias("start_line"))
    spans = spans.select("file", "start_line", F.least("last", F.col("start_line") + lookup.MOST_LINES - 1).alias("end_line"))
    return lookup.source_lines(docs, spans).select("file", "line", "text")


def graph_stats_nodes(spark, sf_dir):
    tables = {"compartments": G.compartments(spark, sf_dir), "files": G.files(spark, sf_dir), "symbols": G.symbols(spark, sf_dir), "contracts": G.contract_tokens(spark, sf_dir).select("contract").distinct()}
    return lookup.node_counts(tables)


def graph_stats_edges(spark, sf_dir):
    calls = resolve.call_edges(resolve.resolve_calls(G.calls(spark, sf_dir), G.symbols(spark, sf_dir)), G.PROJECT).select("type")
    return lookup.edge_counts(calls.union(G.mentions(spark, sf_dir).select("type")))


def symbols_per_compartment(spark, sf_dir):
    return lookup.symbols_per_compartment(G.symbols(spark, sf_dir), G.compartments(spark, sf_dir))


def absolute_paths(spark, sf_dir):
    return lookup.absolute_paths(G.files(spark, sf_dir), G.compartments(spark, sf_dir))


# ---------------------------------------------------------------- scalar rules


def _paths(spark, sf_dir):
    """Pages' paths under a directory named by their host: many are of tests by one rule or the other."""
    host, path = F.regexp_extract("url", "^https?://([^/]+)", 1), F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)
    forms = F.array(*[F.lit(x) for x in ("tests", "src/test", "spec", "src", "a_test.b", "lib")])
    return table(spark, sf_dir, "pages").select("page_id", F.concat_ws("/", F.get(forms, (F.col("page_id") % 6).cast("int")), host, F.concat(F.regexp_replace(path, "/", "_"), F.lit(".js"))).alias("path"))


_PATHS_SQL = r"""paths AS (SELECT page_id, ['tests', 'src/test', 'spec', 'src', 'a_test.b', 'lib'][page_id % 6 + 1] || '/' || regexp_extract(url, '^https?://([^/]+)', 1) || '/' || replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '/', '_') || '.js' AS path FROM pages)"""


def is_test_filter(spark, sf_dir):
    return _paths(spark, sf_dir).select("page_id", "path", P.is_test(F.col("path")).alias("by_marker"), P.is_test_segment(F.col("path")).alias("by_segment"))


def is_distinctive(spark, sf_dir):
    """Every word of every document as a token."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"[ \n]")).alias("token")).distinct()
    return words.select("token", P.is_distinctive(F.col("token")).alias("distinctive"))


DISTINCTIVE_SQL = f"""SELECT token, CASE
  WHEN token = '' THEN false
  WHEN contains(token, '/') THEN {DISTINCT}
  WHEN lower(token) IN ({", ".join(f"'{x}'" for x in P.GENERAL_NAMES)}) THEN false
  WHEN upper(token) IN ({", ".join(f"'{x}'" for x in P.GENERAL_ENV)}) THEN false
  WHEN (contains(token, '.') OR contains(token, ':')) AND length(token) >= 5 AND NOT regexp_matches(token, '\\s') THEN true
  WHEN contains(token, '_') AND length(token) >= 6 THEN true
  ELSE regexp_matches(token, '^[A-Za-z]{{10,}}$') END AS distinctive
FROM (SELECT DISTINCT unnest(string_split_regex(text, '[ \\n]')) AS token FROM documents)""".replace("\\\\", "\\")


def addresses(spark, sf_dir):
    """The URL paths of pages with their number as a parameter, in each of the notations."""
    path = F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)
    of = lambda form: F.regexp_replace(path, r"/\d+", form)
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), of("/{id}").alias("braced"), of("/:id").alias("colon"), of("/<id>").alias("angle"))
    return rows.select("page_id", P.normalize_address(F.col("braced")).alias("normal"), P.asyncapi_path(F.col("colon")).alias("from_colon"), P.asyncapi_path(F.col("angle")).alias("from_angle"), P.channel_key(F.lit("wire"), F.col("braced")).alias("channel"), P.route_path(F.concat(F.lit("https://h"), "path", F.lit("?q"))).alias("route"))


ADDRESS_SQL = r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages),
v AS (SELECT page_id, path, regexp_replace(path, '/\d+', '/{id}', 'g') AS braced FROM p)
SELECT page_id,
  CASE WHEN NOT contains(braced, '/') THEN braced WHEN len(list_filter(string_split(braced, '/'), lambda s: s <> '' AND NOT contains(s, '{'))) > 0
    THEN '/' || array_to_string(list_filter(string_split(braced, '/'), lambda s: s <> '' AND NOT contains(s, '{')), '/') END AS normal,
  '/' || array_to_string(list_transform(list_filter(string_split(regexp_replace(path, '/\d+', '/:id', 'g'), '/'), lambda s: s <> ''), lambda s: CASE WHEN starts_with(s, ':') THEN '{' || substring(s, 2) || '}' ELSE s END), '/') AS from_colon,
  '/' || array_to_string(list_transform(list_filter(string_split(regexp_replace(path, '/\d+', '/<id>', 'g'), '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^<.*>$') THEN '{' || substring(s, 2, length(s) - 2) || '}' ELSE s END), '/') AS from_angle,
  lower('wire-' || regexp_replace(regexp_replace(regexp_replace(braced, '[{}]', '', 'g'), '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS channel,
  path AS route
FROM v"""


def est_tokens(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", P.est_tokens(text).alias("tokens"), P.compact(P.est_tokens(text) * 1000).alias("shown"))


def identifiers(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", r"[ \n]")).alias("w"))
    return words.groupBy("doc_id").agg(F.sum(P.is_identifier(F.col("w")).cast("long")).alias("identifiers"), F.sum(P.is_trivial(F.col("w")).cast("long")).alias("trivial"), F.count("*").alias("words"))


IDENTIFIER_SQL = f"""SELECT doc_id, CAST(sum(CAST(regexp_matches(w, '^[A-Za-z_][A-Za-z0-9_]*$') AS INT)) AS BIGINT) AS identifiers,
  CAST(sum(CAST(w IN ({", ".join(f"'{x}'" for x in P.TRIVIAL_NAMES)}) OR regexp_matches(w, '^(?:get|set|is|has)[A-Z][A-Za-z0-9_]*$') OR length(w) <= 1 AS INT)) AS BIGINT) AS trivial, count(*) AS words
FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \n]')) AS w FROM documents) GROUP BY doc_id"""


# ---------------------------------------------------------------- contracts


def cluster_seams(spark, sf_dir):
    out = contracts.cluster_seams(G.candidates(spark, sf_dir))
    return out.select("kind", "token", _csv("compartments").alias("compartments"), _csv("in_compartments").alias("inward"), _csv("out_compartments").alias("outward"), _csv("labels").alias("labels"))


SEAMS_SQL = f"""WITH {CANDIDATES}, named AS (
  SELECT compartment, role, '/' || array_to_string(list_transform(list_filter(string_split(token, '/'), lambda s: s <> ''), lambda s: CASE WHEN starts_with(s, ':') THEN '{{' || substring(s, 2) || '}}' WHEN regexp_matches(s, '^<.*>$') THEN '{{' || substring(s, 2, length(s) - 2) || '}}' ELSE s END), '/') AS token FROM candidates
)
SELECT 'wire' AS kind, token, string_agg(DISTINCT compartment, ',' ORDER BY compartment) AS compartments,
  coalesce(string_agg(DISTINCT compartment, ',' ORDER BY compartment) FILTER (role = 'in'), '') AS inward, coalesce(string_agg(DISTINCT compartment, ',' ORDER BY compartment) FILTER (role = 'out'), '') AS outward, 'get' AS labels
FROM named WHERE {DISTINCT} GROUP BY token HAVING count(DISTINCT compartment) >= 2"""


def contract_tokens(spark, sf_dir):
    """The tokens of both specs of each contract (one with roles, one without) merged."""
    own = G.contract_tokens(spark, sf_dir, roles=True).withColumns({"ord": F.lit(2), "file": F.lit("b.asyncapi.yaml")})
    other = G.contract_tokens(spark, sf_dir).withColumns({"ord": F.lit(1), "file": F.lit("a.asyncapi.yaml")})
    out = contracts.merge_contracts(own.unionByName(other))
    return out.select("contract", "name", "file", "token", "direction", _csv("producers").alias("producers"), _csv("consumers").alias("consumers"))


TOKENS_SQL = f"""WITH {MENTIONS} SELECT dst AS contract, name, 'a.asyncapi.yaml' AS file, token, CASE WHEN length(token) % 2 = 0 THEN 's2c' END AS direction,
  coalesce(string_agg(DISTINCT compartment, ',' ORDER BY compartment) FILTER (NOT ends_with(compartment, '.example.com')), '') AS producers,
  coalesce(string_agg(DISTINCT compartment, ',' ORDER BY compartment) FILTER (ends_with(compartment, '.example.com')), '') AS consumers
FROM mentions GROUP BY dst, name, token"""


def contract_text_match(spark, sf_dir):
    """Which documents hold the text of which benchmark items, and on which line."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_key"), F.col("text").alias("content"))
    tokens = [r[0] for r in table(spark, sf_dir, "benchmark").select("text").distinct().orderBy("text").collect()]
    return contracts.token_hits(docs, tokens, bounded=False)


TEXT_SQL = r"""SELECT CAST(doc_id AS VARCHAR) AS file_key, b.text AS token, CAST(length(substring(d.text, 1, instr(d.text, b.text) - 1)) - length(replace(substring(d.text, 1, instr(d.text, b.text) - 1), chr(10), '')) + 1 AS BIGINT) AS line
FROM documents d JOIN (SELECT DISTINCT text FROM benchmark) b ON instr(d.text, b.text) > 0"""


def contract_token_match(spark, sf_dir):
    """Which documents hold which words of benchmark items as whole words, with the line of the first occurrence of any kind."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_key"), F.col("text").alias("content"))
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).where("w RLIKE '^[a-z]{3,6}$'")
    return contracts.token_hits(docs, [r[0] for r in words.distinct().orderBy("w").collect()])


TOKEN_SQL = r"""WITH words AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE regexp_matches(w, '^[a-z]{3,6}$'))
SELECT CAST(doc_id AS VARCHAR) AS file_key, w AS token, CAST(length(substring(d.text, 1, instr(d.text, w) - 1)) - length(replace(substring(d.text, 1, instr(d.text, w) - 1), chr(10), '')) + 1 AS BIGINT) AS line
FROM documents d JOIN words ON instr(d.text, w) > 0 WHERE regexp_matches(d.text, '\b' || w || '\b')"""


def enclosing_symbol(spark, sf_dir):
    """For every call, the smallest symbol of the caller's file around the called part's line."""
    symbols = G.symbols(spark, sf_dir)
    places = symbols.where("key IS NOT NULL").select("compartment", "file", F.col("end_line").alias("line"), F.col("id").alias("of"))
    return contracts.enclosing_symbols(places, symbols).select("of", "line", "symbol")


ENCLOSING_SQL = f"""WITH {SYMBOLS} SELECT p.id AS of, p.end_line AS line, (SELECT s.id FROM symbols s WHERE s.compartment = p.compartment AND s.file = p.file AND s.start_line <= p.end_line AND p.end_line <= s.end_line ORDER BY s.end_line - s.start_line, s.start_line, s.id LIMIT 1) AS symbol FROM symbols p"""


def contract_references(spark, sf_dir):
    symbols, tokens = G.page_symbols(spark, sf_dir), G.contract_tokens(spark, sf_dir)
    hits = G.candidates(spark, sf_dir).select("compartment", "file", "token", "line").distinct()
    return contracts.reference_edges(hits, tokens, symbols, G.PROJECT).select("src", "dst", "token", "evidence")


def drift_by_token(spark, sf_dir):
    """Drift of all tokens that pages define, counting references from hosts without www. only as tests are."""
    return contracts.token_drift(G.contract_tokens(spark, sf_dir), G.mentions(spark, sf_dir), G.page_symbols(spark, sf_dir)).select("contract", "token", "n", "status")


DRIFT_SQL = f"""{MENTIONS}, drift AS (SELECT dst AS contract, token, count(DISTINCT compartment) AS n, CASE count(DISTINCT compartment) WHEN 0 THEN 'unreferenced' WHEN 1 THEN 'one-sided' ELSE 'satisfied' END AS status FROM mentions GROUP BY dst, token)"""


def drift_by_contract(spark, sf_dir):
    return contracts.contract_drift(drift_by_token(spark, sf_dir))


def _wires(roles: bool):
    def run(spark, sf_dir):
        refs, symbols = G.mentions(spark, sf_dir), G.page_symbols(spark, sf_dir)
        server = None
        if not roles:
            top = refs.join(symbols.select(F.col("id").alias("src"), "compartment"), "src").groupBy("compartment").count().orderBy(F.desc("count"), "compartment").first()
            server = top[0] if top else None
        refs, tokens = G.shared_contracts(refs, G.contract_tokens(spark, sf_dir, roles))
        out = contracts.wire_edges(refs, symbols, tokens, G.PROJECT, server)
        return out.select("src", "dst", "token", "contract", "direction", "evidence")

    return run


def _wires_sql(out: str, into: str, label: str) -> str:
    return f"""WITH {MENTIONS}, server AS (SELECT compartment AS s FROM mentions GROUP BY compartment ORDER BY count(*) DESC, compartment LIMIT 1),
held AS (SELECT src, dst, name, token, compartment FROM mentions WHERE length(token) % 2 = 1 OR CAST(regexp_extract(src, ':([0-9]+):<module>:0$', 1) AS BIGINT) % 2 = 0
  UNION ALL SELECT src, dst || '2', name || '2', token, compartment FROM mentions WHERE length(token) % 2 = 0),
sided AS (SELECT m.*, length(token) % 2 = 0 AS s2c, s FROM held m, server),
pairs AS (SELECT p.src, q.src AS dst, p.token, p.dst AS c, p.name AS contract, {label} AS direction
  FROM sided p JOIN sided q ON p.dst = q.dst AND p.token = q.token AND p.compartment <> q.compartment AND {out} AND {into}),
one AS (SELECT * FROM pairs WHERE NOT ends_with(c, '2') QUALIFY row_number() OVER (PARTITION BY c, token ORDER BY src, dst) <= 25),
two AS (SELECT * FROM pairs p WHERE ends_with(c, '2') AND NOT EXISTS (SELECT 1 FROM one o WHERE o.src = p.src AND o.dst = p.dst AND o.token = p.token) QUALIFY row_number() OVER (PARTITION BY c, token ORDER BY src, dst) <= 25)
SELECT src, dst, token, contract, direction, 'wire-derived' AS evidence FROM one UNION ALL SELECT src, dst, token, contract, direction, 'wire-derived' FROM two"""


def contract_edges(spark, sf_dir):
    names = G.contract_tokens(spark, sf_dir).select(F.col("contract").alias("id")).distinct()
    out = contracts.contract_links(G.mentions(spark, sf_dir), G.page_symbols(spark, sf_dir), names)
    return out.select("contract", "a", "b", F.size("tokens").cast("long").alias("tokens"), "functions")


CONTRACT_SQL = f"""WITH {MENTIONS}, sides AS (SELECT dst AS contract, compartment, list(DISTINCT token) AS t, count(DISTINCT src) AS f FROM mentions GROUP BY ALL),
pairs AS (SELECT x.contract, x.compartment AS a, y.compartment AS b, CAST(len(list_distinct(list_concat(x.t, y.t))) AS BIGINT) AS tokens, x.f + y.f AS functions FROM sides x JOIN sides y ON x.contract = y.contract AND x.compartment < y.compartment)
SELECT * FROM pairs UNION ALL SELECT contract, compartment, NULL, CAST(len(t) AS BIGINT), f FROM sides WHERE contract NOT IN (SELECT contract FROM pairs)"""


def referencing_symbols(spark, sf_dir):
    """References to the contracts named by a vowel."""
    names = G.contract_tokens(spark, sf_dir).select(F.col("contract").alias("id"), "name").distinct()
    parts = [contracts.contract_references(G.mentions(spark, sf_dir), G.page_symbols(spark, sf_dir), names, v) for v in "aeiou"]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- change


def staleness(spark, sf_dir):
    """Orders as files on disk against what an index of finished orders holds: changed prices are sizes, other dates are times."""
    orders = table(spark, sf_dir, "orders")
    name = F.col("o_orderkey").cast("string").alias("abs")
    time, size = F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("double"), F.floor("o_totalprice")
    disk = orders.select(name, time.alias("mtime_ms"), F.when(F.col("o_orderpriority") != "1-URGENT", size).alias("size"))
    held = orders.where("o_orderstatus <> 'O'").select(name, (time + F.when(F.col("o_custkey") % 2 == 0, 1.0).otherwise(2.0)).alias("mtime"), (size + F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("size"))
    return drift.stale_files(disk, held)


STALE_SQL = """SELECT CAST(o_orderkey AS VARCHAR) AS abs, why FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN 'missing' WHEN o_orderstatus = 'O' THEN 'new' WHEN o_orderstatus = 'P' THEN 'size' WHEN o_custkey % 2 <> 0 THEN 'time' END AS why FROM orders) WHERE why IS NOT NULL"""


def structural_drift(spark, sf_dir):
    """Parts before and after the small ones are renamed."""
    before = G.symbols(spark, sf_dir)
    name = F.when(F.col("end_line") - F.col("start_line") < 10, F.upper("name")).otherwise(F.col("name"))
    return drift.structural_drift(before, before.withColumn("name", name))


STRUCTURE_SQL = f"""WITH {SYMBOLS}, b AS (SELECT DISTINCT compartment, file, name FROM symbols), a AS (SELECT DISTINCT compartment, file, CASE WHEN end_line - start_line < 10 THEN upper(name) ELSE name END AS name FROM symbols)
SELECT *, 'before' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'after' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"""


def stale_seams(spark, sf_dir):
    """Brands whose parts drifted and that are called."""
    refs = resolve.resolve_calls(G.calls(spark, sf_dir), G.symbols(spark, sf_dir)).where("cnt > 1")
    return drift.stale_seams(structural_drift(spark, sf_dir), refs, refs, G.symbols(spark, sf_dir))


# ---------------------------------------------------------------- usage


def usage_residency(spark, sf_dir):
    out = usage.read_residency(G.usage(spark, sf_dir))
    return out.select("tag", "session", F.col("residency").cast("long").alias("residency"), F.round("recurring", 4).alias("recurring"))


RESIDENCY_SQL = f"""WITH {USAGE}, r AS (SELECT tag, session, t, saved, (SELECT min(b.t) FROM usage b WHERE b.session = u.session AND b.kind = 'boundary' AND b.t > u.t) AS nb FROM usage u WHERE kind = 'read'),
n AS (SELECT r.tag, any_value(r.session) AS session, any_value(saved0) AS saved, count(x.t) AS residency FROM (SELECT *, saved AS saved0 FROM r) r LEFT JOIN (SELECT session, t FROM usage WHERE kind = 'turn') x ON x.session = r.session AND x.t > r.t AND (r.nb IS NULL OR x.t < r.nb) GROUP BY r.tag)
SELECT tag, session, residency, round(saved * (1 + 0.1 * residency), 4) AS recurring FROM n"""


def usage_by_project(spark, sf_dir):
    """Events and saved tokens of each user, and of all."""
    rows = G.usage(spark, sf_dir).select(F.col("session").cast("string").alias("project"), F.when(F.col("kind") == "read", F.floor("saved")).alias("savedTokens"))
    return usage.by_project(rows)


USAGE_SQL = f"""WITH {USAGE} SELECT CAST(session AS VARCHAR) AS project, count(*) AS events, CAST(coalesce(sum(CASE WHEN kind = 'read' THEN CAST(floor(saved) AS BIGINT) END), 0) AS BIGINT) AS saved_tokens FROM usage GROUP BY ROLLUP (session)"""


def usage_summary(spark, sf_dir):
    kind = F.col("kind")
    log = G.usage(spark, sf_dir).select(
        F.when(kind == "read", "use").otherwise(kind).alias("kind"), F.when(kind == "read", F.when(F.col("tag") % 3 == 0, "trace_callers").when(F.col("tag") % 3 == 1, "get_source").otherwise("find_symbol")).alias("tool"), F.col("session").cast("string").alias("sessionId"),
        F.floor("saved").alias("savedTokens"), F.floor(F.col("saved") * 2).alias("fileTokens"), F.floor("saved").alias("returnedTokens"), F.lit(3).cast("long").alias("nodes"),
    )
    return usage.summary(log)


SUMMARY_SQL = f"""WITH {USAGE}, l AS (SELECT *, kind = 'read' AND tag % 3 = 1 AS g, kind = 'read' AND tag % 3 = 0 AS tr, CAST(floor(saved) AS BIGINT) AS s, CAST(floor(saved * 2) AS BIGINT) AS f FROM usage)
SELECT count(*) AS events, count(*) FILTER (g) AS get_source_calls, CAST(sum(s) FILTER (g) AS BIGINT) AS saved_tokens, CAST(sum(f) FILTER (g) AS BIGINT) AS file_tokens, CAST(sum(s) FILTER (g) AS BIGINT) AS returned_tokens,
  count(*) FILTER (tr) AS trace_calls, CAST(3 * count(*) FILTER (tr) AS BIGINT) AS trace_nodes, CAST(sum(s) FILTER (tr) AS BIGINT) AS trace_returned, count(*) FILTER (kind = 'read' AND NOT g AND NOT tr) AS other_uses,
  count(*) FILTER (kind = 'grep') AS greps, count(*) FILTER (kind = 'turn') AS turns, count(*) FILTER (kind = 'boundary') AS boundaries FROM l"""


def adoption_gap(spark, sf_dir):
    known = G.symbols(spark, sf_dir).withColumn("name", F.regexp_replace("name", " ", "_"))
    return usage.adoption_gap(G.usage(spark, sf_dir).where("kind = 'grep'"), known)


GAP_SQL = f"""WITH {USAGE}, {SYMBOLS} SELECT pattern, count(*) AS n, (SELECT compartment || '/' || file FROM symbols s WHERE replace(s.name, ' ', '_') = u.pattern ORDER BY compartment, file LIMIT 1) AS file FROM usage u WHERE kind = 'grep' AND pattern IS NOT NULL AND EXISTS (SELECT 1 FROM symbols s WHERE replace(s.name, ' ', '_') = u.pattern) GROUP BY pattern"""


# ---------------------------------------------------------------- export, linear reading, SQL


def export_all_links(spark, sf_dir):
    edges = resolve.call_edges(resolve.resolve_calls(G.calls(spark, sf_dir), G.symbols(spark, sf_dir)), G.PROJECT)
    out = exporting.collapse(exporting.all_links(edges, G.symbols(spark, sf_dir)))
    return out.select("source", "target", "type", "count")


def _tables(spark, sf_dir):
    edges = resolve.call_edges(resolve.resolve_calls(G.calls(spark, sf_dir), G.symbols(spark, sf_dir)), G.PROJECT)
    return {"symbols": G.symbols(spark, sf_dir).drop("key"), "files": G.files(spark, sf_dir), "compartments": G.compartments(spark, sf_dir), "edges": edges}


WINDOW = "SELECT compartment, name, id, CAST(row_number() OVER (PARTITION BY compartment, name ORDER BY id) AS BIGINT) AS nth, count(*) OVER (PARTITION BY compartment) AS every FROM symbols WHERE kind <> 'module'"
SETS = "SELECT name FROM symbols WHERE kind <> 'module' AND compartment = 'Brand#1' UNION SELECT name FROM symbols WHERE kind <> 'module' AND compartment = 'Brand#2' EXCEPT SELECT name FROM symbols WHERE compartment = 'Brand#3'"
SEMI = "SELECT s.id, s.name FROM symbols s WHERE kind <> 'module' AND EXISTS (SELECT 1 FROM edges e WHERE e.src = s.id) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = s.id AND e.resolution = 'unique')"
CUBE = "SELECT compartment, kind, count(*) AS n, CAST(sum(end_line - start_line) AS BIGINT) AS lines FROM symbols WHERE kind <> 'module' GROUP BY CUBE (compartment, kind)"


def _sql(text: str):
    return lambda spark, sf_dir: query_sql(spark, _tables(spark, sf_dir), text)


_SYM = "symbols AS (SELECT 'sym:' || p_brand || ':' || p_type || ':' || p_name || ':' || (p_partkey + 1) AS id, p_brand AS compartment, p_type AS file, p_name AS name, 'function' AS kind, p_partkey + 1 AS start_line, p_partkey + 1 + p_size AS end_line FROM part)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "resolve_calls": resolve_calls, "resolve_counts": resolve_counts, "resolve_incremental": resolve_incremental, "trace_callees": _trace("out"), "trace_callers": _trace("in"), "path_between": path_between,
    "export_contract_walk": export_contract_walk, "neighbor_compartments": neighbor_compartments, "find_symbol": find_symbol, "get_source_lines": get_source_lines, "graph_stats_nodes": graph_stats_nodes,
    "graph_stats_edges": graph_stats_edges, "symbols_per_compartment": symbols_per_compartment, "absolute_paths": absolute_paths, "is_test_filter": is_test_filter, "is_distinctive": is_distinctive, "addresses": addresses,
    "est_tokens": est_tokens, "identifiers": identifiers, "cluster_seams": cluster_seams, "contract_tokens": contract_tokens, "contract_text_match": contract_text_match, "contract_token_match": contract_token_match, "enclosing_symbol": enclosing_symbol,
    "contract_references": contract_references, "drift_by_token": drift_by_token, "drift_by_contract": drift_by_contract, "wire_by_roles": _wires(True), "wire_by_server": _wires(False), "contract_edges": contract_edges,
    "referencing_symbols": referencing_symbols, "staleness": staleness, "structural_drift": structural_drift, "stale_seams": stale_seams, "usage_residency": usage_residency, "usage_by_project": usage_by_project,
    "usage_summary": usage_summary, "adoption_gap": adoption_gap, "export_all_links": export_all_links, "query_sql_window": _sql(WINDOW), "query_sql_setop": _sql(SETS),
    "query_sql_semi_anti": _sql(SEMI), "query_sql_cube": _sql(CUBE),
}

ORACLE_SQL: dict[str, str] = {
    "resolve_calls": f"WITH {GRAPH} SELECT src, dst, cnt, line, resolution FROM edges",
    "resolve_counts": f"WITH {GRAPH} SELECT resolution, count(*) AS edges, CAST(sum(cnt) AS BIGINT) AS calls FROM edges GROUP BY resolution",
    "resolve_incremental": f"WITH {GRAPH} SELECT src, dst, cnt, line, resolution FROM edges",
    "trace_callees": _trace_sql("src", "dst"), "trace_callers": _trace_sql("dst", "src"), "path_between": PATH_SQL, "export_contract_walk": WALK_SQL,
    "neighbor_compartments": NEIGHBOR_SQL,
    "find_symbol": f"WITH {SYMBOLS} SELECT id, compartment, file, name, start_line, end_line FROM symbols WHERE name = (SELECT name FROM symbols GROUP BY name ORDER BY count(*) DESC, name LIMIT 1) ORDER BY compartment, file, start_line, id LIMIT 100",
    "get_source_lines": "SELECT file, line, text FROM (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line, len(string_split(text, chr(10))) AS n FROM documents) WHERE line BETWEEN 2 AND n - 1",
    "graph_stats_nodes": f"WITH {MENTIONS} SELECT 'Compartment' AS label, count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT 'File', count(DISTINCT p_brand || '|' || p_type) FROM part UNION ALL SELECT 'Symbol', count(*) + count(DISTINCT p_brand || '|' || p_type) FROM part UNION ALL SELECT 'Contract', count(DISTINCT dst) FROM mentions",
    "graph_stats_edges": f"WITH {GRAPH}, {MENTIONS} SELECT 'CALLS' AS type, count(*) AS n FROM edges UNION ALL SELECT 'REFERENCES', count(*) FROM (SELECT DISTINCT src, dst, token FROM mentions)",
    "symbols_per_compartment": "SELECT p_brand AS compartment, '/src/' || p_brand AS root, count(*) AS n FROM part GROUP BY p_brand",
    "absolute_paths": "SELECT DISTINCT 'file:' || p_brand || ':' || p_type AS id, p_brand AS compartment, p_type AS path, '/src/' || p_brand || '/' || p_type AS abs FROM part",
    "is_test_filter": rf"WITH {_PATHS_SQL} SELECT page_id, path, contains(path, 'tests/') OR contains(path, '/test/') OR contains(path, '.test.') OR contains(path, '_test.') OR contains(path, '/test_') AS by_marker, regexp_matches(path, '(^|/)(tests?|__tests__|testFixtures|androidTest|spec)(/|$)') OR regexp_matches(regexp_extract(path, '[^/]*$'), '^test_.*\.\w+$|(_test|\.test|\.spec|Test|Tests|Spec|IT)\.\w+$') AS by_segment FROM paths",
    "is_distinctive": DISTINCTIVE_SQL, "addresses": ADDRESS_SQL,
    "est_tokens": "SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens, CASE WHEN ceil(length(text) / 3.5) >= 1000 THEN printf('%.1fM', ceil(length(text) / 3.5) / 1000.0) WHEN ceil(length(text) / 3.5) >= 10 THEN CAST(CAST(ceil(length(text) / 3.5) AS BIGINT) AS VARCHAR) || 'K' ELSE printf('%.1fK', ceil(length(text) / 3.5)) END AS shown FROM documents",
    "identifiers": IDENTIFIER_SQL, "cluster_seams": SEAMS_SQL, "contract_tokens": TOKENS_SQL, "contract_text_match": TEXT_SQL, "contract_token_match": TOKEN_SQL, "enclosing_symbol": ENCLOSING_SQL,
    "contract_references": f"WITH {MENTIONS} SELECT DISTINCT src, dst, token, 'contract-match' AS evidence FROM mentions",
    "drift_by_token": f"WITH {DRIFT_SQL} SELECT contract, token, n, status FROM drift",
    "drift_by_contract": f"WITH {DRIFT_SQL} SELECT contract, count(*) AS total, count(*) FILTER (status = 'satisfied') AS satisfied, count(*) FILTER (status = 'one-sided') AS one_sided, count(*) FILTER (status = 'unreferenced') AS unreferenced, CASE WHEN count(*) FILTER (status = 'unreferenced') > 0 THEN 'drift' WHEN count(*) FILTER (status = 'one-sided') > 0 THEN 'one-sided' ELSE 'ok' END AS status FROM drift GROUP BY contract",
    "wire_by_roles": _wires_sql("NOT ends_with(p.compartment, '.example.com')", "ends_with(q.compartment, '.example.com')", "'c2s'"),
    "wire_by_server": _wires_sql("(p.compartment = p.s) = p.s2c", "(q.compartment = q.s) <> q.s2c", "CASE WHEN p.s2c THEN 's2c' ELSE 'c2s?' END"),
    "contract_edges": CONTRACT_SQL,
    "referencing_symbols": f"WITH {MENTIONS} SELECT name AS contract, compartment, regexp_extract(src, ':([0-9]+):<module>:0$', 1) AS file, '<module>' AS name, CAST(0 AS BIGINT) AS start_line, token FROM mentions WHERE name IN ('a', 'e', 'i', 'o', 'u')",
    "staleness": STALE_SQL, "structural_drift": STRUCTURE_SQL,
    "stale_seams": f"WITH {GRAPH} SELECT DISTINCT compartment FROM symbols WHERE end_line - start_line < 10 AND compartment IN (SELECT s.compartment FROM edges e JOIN symbols s ON s.id = e.src WHERE e.cnt > 1)",
    "usage_residency": RESIDENCY_SQL, "usage_by_project": USAGE_SQL, "usage_summary": SUMMARY_SQL, "adoption_gap": GAP_SQL,
    "export_all_links": f"WITH {GRAPH} SELECT src AS source, dst AS target, 'CALLS' AS type, cnt AS count FROM edges",
    "query_sql_window": f"WITH {_SYM} {WINDOW}", "query_sql_setop": f"WITH {_SYM} {SETS}", "query_sql_semi_anti": f"WITH {GRAPH} {SEMI}", "query_sql_cube": f"WITH {_SYM} {CUBE}",
}

QUERIES |= texts.QUERIES
ORACLE_SQL |= texts.ORACLE_SQL

"""Exact top-k inner products with one KD-tree per shard.

Vectors are dealt to shards of about SHARD_ROWS rows by a hash of their id. A shard builds its KD-tree once, and the tree is written: the widest
dimension is split at its median until a node has at most LEAF_ROWS rows or all its rows are equal, and every node keeps its tight box
and its smallest id. The best score that a box allows a query is sum(max(q * low, q * high)).

A query walks a tree best-first: of the nodes met, the one with the highest bound is taken next, an inner node for its two children, a leaf for its rows
(a few leaves at a time), until no bound can beat the k-th result.

Every query first asks its home shard, then in waves the next 1, 2, 4, ... shards after it; the k-th result so far goes with it into each wave as the
score to beat. In a wave a shard's tree is read once for QUERY_ROWS queries, which stream past it in Arrow batches.

Results are ordered by score, then by smaller id, and are exact: box bounds are integers like the scores, and boxes whose bound ties
the k-th score are opened if they hold a smaller id.

Defined results: vectors that are null, or hold a null or non-finite component, and rows with a null id take no part. Vectors meet only
vectors of their own length. Rows with the query's id are its own and left out; a repeated query row is answered once for each row.
A query without candidates has no rows. Only the id and vector columns are read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, bounded_batches

SHARD_ROWS = 4096
QUERY_ROWS = 4096
LEAF_ROWS = 64
WAVE = 8


def exact(*parts: np.ndarray) -> list[np.ndarray]:
    """The integer arrays in a type in which inner products of their rows are exact."""
    most = [int(np.abs(p).max(initial=0)) for p in parts]
    total = max(most) * most[-1] * max(1, parts[0].shape[-1])
    kind = np.float64 if total < 1 << 53 else np.int64 if total < 1 << 62 else object
    return [p.astype(kind) for p in parts]


def small(rows: np.ndarray) -> np.ndarray:
    """The integers in the smallest type that holds them."""
    most = int(np.abs(rows).max(initial=0))
    return rows.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


class Tree:
    """Rows and their ids in the order of the leaves; of each node: box, smallest id, children (0: a leaf) and span of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.arange(len(ids))
        lows, highs, first, self.kids, self.spans = [], [], [], [], []
        todo = [(0, len(ids), -1)]
        while todo:
            a, b, parent = todo.pop()
            at = order[a:b]
            low, high = rows[at].min(0), rows[at].max(0)
            node = len(self.kids)
            lows.append(low), highs.append(high), first.append(int(ids[at].min())), self.kids.append([]), self.spans.append((a, b))
            if parent >= 0:
                self.kids[parent].append(node)
            d = int(np.argmax(high - low))
            if b - a > leaf and high[d] > low[d]:
                m = (b - a) // 2
                order[a:b] = at[np.argpartition(rows[at, d], m)]
                todo += [(a, a + m, node), (a + m, b, node)]
        self.ids, self.rows, self.low, self.high, self.least = ids[order], small(rows[order]), small(np.array(lows)), small(np.array(highs)), first


def search(tree: Tree, q_ids: np.ndarray, q_rows: np.ndarray, beat: np.ndarray, beat_id: np.ndarray, k: int, block: int = 256):
    """(query index, id, score) of up to k rows for each query that come before (beat, beat_id)."""
    rows, q_rows = exact(tree.rows, q_rows)
    low, high = tree.low.astype(rows.dtype), tree.high.astype(rows.dtype)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for start in range(0, len(q_ids), block):
        q = q_rows[start : start + block]
        bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        for i in range(len(q)):
            best, own = bounds[i].tolist(), q_ids[start + i]
            got_id, got = np.empty(0, np.int64), np.empty(0, rows.dtype)
            score, last = beat[start + i], beat_id[start + i]
            met, use = [(-best[0], 0)], []
            while met or use:
                if met:
                    bound, node = heapq.heappop(met)
                    if -bound < score:
                        met = []  # nor can any other
                    elif -bound > score or tree.least[node] < last:
                        if tree.kids[node]:
                            for kid in tree.kids[node]:
                                heapq.heappush(met, (-best[kid], kid))
                        else:
                            use.append(node)
                if use and (not met or len(use) == WAVE):
                    spans = [slice(*tree.spans[n]) for n in use]
                    value, name = np.concatenate([rows[x] for x in spans]) @ q[i], np.concatenate([tree.ids[x] for x in spans])
                    use = []
                    ok = ((value > score) | ((value == score) & (name < last))) & (name != own)
                    got, got_id = np.concatenate([got, value[ok]]), np.concatenate([got_id, name[ok]])
                    if len(got) >= k:
                        first = np.lexsort((got_id, -got))[:k]
                        got, got_id = got[first], got_id[first]
                        score, last = got[-1], got_id[-1]
            out.append((np.full(len(got), start + i), got_id, got.astype(np.int64)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


FOUND = "tag long, query_id long, vec_id long, score long"


def _built(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("vec_id")
    tree = Tree(rows.vec_id.to_numpy(), np.stack(rows.v))
    return pd.DataFrame({"dim": rows.dim.iloc[:1], "shard": rows.shard.iloc[:1], "tree": [pickle.dumps(tree.__dict__)]})


def _asked(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (dim, shard, salt, role, tree, tag, vec_id, v, beat, beat_id) in this order: a tree (role 0) comes before its queries."""
        key, tree = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            cuts = [i for i, x in enumerate(keys) if not i or x != keys[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
                if not keys[a][3]:
                    key, tree = keys[a][:3], Tree.__new__(Tree)
                    tree.__dict__ = pickle.loads(batch.column(4)[a].as_py())
                elif keys[a][:3] == key:
                    part = batch.slice(a, b - a)
                    tag, name, beat, beat_id = (part.column(i).to_numpy(zero_copy_only=False) for i in (5, 6, 8, 9))
                    v = part.column(7).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                    i, vec, score = search(tree, name, v, beat, beat_id, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (tag[i], name[i], vec, score)], names=["tag", "query_id", "vec_id", "score"])

    return run


def quantized(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, of the vectors that take part."""
    v = F.col(f"`{vector_col}`")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~odd)
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def top_k(vectors: DataFrame, query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each row whose `vec_id` meets the condition `query`."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    kept = Written(spark, "topk")
    rows = kept.table(quantized(vectors, id_col, vector_col, scale).withColumn("dim", F.size("v")).withColumn("tag", F.monotonically_increasing_id()))
    n, asked = rows.agg(F.count("*"), F.coalesce(F.sum(query.cast("int")), F.lit(0))).first()
    shards, salts = max(1, -(-n // shard_rows)), max(1, -(-asked // query_rows))
    placed = rows.select("dim", F.expr(f"int(pmod(xxhash64(vec_id), {shards}))").alias("shard"), "vec_id", "v")
    trees = kept.table(placed.groupBy("dim", "shard").applyInPandas(_built, "dim int, shard int, tree binary"))
    queries = rows.where(query).select("dim", "tag", "vec_id", "v", F.expr(f"int(pmod(xxhash64(tag, 1), {shards}))").alias("home"), F.expr(f"int(pmod(xxhash64(tag, 2), {salts}))").alias("salt"))
    each = lambda a, b: F.explode(F.sequence(F.lit(a), F.lit(b - 1)))
    low, none = np.iinfo(np.int64).min, lambda kind: F.lit(None).cast(kind)
    rank = F.row_number().over(Window.partitionBy("tag").orderBy(F.desc("score"), "vec_id"))
    columns = ["dim", "shard", "salt", "role", "tree", "tag", "vec_id", "v", "beat", "beat_id"]
    best, done = None, 0
    while done < shards:
        after = min(shards, max(1, 2 * done))  # shards asked after this wave: 1, 2, 4, ...
        asking = queries.withColumns({"beat": F.lit(low), "beat_id": F.lit(low)})
        if best is not None:
            kth = best.where(F.col("rank") == k).select("tag", F.col("score").alias("beat"), F.col("vec_id").alias("beat_id"))
            asking = queries.join(kth, "tag", "left").fillna(low, ["beat", "beat_id"])
        asking = asking.select("*", each(done, after).alias("step")).withColumns({"shard": F.expr(f"(home + step) % {shards}"), "role": F.lit(1), "tree": none("binary")})
        ready = trees.select("dim", "shard", each(0, salts).alias("salt"), F.lit(0).alias("role"), "tree", *[none(kind).alias(c) for c, kind in (("tag", "long"), ("vec_id", "long"), ("v", "array<long>"), ("beat", "long"), ("beat_id", "long"))])
        dealt = ready.unionByName(asking.select(columns)).repartition("dim", "shard", "salt").sortWithinPartitions("dim", "shard", "salt", "role")
        found = dealt.mapInArrow(_asked(k), FOUND)
        found = found if best is None else best.drop("rank").unionByName(found)
        best, done = kept.table(found.withColumn("rank", rank).where(F.col("rank") <= k)), after
    return best.select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), met AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM met
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

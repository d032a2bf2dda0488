"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix (DataFrame functions only).

The number of rows that each input partition sends to each shard is drawn from the multivariate
hypergeometric law whose margins are the partition sizes and the shard sizes: the counts of a
uniform random permutation. Each partition permutes its rows (a sort by a random key), deals them
to shards by its row of the matrix, rows are exchanged, and each shard is permuted again. The
second permutation runs in blocks of about BLOCK_ROWS rows: a shard's rows are dealt to blocks by a
keyed hash, blocks are ordered by it within, and a block's first slot is the number of rows in
earlier blocks, so no task ever holds a whole shard.

The matrix is the only thing broadcast: at most MAX_PARTITIONS rows of `shards` integers, as an input
of more partitions is coalesced to that many. Input partitions must be the same when read again
(as those of files are); other inputs are written to the shared folder first (`stable=False`).

Defined results: null ids and null texts are rows like any other; repeated rows are dealt one by
one; an empty table gives an empty result; added columns replace input columns of the same name.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Written, numbered

MAX_PARTITIONS = 65_536
BLOCK_ROWS = 1024
_ROW = "monotonically_increasing_id() & 8589934591"


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows, out of good + bad, are good: inversion over all values that a double can tell from impossible."""
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    total = good + bad
    mean = draws * good / total
    sd = math.sqrt(max(1.0, mean * (bad / total) * (total - draws) / max(1, total - 1)))
    a, b = max(low, int(mean - 40 * sd) - 1), min(high, int(mean + 40 * sd) + 1)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(step)])
    cdf = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(cdf, rng.random() * cdf[-1], side="right"))


def communication_matrix(sizes: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """matrix[p][s]: the rows that partition p sends to shard s; both margins hold exactly."""
    assert sum(sizes) == sum(shards)
    rng = np.random.Generator(np.random.Philox(seed))
    left, out = list(shards), []
    for size in sizes:
        row, want, rest = [], size, sum(left)
        for s, room in enumerate(left):
            rest -= room
            n = hypergeometric(rng, room, rest, want) if want else 0
            row.append(n)
            left[s] -= n
            want -= n
        out.append(row)
    return out


def shard_rows(docs: DataFrame, shards: int, seed: int = 17, stable: bool = False) -> DataFrame:
    """All rows of `docs` with `shard` (counts at most one apart) and `slot` (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    docs, back, _ = numbered(docs.drop("shard", "slot"))
    if not stable:
        docs = Written(spark, "shards").table(docs)
    docs = docs.coalesce(MAX_PARTITIONS)
    sizes = {r[0]: r[1] for r in docs.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()}
    n = sum(sizes.values())
    goal = [n // shards + (s < n % shards) for s in range(shards)]
    order = sorted(sizes)
    matrix = communication_matrix([sizes[p] for p in order], goal, seed)
    ends = spark.createDataFrame(
        [(p, np.cumsum(row).tolist()) for p, row in zip(order, matrix, strict=True)],
        T.StructType([T.StructField("__p", T.IntegerType()), T.StructField("__ends", T.ArrayType(T.LongType()))]),
    )
    blocks = max(1, math.ceil(n / shards / BLOCK_ROWS))
    dealt = docs.withColumns({"__p": F.spark_partition_id(), "__u": F.rand(seed)}).sortWithinPartitions("__u").withColumn("__r", F.expr(_ROW))
    dealt = dealt.join(F.broadcast(ends), "__p").withColumns({
        "shard": F.expr("size(filter(__ends, e -> e <= __r))"),
        "__h": F.xxhash64(F.lit(seed), "__p", "__r"),
    }).withColumn("__b", F.expr(f"int(pmod(__h, {blocks}))")).drop("__ends", "__u")
    counts = dealt.groupBy("shard", "__b").agg(F.count("*").alias("__n"))
    first = F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = Written(spark, "shards").table(counts.select("shard", "__b", first.alias("__first")))
    place = F.row_number().over(Window.partitionBy("shard", "__b").orderBy(F.xxhash64("__h"), "__p", "__r"))
    out = dealt.withColumn("__i", place).join(starts, ["shard", "__b"])
    return back(out, "shard", (F.col("__first") + F.col("__i") - 1).alias("slot"))

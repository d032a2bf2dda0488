"""What the operators of this subpackage share: written tables, table reading, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import delete, remember, shared_dir, table

__all__ = ["Written", "bounded_batches", "bounded_groups", "components", "joined_components", "numbered", "table"]


def numbered(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[..., DataFrame], list[str]]:
    """`docs` with its columns called c0, c1, ..., so that none clashes with a name used inside; a function that takes a frame with these
    columns back to the old names (and adds further columns); and what the given columns are called meanwhile."""
    old = docs.columns
    back = lambda df, *more: df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(old)], *more)
    return docs.toDF(*[f"c{i}" for i in range(len(old))]), back, [f"c{old.index(n)}" for n in names]


def bounded_batches(spark: SparkSession) -> None:
    """Batches for Python workers of a bounded size, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)


#: Bytes of a row group of Parquet files.
ROW_GROUP = 16 << 20


def bounded_groups(spark: SparkSession) -> None:
    """Row groups of a bounded size in files written from now on, the caller's too, unless a size is set: a writer holds a whole one, and by
    default that is 128 MB or all that its task writes. Many tasks that write texts do not fit a small heap so."""
    if spark.conf.get("parquet.block.size", None) is None and spark.sparkContext._jsc.hadoopConfiguration().get("parquet.block.size") is None:
        spark.conf.set("parquet.block.size", ROW_GROUP)


class Written:
    """Tables written to the shared folder during one operator call; they go with `clear`, or else when the program ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = remember(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
        self.n = 0

    def write(self, df: DataFrame, codec: str = "snappy") -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def table(self, df: DataFrame, codec: str = "snappy") -> DataFrame:
        return self.write(df, codec)[0]

    def clear(self) -> None:
        """Removes the tables, when nothing reads them any more."""
        delete(self.spark, self.root)


def components(links: DataFrame, kept: Written, max_rounds: int = 60) -> DataFrame:
    """(node, root), a written table: the smallest node that each node of `links` (a, b) reaches.

    Alternating large-star and small-star rounds. A node's smallest neighbour comes from a pre-aggregated groupBy and is joined back, so no
    neighbour list is ever collected; it is written before, so that Spark can broadcast it or split the rows of a node with very many
    neighbours.
    """
    edges = kept.table(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = kept.table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = kept.table(large.where("u <> v").distinct())
        low = kept.table(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = kept.table(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty():
            break  # every node but the roots has one edge, to a root: stars, which no round changes
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return kept.table(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots))


def joined_components(comp: DataFrame, links: DataFrame, kept: Written) -> DataFrame:
    """`comp` (node, root) after further links (a, b); only the components that these touch are searched."""
    label = lambda key: comp.select(F.col("node").alias(key), F.col("root").alias(f"{key}_root"))
    links = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    more = components(links, kept)
    moved = comp.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return kept.table(moved.union(more.join(comp, "node", "left_anti").select("node", "root")))

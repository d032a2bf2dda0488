"""What changed: stale files, structural drift, stale seams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale_files(candidates: DataFrame, indexed: DataFrame) -> DataFrame:
    """The candidates (abs, mtime_ms, size; null if gone) that the index (abs, mtime, size) does not hold as they are."""
    rows = candidates.join(indexed.select("abs", F.col("mtime").alias("was"), F.col("size").alias("had"), F.lit(True).alias("known")), "abs", "left")
    why = (
        F.when(F.col("size").isNull(), "missing").when(F.col("known").isNull(), "new").when(~F.col("size").eqNullSafe(F.col("had")), "size")
        .when(F.coalesce(F.abs(F.col("mtime_ms") - F.col("was")) > 1, F.lit(True)), "time")
    )
    return rows.withColumn("why", why).where("why IS NOT NULL").select("abs", "why")


def structural_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """compartment, file, name, side ('before' or 'after') of symbols that only one side has."""
    names = lambda df, side: df.where("kind <> 'module'").select("compartment", "file", "name").distinct().withColumn(side, F.lit(True))
    both = names(before, "b").join(names(after, "a"), ["compartment", "file", "name"], "full_outer")
    return both.where("a IS NULL OR b IS NULL").select("compartment", "file", "name", F.when(F.col("a").isNull(), "before").otherwise("after").alias("side"))


def stale_seams(drift: DataFrame, references_before: DataFrame, references_after: DataFrame, symbols: DataFrame) -> DataFrame:
    """Compartments with structural drift that reference contracts before or after: inferred contracts may no longer fit them."""
    refs = references_before.select("src").union(references_after.select("src")).distinct()
    touched = symbols.join(refs.withColumnRenamed("src", "id"), "id", "left_semi").select("compartment").distinct()
    return drift.select("compartment").distinct().join(touched, "compartment", "left_semi")

"""Imports across compartments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import edge, module_id

# What an import may leave out, in order of preference.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.js", ".h", ".c")


def normalized(path: Column) -> Column:
    """A path without empty, . and .. segments."""
    step = lambda out, s: F.when((s == "") | (s == "."), out).when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def import_edges(candidates: DataFrame, files: DataFrame, packages: DataFrame, project: str) -> DataFrame:
    """IMPORTS between modules. packages: name, root, package (null if unnamed), entry (null: index.js), for each compartment.

    A relative specifier is looked up in the compartment with the longest root around it, a bare one in the first other compartment by name whose package
    is the specifier or a prefix of it up to a slash; a target in the importing compartment counts for nothing.
    """
    one = candidates.where("kind = 'import'").select("compartment", "file", "token").distinct()
    roots = packages.select(F.col("name").alias("compartment"), F.col("root").alias("own_root"))
    there = packages.select(F.col("name").alias("target"), "root", "package", F.coalesce("entry", F.lit("index.js")).alias("entry"))
    near = one.where(F.startswith("token", F.lit("."))).join(roots, "compartment")
    near = near.withColumn("abs", normalized(F.concat_ws("/", "own_root", F.regexp_replace("file", "[^/]*$", ""), "token")))
    # every ancestor of the path is looked up among the roots by equality: no theta join
    up = F.split("abs", "/")
    ancestors = F.transform(F.sequence(F.lit(2), F.greatest(F.size(up), F.lit(2))), lambda n: F.array_join(F.slice(up, F.lit(1), n), "/"))
    near = near.withColumn("root", F.explode(ancestors)).join(there, "root")
    longest = F.row_number().over(Window.partitionBy("compartment", "file", "token").orderBy(F.length("root").desc(), "target"))
    near = near.withColumn("r", longest).where("r = 1").select("compartment", "file", "token", "target", F.expr("substring(abs, length(root) + 2)").alias("rel"))
    bare = one.where(~F.startswith("token", F.lit(".")))
    pieces = F.split("token", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "/"))
    bare = bare.withColumn("package", F.explode(heads)).join(there.where("package IS NOT NULL AND package <> ''"), "package").where("target <> compartment")
    first = F.row_number().over(Window.partitionBy("compartment", "file", "token").orderBy("target"))
    bare = bare.withColumn("r", first).where("r = 1").select("compartment", "file", "token", "target", F.regexp_replace(F.regexp_replace("entry", r"^\./", ""), r"\.[cm]?[jt]sx?$", "").alias("rel"))
    goal = near.unionByName(bare).where("target <> compartment")
    tries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SUFFIXES)])
    goal = goal.withColumn("t", F.explode(tries)).withColumn("path", F.concat("rel", "t.s"))
    found = goal.join(files.select(F.col("compartment").alias("target"), "path"), ["target", "path"])
    best = found.groupBy("compartment", "file", "token", "target").agg(F.min_by("path", "t.i").alias("path"))
    pairs = best.select(module_id(F.col("compartment"), F.col("file")).alias("a"), module_id(F.col("target"), F.col("path")).alias("b")).distinct()
    return pairs.select(*edge("IMPORTS", F.col("a"), F.col("b"), F.lit(project), evidence=F.lit("import")))

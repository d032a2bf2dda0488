"""The driver's tables seen as graph tables, so that every operator has whole tables to run over.

symbols: parts (compartment brand, file type, span from the key, as long as the size) and one module per file. calls: in each order, from each
line's part to the name of the next line's part. pages: one module symbol each (compartment host); links are outgoing routes, own paths incoming
ones. contracts: the distinctive routes by their first letter. usage: purchases are reads, clicks and views turns, errors boundaries,
sign-ups searches; a user is a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import is_distinctive, route_path
from ..schemas import MODULE, compartment_id, file_id, module_id, symbol_id
from ..tables import table

PROJECT = "tables"
SERVERS = ".example.com"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    line = F.col("p_partkey") + 1
    own = part.select(
        symbol_id(F.col("p_brand"), F.col("p_type"), F.col("p_name"), line).alias("id"), F.lit(PROJECT).alias("project"), F.col("p_brand").alias("compartment"), F.col("p_type").alias("file"),
        F.col("p_name").alias("name"), F.lit("function").alias("kind"), F.lit("sql").alias("lang"), line.alias("start_line"), (line + F.col("p_size")).alias("end_line"), F.col("p_partkey").alias("key"),
    )
    modules = part.select("p_brand", "p_type").distinct().select(
        module_id(F.col("p_brand"), F.col("p_type")).alias("id"), F.lit(PROJECT).alias("project"), F.col("p_brand").alias("compartment"), F.col("p_type").alias("file"),
        F.lit(MODULE).alias("name"), F.lit("module").alias("kind"), F.lit("sql").alias("lang"), F.lit(0).cast("long").alias("start_line"), F.lit(0).cast("long").alias("end_line"), F.lit(None).cast("long").alias("key"),
    )
    return own.unionByName(modules)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.lead("l_partkey").over(order).alias("next"), F.col("l_linenumber").cast("long").alias("line")).where("next IS NOT NULL")
    part = symbols(spark, sf_dir).where("key IS NOT NULL")
    rows = rows.join(part.select("key", F.col("id").alias("from_id"), "compartment", "file"), "key")
    return rows.join(part.select(F.col("key").alias("next"), "name"), "next").select("from_id", "compartment", "file", "name", "line")


def compartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name")).distinct()
    return brand.select(compartment_id(F.col("name")).alias("id"), F.lit(PROJECT).alias("project"), "name", F.concat(F.lit("/src/"), "name").alias("root"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.sum("p_size").cast("long").alias("size"), F.max("p_partkey").cast("double").alias("mtime"))
    return part.select(file_id(F.col("p_brand"), F.col("p_type")).alias("id"), F.lit(PROJECT).alias("project"), F.col("p_brand").alias("compartment"), F.col("p_type").alias("path"), F.lit("sql").alias("lang"), "mtime", "size")


def page_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("compartment"), F.col("page_id").cast("string").alias("file"))
    zero = F.lit(0).cast("long")
    return page.select(
        module_id(F.col("compartment"), F.col("file")).alias("id"), F.lit(PROJECT).alias("project"), "compartment", "file", F.lit(MODULE).alias("name"), F.lit("module").alias("kind"),
        F.lit("html").alias("lang"), zero.alias("start_line"), zero.alias("end_line"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("compartment"), F.col("page_id").cast("string").alias("file"), "url", "html")
    links = page.select("compartment", "file", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("t"), F.lit("out").alias("role"))
    own = page.select("compartment", "file", F.col("url").alias("t"), F.lit("in").alias("role"))
    rows = links.unionByName(own).select(F.lit("wire").alias("kind"), route_path(F.col("t")).alias("token"), "role", F.lit("get").alias("label"), "compartment", "file", F.lit(1).cast("long").alias("line"))
    return rows.where("token IS NOT NULL")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, token: pages and the contract tokens that they link to or are."""
    rows = candidates(spark, sf_dir).where(is_distinctive(F.col("token")))
    name = F.lower(F.substring("token", 2, 1))
    return rows.select(F.lit("REFERENCES").alias("type"), module_id(F.col("compartment"), F.col("file")).alias("src"), F.concat(F.lit("contract:"), name).alias("dst"), "token").distinct()


def contract_tokens(spark: SparkSession, sf_dir: str, roles: bool = False) -> DataFrame:
    """contract, name, token, direction, producers, consumers. With roles, hosts under .example.com consume and the others produce."""
    rows = candidates(spark, sf_dir).where(is_distinctive(F.col("token"))).select("token", "compartment").distinct()
    name = F.lower(F.substring("token", 2, 1))
    side = lambda here: F.array_sort(F.collect_set(F.when(F.col("compartment").endswith(SERVERS) == here, F.col("compartment"))))
    empty = F.array().cast("array<string>")
    out = rows.groupBy(F.concat(F.lit("contract:"), name).alias("contract"), name.alias("name"), "token").agg(side(False).alias("producers"), side(True).alias("consumers"))
    direction = F.when(F.length("token") % 2 == 0, "s2c")
    return out.select("contract", "name", "token", direction.alias("direction"), *([F.col("producers"), F.col("consumers")] if roles else [empty.alias("producers"), empty.alias("consumers")]))


def shared_contracts(refs: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References and tokens with a further contract, named by a letter and 2, of tokens of even length: all their pages refer to it, and only the
    pages of even number to the first."""
    even = F.length("token") % 2 == 0
    odd_page = F.regexp_extract("src", ":([0-9]+):<module>:0$", 1).cast("long") % 2 == 1
    more = refs.where(even).withColumn("dst", F.concat("dst", F.lit("2")))
    named = tokens.where(even).withColumns({"contract": F.concat("contract", F.lit("2")), "name": F.concat("name", F.lit("2"))})
    return refs.where(~(even & odd_page)).unionByName(more), tokens.unionByName(named)


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tag, session, t (microseconds), kind, saved, pattern for all events."""
    kind = F.create_map(*[F.lit(x) for pair in (("purchase", "read"), ("click", "turn"), ("view", "turn"), ("error", "boundary"), ("signup", "grep")) for x in pair])
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.regexp_replace("p_name", " ", "_").alias("pattern"))
    rows = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).join(part, "k", "left")
    return rows.select(F.col("event_id").alias("tag"), F.col("user_id").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), kind[F.col("event_type")].alias("kind"), F.col("value").alias("saved"), "pattern")

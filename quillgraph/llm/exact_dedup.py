"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is cut at content-defined places: after at least MIN_CHUNK characters, at the first place
where the characters before it match BOUNDARY, or after MAX_CHUNK characters. Equal texts are cut
alike, so two texts are equal exactly if their ordered lists of chunks are. Every chunk gets a
64-bit identifier. The distinct chunks of the corpus are gathered once and each identifier is
verified to stand for one chunk only; where one stands for several, that chunk itself takes the
identifier's place in the recipes. Afterwards only recipes (about 8 bytes for 600 characters) move.

Defined results: a null text counts as empty; all empty texts are one group. A null doc_id is
smaller than any other. Of repeated rows with one text and one doc_id exactly one is kept. Columns
other than doc_id and text take no part, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written

MIN_CHUNK, MAX_CHUNK = 512, 8192
BOUNDARY = r"(?:[abcdehjlnpruwy02468][acefhkmnsuxz13579][abcdehjlnpruwy02468]\s|[\n\u3001\u3002\uff0c])"
#: Up to so many ambiguous identifiers are inlined as literals; beyond it, recipes hold the chunks themselves.
MAX_INLINE = 1000


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The text as an array of content-defined chunks; joined, they are the text again."""
    pattern = rf"(?s).{{{least},{most}}}?(?<={BOUNDARY})|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def identifier(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def ambiguous(docs: DataFrame, text: str, ident: Callable[[Column], Column]) -> list[int] | None:
    """Identifiers that stand for more than one chunk; None if there are more than MAX_INLINE."""
    each = docs.select(F.explode(chunks(F.coalesce(F.col(text), F.lit("")))).alias("chunk"))
    distinct = each.select(ident(F.col("chunk")).alias("id"), "chunk").distinct()
    twice = distinct.groupBy("id").count().where("count > 1").select("id").limit(MAX_INLINE + 1)
    found = [r[0] for r in twice.collect()]
    return None if len(found) > MAX_INLINE else found


def recipe(text: Column, found: list[int] | None, ident: Callable[[Column], Column] = identifier) -> Column:
    """The ordered list of verified chunk identifiers."""
    parts = chunks(F.coalesce(text, F.lit("")))
    if found == []:
        return F.transform(parts, ident)
    if found is None:
        return parts
    return F.transform(parts, lambda c: F.struct(ident(c).alias("id"), F.when(ident(c).isin(found), c).alias("chunk")))


def _rank(doc_id: Column, *more: Column) -> Column:
    return F.struct(doc_id.isNotNull().alias("has"), doc_id.alias("id"), *more)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ident: Callable[[Column], Column] = identifier) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256. The largest id of a group stays."""
    kept = Written(docs.sparkSession, "exact")
    found = ambiguous(docs, text_col, ident)
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        recipe(F.col(text_col), found, ident).alias("recipe"),
        F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("text_sha256"),
    )
    own = kept.table(own.withColumn("tag", F.monotonically_increasing_id()))
    groups = own.groupBy("recipe").agg(F.max(_rank(F.col("doc_id"), F.col("tag"))).alias("top"), F.count("*").alias("group_size"))
    groups = kept.table(groups)  # so that both sides of the join are dealt anew and a group of very many copies can be split
    return own.join(groups, "recipe").select("doc_id", F.col("top.id").alias("keep_id"), "group_size", (F.col("tag") == F.col("top.tag")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ident: Callable[[Column], Column] = identifier) -> DataFrame:
    """The rows of `docs` that stay, with all their columns. Each distinct text moves once."""
    found = ambiguous(docs, text_col, ident)
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    keyed = docs.select(recipe(F.col(text_col), found, ident).alias("recipe"), _rank(F.col(id_col)).alias("rank"), row.alias("row"))
    top = keyed.groupBy("recipe").agg(F.max_by("row", "rank").alias("row"))
    return top.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


ORACLE_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

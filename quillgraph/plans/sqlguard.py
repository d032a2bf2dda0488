"""Read-only SQL over the graph's tables: one statement, read-only by its words and by its parsed plan."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

MOST_ROWS = 200
#: Words that no query may hold.
FORBIDDEN = "INSERT UPDATE DELETE DROP ALTER CREATE REPLACE ATTACH DETACH PRAGMA VACUUM REINDEX LOAD_EXTENSION MERGE TRUNCATE CACHE UNCACHE REFRESH SET RESET ADD CALL LOAD MSCK ANALYZE GRANT REVOKE EXPORT IMPORT OVERWRITE".split()
#: Parsed nodes whose presence makes a statement more than a query.
_COMMANDS = re.compile(r"(Command|Statement|InsertInto|CreateTable|CreateView|DropTable|MergeInto|Truncate|SetCatalog|CacheTable|AlterTable|ScriptTransform)")


class Refused(ValueError):
    """The statement is not a single read-only query."""


def checked(spark: SparkSession, query: str) -> str:
    text = query.strip()
    text = text[:-1].rstrip() if text.endswith(";") else text
    if not text:
        raise Refused("empty query")
    if ";" in text:
        raise Refused("only one statement is allowed")
    if not re.match(r"(?i)(select|with)\b", text):
        raise Refused("only SELECT or WITH is allowed")
    if found := re.search(rf"(?i)\b({'|'.join(FORBIDDEN)})\b", text):
        raise Refused(f"{found[1].upper()} is not allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
    if found := _COMMANDS.search(plan):
        raise Refused(f"{found[1]} is not allowed")
    return text


def query_sql(spark: SparkSession, tables: dict[str, DataFrame], query: str, args: dict | None = None) -> DataFrame:
    """The query's rows over `tables` under their names."""
    text = checked(spark, query)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text, args=args) if args else spark.sql(text)


def answer(spark: SparkSession, tables: dict[str, DataFrame], query: str) -> str:
    """The first rows as JSON, as a tool answers; errors as text."""
    try:
        rows = query_sql(spark, tables, query).limit(MOST_ROWS + 1).collect()
    except Exception as e:  # a tool answers with what went wrong
        return f"Query error: {str(e).splitlines()[0]}"
    if not rows:
        return "(no rows)"
    shown = json.dumps([r.asDict(recursive=True) for r in rows[:MOST_ROWS]], indent=2, default=str, ensure_ascii=False)
    return shown + ("\n… more rows omitted" if len(rows) > MOST_ROWS else "")

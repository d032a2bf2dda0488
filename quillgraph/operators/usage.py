"""Use of the tools: totals, how long a read stays in context, what was searched for in vain.

Residency counts the turns strictly after a read and strictly before the next boundary of its session; a read without a session, or whose
session has no turn, follows the timeline of all sessions. Running counts are kept per block of time: inside a block by a window,
across blocks by sums of the blocks before. So a very long session, or the one timeline of all, is spread over blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import est_tokens, is_identifier
from ..tables import cut

CACHE_SHARE = 0.1
EVENTS_PER_BLOCK = 50_000


def _residency(events: DataFrame, keys: list[str], width: int, origin: int) -> DataFrame:
    """Reads of `events` (keys, t, kind, tag, saved) with `residency` on the timeline of their keys."""
    spots = events.withColumn("block", F.expr(f"(t - ({origin})) div {width}"))
    counts = spots.groupBy(*keys, "block", "t").agg(F.sum((F.col("kind") == "turn").cast("long")).alias("turns"), F.max((F.col("kind") == "boundary").cast("int")).alias("bound"))
    counts = cut(counts)  # one row per time, read four times below
    inside = Window.partitionBy(*keys, "block").orderBy("t")
    counts = counts.withColumn("upto", F.sum("turns").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = counts.groupBy(*keys, "block").agg(F.sum("turns").alias("n"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) if keys else blocks.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = blocks.groupBy(*keys).agg(F.sum("n").alias("total"))
    counts = counts.join(blocks.drop("n"), [*keys, "block"]).withColumn("upto", F.col("upto") + F.col("before"))
    mark = F.when(F.col("bound") == 1, F.struct("t", (F.col("upto") - F.col("turns")).alias("turns")))
    later = Window.partitionBy(*keys, "block").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("next", F.min(mark).over(later)).withColumn("mark", mark)
    heads = counts.groupBy(*keys, "block").agg(F.min("mark").alias("head"))
    ahead = Window.partitionBy(*keys).orderBy(F.desc("block")) if keys else Window.orderBy(F.desc("block"))
    heads = heads.withColumn("ahead", F.min("head").over(ahead.rowsBetween(Window.unboundedPreceding, -1))).drop("head")
    counts = counts.join(heads, [*keys, "block"])
    counts = counts.join(total, keys) if keys else counts.withColumn("total", F.lit((total.first() or [0])[0]))
    end = F.coalesce("next.turns", "ahead.turns", "total")
    counts = counts.select(*keys, "t", F.greatest(F.lit(0), end - F.col("upto")).alias("residency"))
    return spots.where("kind = 'read'").join(counts, [*keys, "t"])


def read_residency(events: DataFrame) -> DataFrame:
    """tag, session, t, saved, residency, recurring of each read of events (tag, session, t, kind in read/turn/boundary, saved)."""
    one = events.where("kind IN ('read', 'turn', 'boundary')").select("tag", "session", "t", "kind", "saved")
    n, low, high = one.agg(F.count("*"), F.min("t"), F.max("t")).first()
    low, high = low or 0, high or 0
    width = max(1, -(-(high - low + 1) // max(1, -(-n // EVENTS_PER_BLOCK))))
    sessions = one.where("session IS NOT NULL AND kind = 'turn'").select("session").distinct()
    own = one.join(sessions, "session", "left_semi")
    rest = one.where("kind = 'read'").join(sessions.withColumnRenamed("session", "s"), F.col("session") == F.col("s"), "left_anti")
    out = _residency(own, ["session"], width, low).select("tag", "session", "t", "saved", "residency")
    if not rest.isEmpty():
        every = one.where("kind <> 'read'").unionByName(rest)
        out = out.unionByName(_residency(every, [], width, low).select("tag", "session", "t", "saved", "residency"))
    return out.withColumn("recurring", F.col("saved") * (1 + F.lit(CACHE_SHARE) * F.col("residency")))


def from_log(log: DataFrame) -> DataFrame:
    """Reads, turns and boundaries of a usage log."""
    kind = F.when((F.col("kind") == "use") & (F.col("tool") == "get_source"), "read").when(F.col("kind").isin("turn", "boundary"), F.col("kind"))
    return log.select(F.monotonically_increasing_id().alias("tag"), F.col("sessionId").alias("session"), "t", kind.alias("kind"), F.coalesce("savedTokens", F.lit(0)).cast("double").alias("saved")).where("kind IS NOT NULL")


def summary(log: DataFrame, session: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Counters of a usage log, for all of it or by columns."""
    if session:
        log = log.where(F.col("sessionId") == session)
    source = (F.col("kind") == "use") & (F.col("tool") == "get_source")
    trace = (F.col("kind") == "use") & F.col("tool").isin("trace_callers", "trace_callees")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    total = lambda c, v: F.coalesce(F.sum(F.when(c, F.coalesce(v, F.lit(0)))), F.lit(0))
    return log.groupBy(*(by or [])).agg(
        F.count("*").alias("events"), n(source).alias("get_source_calls"), total(source, "savedTokens").alias("saved_tokens"), total(source, "fileTokens").alias("file_tokens"),
        total(source, "returnedTokens").alias("returned_tokens"), n(trace).alias("trace_calls"), total(trace, "nodes").alias("trace_nodes"), total(trace, "returnedTokens").alias("trace_returned"),
        n((F.col("kind") == "use") & ~source & ~trace).alias("other_uses"), n(F.col("kind") == "grep").alias("greps"), n(F.col("kind") == "turn").alias("turns"), n(F.col("kind") == "boundary").alias("boundaries"),
    )


def by_project(logs: DataFrame) -> DataFrame:
    """project, events, saved_tokens of each project with events, and a row of null for all."""
    return logs.rollup("project").agg(F.count("*").alias("events"), F.coalesce(F.sum("savedTokens"), F.lit(0)).alias("saved_tokens")).where("events > 0")


def gap_tokens(gap: DataFrame, sources: DataFrame) -> DataFrame:
    """The gap with the estimated tokens of each file (path, content) that a search led to; null where the file is not known."""
    return gap.join(sources.select(F.col("path").alias("file"), est_tokens(F.col("content")).alias("tokens")), "file", "left").select("pattern", "n", "file", (F.col("n") * F.col("tokens")).alias("tokens"))


def adoption_gap(patterns: DataFrame, symbols: DataFrame) -> DataFrame:
    """pattern, n, file: searches for bare identifiers that are known symbols, with the first symbol's file."""
    asked = patterns.where(is_identifier(F.col("pattern"))).groupBy("pattern").agg(F.count("*").alias("n"))
    known = symbols.where("kind <> 'module'").groupBy(F.col("name").alias("pattern")).agg(F.min(F.struct("compartment", "file")).alias("at"))
    return asked.join(known, "pattern").select("pattern", "n", F.concat_ws("/", "at.compartment", "at.file").alias("file"))


#: Tokens that a traced symbol would have cost if walked to by hand (an assumption, shown apart from what is measured).
TOKENS_PER_NODE = 120


def report(totals: dict, recurring: float | None = None, gap: int = 0) -> str:
    """A summary for people of one row of `summary`."""
    if not totals["events"]:
        return "No use recorded yet."
    calls = totals["get_source_calls"] + totals["trace_calls"] + totals["other_uses"]
    out = [
        "Measured use (a local estimate from text lengths, not billed tokens)", f"  tool calls: {calls:,}",
        f"  source reads: {totals['get_source_calls']:,}, about {totals['saved_tokens']:,} tokens less than whole files",
        f"  traces: {totals['trace_calls']:,} over {totals['trace_nodes']:,} symbols (by hand perhaps {totals['trace_nodes'] * TOKENS_PER_NODE:,} tokens)",
        f"  searches: {totals['greps']:,}, of which {gap:,} for known symbols",
    ]
    if totals["turns"] and recurring is not None:
        out.append(f"  with later turns: about {round(recurring):,} tokens ({totals['turns']:,} turns, {totals['boundaries']:,} boundaries)")
    return "\n".join(out)


def global_report(rows: list) -> str:
    """A summary for people of the rows of `by_project`, most saved first."""
    own = sorted((r for r in rows if r["project"] is not None), key=lambda r: (-r["saved_tokens"], r["project"]))
    total = next((r for r in rows if r["project"] is None), None)
    if not total:
        return "No use recorded yet."
    return "\n".join([*(f"  {r['project']}: {r['saved_tokens']:,} tokens in {r['events']:,} events" for r in own), f"  all: {total['saved_tokens']:,} tokens in {total['events']:,} events"])

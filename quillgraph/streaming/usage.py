"""The usage log as a stream: residency of reads by state per session, and counts by window with late events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.usage import CACHE_SHARE

CLOSED = "session string, t long, saved double, residency long, recurring double"


def _advance(idle_ms: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Turns add to all reads open before them; a boundary closes those, and so does the time after which a session counts as over."""
        open_ = json.loads(state.get[0]) if state.exists else []
        done = []
        if state.hasTimedOut:
            done, open_ = open_, []
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["t", "rank"])
            for t, kind, saved in zip(rows.t.tolist(), rows.kind.tolist(), rows.saved.tolist(), strict=True):
                if kind == "read":
                    open_.append([t, saved, 0])
                elif kind == "turn":
                    for r in open_:
                        r[2] += r[0] < t
                else:
                    done += [r for r in open_ if r[0] < t]
                    open_ = [r for r in open_ if r[0] >= t]
            if open_:
                state.update((json.dumps(open_),))
                state.setTimeoutTimestamp(max(int(rows.t.max()), state.getCurrentWatermarkMs()) + idle_ms)
            elif state.exists:
                state.remove()
        out = pd.DataFrame(done, columns=["t", "saved", "residency"])
        out.insert(0, "session", key[0])
        out["recurring"] = out.saved * (1 + CACHE_SHARE * out.residency)
        yield out

    return run


def residency_stream(events: DataFrame, idle_ms: int = 3_600_000, late: str = "10 minutes") -> DataFrame:
    """Closed reads of a stream of (session, t in milliseconds, kind in read/turn/boundary, saved). Events of one session must arrive in order of batches;
    within a batch they are put in order, boundaries before turns before reads of one time, as a read sees only what is later than itself.

    State is kept only for sessions with open reads, and goes when the watermark (`late` behind the newest event) is `idle_ms` past a session's last
    event: its open reads are emitted then with the turns that they have seen. Sessions without an id need the timeline of all and are left to
    the batch form."""
    rank = F.when(F.col("kind") == "boundary", 0).when(F.col("kind") == "turn", 1).otherwise(2)
    rows = events.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", late).where("session IS NOT NULL AND kind IN ('read', 'turn', 'boundary')")
    rows = rows.select("session", "t", "ts", "kind", F.coalesce("saved", F.lit(0.0)).cast("double").alias("saved"), rank.alias("rank"))
    return rows.groupBy("session").applyInPandasWithState(_advance(idle_ms), CLOSED, "open string", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by tumbling window and kind; events later than `late` behind the newest are left out."""
    rows = events.withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("savedTokens"), F.lit(0)).alias("saved_tokens"))
    return out.select(F.col("w.start").alias("start"), "kind", "n", "saved_tokens")

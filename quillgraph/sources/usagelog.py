"""The usage log: JSON lines, appended by tools, read as a table."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from ..schemas import USAGE

ROTATE_BYTES = 5 << 20
KILL_SWITCH = "QUILLGRAPH_METRICS"


def append_event(path: str, kind: str, posture: str | None, **values) -> bool:
    """Adds an event unless switched off (variable set to 0, no state, posture off); a log over ROTATE_BYTES is moved aside first. Never raises."""
    if os.environ.get(KILL_SWITCH) == "0" or posture in (None, "off"):
        return False
    try:
        if os.path.exists(path) and os.path.getsize(path) > ROTATE_BYTES:
            os.replace(path, path + ".1")
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"t": int(time.time() * 1000), "kind": kind} | values, ensure_ascii=False) + "\n")
        return True
    except OSError:
        return False


def read_usage(spark: SparkSession, path: str, session: str | None = None) -> DataFrame:
    """Events of the log; blank and malformed lines are left out."""
    log = spark.read.schema(USAGE).option("mode", "DROPMALFORMED").json(path)
    return log.where(log["sessionId"] == session) if session else log


def read_usage_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(USAGE).option("mode", "DROPMALFORMED").json(folder)

"""Stored graphs: snapshot directories of Parquet tables and a pointer file that names the current one.

A writer makes a new snapshot and then replaces the pointer in one rename, so readers see the old graph or the new one and a failed
write leaves the old. Writers take turns by a lock file. A stored version newer than ours is never written over.
"""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES, VERSION

LOCK_STALE_S, LOCK_WAIT_S = 30, 60
EXTRA = ("raw_calls", "candidates")


class Refused(RuntimeError):
    """The write would lose something."""


@contextlib.contextmanager
def locked(folder: str, stale: float = LOCK_STALE_S, wait: float = LOCK_WAIT_S) -> Iterator[None]:
    os.makedirs(folder, exist_ok=True)
    path, until = os.path.join(folder, "lock"), time.time() + wait
    while True:
        try:
            os.close(os.open(path, os.O_CREAT | os.O_EXCL))
            break
        except FileExistsError:
            with contextlib.suppress(OSError):
                if time.time() - os.path.getmtime(path) > stale:
                    os.unlink(path)
                    continue
            if time.time() > until:
                raise TimeoutError(f"{path} is held") from None
            time.sleep(0.05)
    try:
        yield
    finally:
        with contextlib.suppress(OSError):
            os.unlink(path)


def current(folder: str) -> dict | None:
    try:
        with open(os.path.join(folder, "current.json"), encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


def consistent(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each node once, edges once by their key, none with an end that is not there."""
    out = {k: tables[k].dropDuplicates(["id"]) for k in ("compartments", "files", "symbols", "contracts")}
    out["contract_tokens"] = tables["contract_tokens"].dropDuplicates(["contract", "token"])
    ids = None
    for k in ("compartments", "files", "symbols", "contracts"):
        one = out[k].select("id")
        ids = one if ids is None else ids.union(one)
    edges = tables["edges"].withColumn("_t", F.when(F.col("type").isin("REFERENCES", "WIRE"), F.coalesce("token", F.lit("")))).dropDuplicates(["type", "src", "dst", "_t"]).drop("_t")
    out["edges"] = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*[c.split()[0] for c in TABLES["edges"].split(", ")])
    return out | {k: tables[k] for k in EXTRA if k in tables}


def write(folder: str, tables: dict[str, DataFrame], members: list[str] | None = None, allow_fewer: bool = False, meta: dict | None = None) -> str:
    """Writes a snapshot and makes it current. Refuses if a linked member that still has sources would vanish, unless allowed."""
    spark = tables["symbols"].sparkSession
    with locked(folder):
        old = current(folder)
        if old and old["version"] > VERSION:
            raise Refused(f"the stored graph has version {old['version']}, newer than {VERSION}")
        if old and old["version"] == VERSION and members and not allow_fewer:
            roots = [r[0] for r in tables["compartments"].select("root").distinct().collect()]
            had = [r[0] for r in read(spark, folder)["compartments"].select("root").distinct().collect()]
            inside = lambda m, rs: any(r == m or r.startswith(m.rstrip("/") + "/") for r in rs)
            lost = [m for m in members if os.path.isdir(m) and inside(m, had) and not inside(m, roots)]
            if lost:
                raise Refused(f"members would be lost: {', '.join(lost)}")
        n = (old or {}).get("snapshot", 0) + 1
        path = os.path.join(folder, f"snapshot-{n}")
        shutil.rmtree(path, ignore_errors=True)
        try:
            for name, df in consistent(tables).items():
                out = df.write
                (out.partitionBy("type") if name == "edges" else out).parquet(os.path.join(path, name))
        except Exception:
            shutil.rmtree(path, ignore_errors=True)
            raise
        fresh = os.path.join(folder, "current.json.new")
        with open(fresh, "w", encoding="utf-8") as f:
            json.dump({"version": VERSION, "snapshot": n, "built": time.time()} | (meta or {}), f)
        os.replace(fresh, os.path.join(folder, "current.json"))
        with contextlib.suppress(OSError):  # the one before stays for readers that hold it
            shutil.rmtree(os.path.join(folder, f"snapshot-{n - 2}"))
    return path


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    found = current(folder)
    if not found:
        raise FileNotFoundError(f"no graph in {folder}")
    if found["version"] != VERSION:
        raise Refused(f"the stored graph has version {found['version']}; build it again")
    path = os.path.join(folder, f"snapshot-{found['snapshot']}")
    names = [*TABLES, *(k for k in EXTRA if os.path.isdir(os.path.join(path, k)))]
    return {n: (spark.read.schema(TABLES[n]) if n in TABLES else spark.read).parquet(os.path.join(path, n)) for n in names}


def dump(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(os.path.join(folder, name))

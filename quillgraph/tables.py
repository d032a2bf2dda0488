"""Reading input tables, and cutting the lineage of iterative plans."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where none is set, a folder of our own, but only if all executors are in this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillgraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def remember(spark: SparkSession, path: str) -> str:
    """A path that goes when the program ends."""

    def clean() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            if spark.sparkContext._jsc is not None:
                delete(spark, path)

    atexit.register(clean)
    return path


def cut(df: DataFrame) -> DataFrame:
    """`df`, computed once, as a table in the shared folder: its lineage ends there, and lost executors lose nothing of it."""
    path = remember(df.sparkSession, f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A table may be broadcast if it has at most so many rows; see `small`.
SMALL_ROWS = 100_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> bool:
    """Whether `df` has at most `most` rows; reads no more than that of it."""
    return df.limit(most + 1).count() <= most

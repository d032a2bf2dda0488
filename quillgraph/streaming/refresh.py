"""A graph kept fresh by a stream of changed paths."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans import build
from ..sources import snapshot


def refresher(folder: str, project: str, roots: list[str], **options):
    """A function for foreachBatch: a batch of rows (abs) becomes one incremental build and a new snapshot."""

    def run(batch: DataFrame, batch_id: int) -> None:
        files = [r[0] for r in batch.select("abs").distinct().orderBy("abs").collect()]  # paths of one batch of edits
        if files:
            stored = snapshot.read(batch.sparkSession, folder)
            tables, flags = build.incremental(batch.sparkSession, stored, project, roots, files, **options)
            snapshot.write(folder, tables, meta=flags)

    return run


def refresh_stream(changes: DataFrame, folder: str, project: str, roots: list[str], checkpoint: str, **options):
    return changes.writeStream.foreachBatch(refresher(folder, project, roots, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

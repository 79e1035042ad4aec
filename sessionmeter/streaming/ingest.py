"""Continuous ingest: files of all sources while they grow."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..ingest import IngestOptions, LogSources, ingest
from ..sources.tables import Tables


def start_ingest(tables: Tables, sources: LogSources | str, checkpoint: str, options: IngestOptions = IngestOptions(),
                 remotes: DataFrame | None = None, trigger: dict | None = None,
                 clock=lambda: int(time.time() * 1000)) -> StreamingQuery:
    """Watch the logs and ingest what is appended to them, or to new ones (a string names the session folder).

    Every trigger is a tick, and each tick's batch compares the files with the ledger and reads the byte ranges
    behind its offsets: grown, shrunk and new files of all three kinds arrive without a batch run. The place reached is in
    the ledger table, not in the stream's checkpoint, so it does not grow with the number of files, and batch
    runs and the stream may take turns. A burst of changes within one interval becomes one run; a repeated batch adds nothing.
    """
    watched = LogSources(sessions=sources, remotes=remotes) if isinstance(sources, str) else sources
    ticks = tables.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()

    def run(_batch: DataFrame, _number: int) -> None:
        ingest(tables, watched, clock(), options)

    return (ticks.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "500 milliseconds"})).start())

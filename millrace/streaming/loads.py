"""Loads driven by a stream: each micro-batch is one load, committed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from millrace.plans.load import Loader
from millrace.sources.snapshots import Snapshots
from millrace.spec.model import Spec

#: Batches that were loaded, by query.
BATCHES = "BUSINESS.LOADED_BATCHES"


def start(stream: DataFrame, spec: Spec, store: Snapshots, checkpoint: str, name: str, trigger: dict | None = None, **loader) -> StreamingQuery:
    """Run the specification over every micro-batch of `stream`, in place of its own source.

    A batch that was committed before a failure is not loaded again: its number is kept beside the tables. A failure between
    the commit and that note makes the batch come again; generated histories and upserts then change nothing, appends repeat.
    Derived histories accept late batches in any order: of versions of one start the order of duplicates decides, not the batch
    in which one came. So its columns must be fields of the target. Where no order is given the later batch replaces the
    earlier one; an equal neighbour that was dropped does not come back when a later batch puts a version between.
    """
    Loader(stream.sparkSession, spec, store, by_order=True, **loader)  # refuses what it cannot load before the stream begins

    def load(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = store.read(BATCHES, spark.createDataFrame([], "QUERY string, BATCH bigint").schema)
        if known.filter((known.QUERY == name) & (known.BATCH >= number)).head(1):
            return
        Loader(spark, spec, store, source=batch, job_id=f"{name}{number:016d}", by_order=True, **loader).run()
        store.replace_keys(BATCHES, spark.createDataFrame([(name, number)], "QUERY string, BATCH bigint"), ["QUERY"])

    return stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

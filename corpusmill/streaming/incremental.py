"""The incremental index as a stream: micro-batches of a feed through the change runner."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.incremental import IncrementalFeed


def index_stream(feed: DataFrame, folder: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a query that takes up each micro-batch of a feed and commits it with its number.

    Every row of a batch is taken up, also one that arrived no later than rows of an earlier batch. A batch that is
    delivered again after a failure is known by its number in the stream's checkpoint: it is not taken up twice, and
    `sink(changed, batch)`, which gets what each committed batch changed, gets the stored output again.
    """

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        changed = IncrementalFeed(spark, folder).run_batch(batch, stream, number)
        if sink and changed is not None:
            sink(changed, number)

    return feed.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

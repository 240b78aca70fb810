"""The scoring plan over unbounded input.

Requests are independent, so a stream is scored micro-batch by micro-batch with
the batch plan.  A batch is written under its own number and replaced when it is
repeated after a failure: the output holds every request once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start_scoring(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs ``plan`` on every micro-batch and writes Parquet below ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"})).start()
    )


def score_stream(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataFrame:
    """Everything that is there now, scored; the results as a table."""
    query = start_scoring(stream, plan, path, checkpoint, availableNow=True)
    query.awaitTermination()
    return stream.sparkSession.read.parquet(path)

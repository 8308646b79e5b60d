"""The change-log operators as streams: outbox overlay, notifications, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakecat.operators import notify


def last_state(outbox: DataFrame) -> DataFrame:
    """Latest entry per part as a streaming aggregate; state holds one row per part."""
    return outbox.groupBy("part_id").agg(F.max(F.struct("id", "operation")).alias("e")).select("part_id", F.col("e.id").alias("id"), F.col("e.operation").alias("operation"))


def apply_batches(outbox: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give each micro-batch, one last entry per part, to `apply` with its id. A batch may come twice after a failure with the
    same id, so `apply` must be idempotent by it; the checkpoint takes the place of claims and leases."""

    def run(batch: DataFrame, batch_id: int) -> None:
        apply(last_state(batch), batch_id)

    return outbox.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def routed(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Stream of events joined with the static rules."""
    return notify.fan_out(events, rules)


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Events per window and name, with a watermark for late ones. An extension: the catalog's own metrics have no windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_name").agg(F.count("*").alias("n"))

"""Hourly aggregates by event time as a stream: every micro-batch appends deltas, late rows go to a table of their own.

A batch's clocks are merged with those of the batches before it; the closings that follow route the batch's rows, exactly
as in the batch operator. Counts, sums and clocks are additive (or take the least), so nothing is kept in executor
memory between batches, and a batch becomes visible as a whole.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.operators import lateness
from ledgerloom.session import materialize
from ledgerloom.streaming import sinks

_SUMS = ("n_rows", "n_corrections", "n_diverted", "n_after_close")


def _merge_deltas(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("stream_table", "hour").agg(*[F.sum(c).alias(c) for c in _SUMS], F.try_sum("value_sum").alias("value_sum"))


def hourly_log(spark: SparkSession, root: str) -> sinks.BatchLog:
    """Its tables: deltas, clocks, late."""
    return sinks.BatchLog(spark, root, {"deltas": _merge_deltas, "clocks": lateness.merge_clocks})


def _route(log: sinks.BatchLog, cutoff_hours: int, idle_hours: int, exact: bool, batch: DataFrame, batch_id: int) -> None:
    own, known = lateness.source_clocks(batch), log.read("clocks")
    clocks = own if known is None else lateness.merge_clocks(known.unionByName(own))
    closed = materialize(lateness.closings(materialize(clocks, "clocks"), cutoff_hours, idle_hours), "closings")
    marked = lateness.mark_diverted(batch, closed, cutoff_hours, idle_hours, exact)
    late = marked.filter("diverted").select("stream_table", "delivery_id", "hour", "broker", "after_close")
    log.write(batch_id, {"deltas": lateness.hourly_deltas(marked), "clocks": own, "late": late})


def start_hourly(
    rows: DataFrame, root: str, checkpoint: str, cutoff_hours: int = lateness.CUTOFF_HOURS, idle_hours: int = lateness.IDLE_HOURS, exact: bool = True, **schedule: object
) -> StreamingQuery:
    """``rows`` as of ``lateness.stream_rows``."""
    each = partial(_route, hourly_log(rows.sparkSession, root), cutoff_hours, idle_hours, exact)
    return sinks.start_batches(rows, each, checkpoint, "hourly", **schedule)


def read_hourly(spark: SparkSession, root: str, cutoff_hours: int = lateness.CUTOFF_HOURS, idle_hours: int = lateness.IDLE_HOURS) -> DataFrame | None:
    """The aggregates as corrected so far, in the form of ``lateness.hourly``; null before the first batch."""
    log = hourly_log(spark, root)
    deltas, clocks = log.read("deltas"), log.read("clocks")
    if deltas is None or clocks is None:
        return None
    return lateness.hourly(deltas, lateness.closings(clocks, cutoff_hours, idle_hours), clocks, cutoff_hours, idle_hours)

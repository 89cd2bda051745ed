"""Late and out-of-order events: hourly aggregates by event time, corrected up to a cut-off, late rows diverted.

Every source (topic and partition) has a clock, the broker's timestamp of what it delivered; the least of them is the
stream's low watermark. A period's bound is its end plus the cut-off, and a source gives its punctuation for the bound
with its first record beyond it. A period is closed once every source has given its punctuation; a source that stays
silent for the idle time-out after the bound is not waited for. What arrives with the closing or after it is diverted.

Closing alone lets through what a source delivers beyond the bound while the period still waits for another source. Where
the cut-off is exact (``exact=True``), such a row, which only the punctuations tell from one that came in time, is
checked by its own instant and diverted too; otherwise it still corrects its period.

The clocks are aggregated per source and broker hour before anything else. Of a source only the hours in which it was
active are looked at: a bound that lies further before a source's next record than the time-out finds it idle, so a
clock row stands for as many bounds as the time-out has hours, and neither all pairs of sources and periods nor the rows
of a source are gathered anywhere. The input is read twice: for the clocks, and for routing the rows by the closings.

Defined results: a record exactly at its bound is in time; one without event time belongs to no period; one without
broker timestamp cannot be late and moves no clock; repeated deliveries count row by row; sums that exceed 64 bits are
null; an empty stream has no periods; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.tables import MICROS_PER_HOUR, hour_instant, utc_hour

CUTOFF_HOURS = 6
IDLE_HOURS = 2
#: Closings (stream and bound, 40 bytes each) that may be broadcast; more are joined by shuffle.
MAX_BROADCAST_ROWS = 500_000


def stream_rows(df: DataFrame, name: str, event_time: str, value: str) -> DataFrame:
    """What the operator needs of a stream. ``bound`` and ``tick`` number hours so that late means tick >= bound."""
    broker = F.unix_micros("kafka_timestamp")
    return df.select(
        F.lit(name).alias("stream_table"), F.col("delivery_id").cast("bigint").alias("delivery_id"),
        F.struct(F.coalesce("source_topic", F.lit("")).alias("topic"), F.coalesce("source_partition", F.lit(-1)).alias("partition")).alias("source"),
        utc_hour(event_time).alias("hour"), broker.alias("broker"), F.col(value).cast("bigint").alias("value"),
        (utc_hour(F.timestamp_micros(broker - 1))).alias("tick"),
    )


def bound_of(hour: Column, cutoff_hours: int) -> Column:
    return hour + F.lit(1 + cutoff_hours)


def source_clocks(rows: DataFrame) -> DataFrame:
    """(stream_table, source, tick, first, last): each source's first and last broker instant in each broker hour."""
    return rows.filter(F.col("tick").isNotNull()).groupBy("stream_table", "source", "tick").agg(F.min("broker").alias("first"), F.max("broker").alias("last"))


def merge_clocks(clocks: DataFrame) -> DataFrame:
    """Clocks of several batches to one."""
    return clocks.groupBy("stream_table", "source", "tick").agg(F.min("first").alias("first"), F.max("last").alias("last"))


def punctuations(clocks: DataFrame, idle_hours: int = IDLE_HOURS) -> DataFrame:
    """(stream_table, source, bound, passed): each source's punctuations for the bounds that find it active.

    A bound is passed with the first record of the source's next active hour, if that is within the time-out.
    """
    own = Window.partitionBy("stream_table", "source").orderBy("tick")
    since = F.greatest(F.col("tick") - F.lit(idle_hours), F.coalesce(F.lag("tick").over(own) + 1, F.col("tick") - F.lit(idle_hours)))
    return clocks.withColumn("since", since).select("stream_table", "source", F.explode(F.sequence("since", "tick")).alias("bound"), F.col("first").alias("passed"))


def closings(clocks: DataFrame, cutoff_hours: int = CUTOFF_HOURS, idle_hours: int = IDLE_HOURS) -> DataFrame:
    """(stream_table, hour, closed): the periods that all sources closed; the others are closed by the time-out."""
    limit = (F.col("bound") + F.lit(idle_hours)) * F.lit(MICROS_PER_HOUR)
    given = punctuations(clocks, idle_hours).groupBy("stream_table", "bound").agg(F.count("*").alias("n"), F.max(F.least("passed", limit)).alias("closed"))
    sources = clocks.groupBy("stream_table").agg(F.count_distinct("source").alias("n_sources"))
    both = given.join(sources, "stream_table").filter(F.col("n") == F.col("n_sources"))
    return both.select("stream_table", (F.col("bound") - F.lit(1 + cutoff_hours)).alias("hour"), "closed")


def _closed(cutoff_hours: int, idle_hours: int) -> Column:
    """When a period was closed: by its sources, else by the time-out."""
    return F.coalesce("closed", (bound_of(F.col("hour"), cutoff_hours) + F.lit(idle_hours)) * F.lit(MICROS_PER_HOUR))


def _with_closings(rows: DataFrame, closed: DataFrame) -> DataFrame:
    if closed.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        closed = F.broadcast(closed)
    return rows.join(closed, ["stream_table", "hour"], "left")


def mark_diverted(rows: DataFrame, closed: DataFrame, cutoff_hours: int = CUTOFF_HOURS, idle_hours: int = IDLE_HOURS, exact: bool = True) -> DataFrame:
    """``rows`` with ``after_close`` (came after its period was closed) and ``diverted``; see above for ``exact``."""
    # a closing lies beyond its bound, so this implies ``beyond``
    after = F.coalesce(F.col("broker") >= _closed(cutoff_hours, idle_hours), F.lit(False))
    beyond = F.coalesce(F.col("tick") >= bound_of(F.col("hour"), cutoff_hours), F.lit(False))
    marked = _with_closings(rows, closed).withColumn("after_close", after)
    return marked.withColumn("diverted", (F.col("after_close") | beyond) if exact else F.col("after_close")).drop("closed")


def hourly_deltas(marked: DataFrame) -> DataFrame:
    """Additive aggregates per stream and hour of event time."""
    kept = ~F.col("diverted")
    late = F.coalesce(F.col("broker") >= (F.col("hour") + 1) * F.lit(MICROS_PER_HOUR), F.lit(False))
    return marked.filter(F.col("hour").isNotNull()).groupBy("stream_table", "hour").agg(
        F.count_if(kept).alias("n_rows"), F.try_sum(F.when(kept, F.col("value"))).alias("value_sum"), F.count_if(kept & late).alias("n_corrections"),
        F.count_if(F.col("diverted")).alias("n_diverted"), F.count_if(F.col("after_close")).alias("n_after_close"),
    )


def hourly(deltas: DataFrame, closed: DataFrame, clocks: DataFrame, cutoff_hours: int = CUTOFF_HOURS, idle_hours: int = IDLE_HOURS) -> DataFrame:
    """The aggregates with their closings; ``is_final`` once the stream's last record has reached the closing."""
    ends = clocks.groupBy("stream_table").agg(F.max("last").alias("frontier"))
    full = deltas.join(closed, ["stream_table", "hour"], "left").join(ends, "stream_table", "left").withColumn("closed", _closed(cutoff_hours, idle_hours))
    return full.select(
        "stream_table", hour_instant(F.col("hour")).alias("event_hour"), "n_rows", "value_sum", "n_corrections", "n_diverted", "n_after_close",
        F.timestamp_micros("closed").alias("closed_at"), F.coalesce(F.col("closed") <= F.col("frontier"), F.lit(False)).alias("is_final"),
    )

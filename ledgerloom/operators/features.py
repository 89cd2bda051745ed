"""Per-customer features of events: velocity, first use of a device, first country, with an expiry of idle state.

A customer's events within one window length are all that velocity needs, so rows are grouped by customer and time
bucket, each row also being carried into the following bucket: no task gets a customer's whole history. First uses
are group minima, combined map-side and joined back.

Defined results: rows are ordered by event time, then arrival; an event sees itself; events without customer or event
time get null features; a payment counts once in a window; repeated arrivals must be removed before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW_MS = 300_000
STATE_TTL_S = 2_592_000


def velocity(events: DataFrame, window_ms: int = WINDOW_MS) -> DataFrame:
    """(seq, velocity): distinct payments of the customer in [t - window, t], up to and with the event.

    An occurrence of a payment counts from its event until the window has passed or the payment occurs again, whichever
    comes first; velocity is the number of occurrences that count. So it is a running sum of +1 and -1, in as many steps
    as twice the events. Sums start anew in each bucket of one window's length, into which an occurrence that counts
    beyond its own bucket is carried; a bucket is all that one task must sort.
    """
    rows = events.filter(F.col("customer_id").isNotNull() & F.col("ms").isNotNull()).select("customer_id", "payment_id", "ms", "seq")
    again = F.lead(F.struct("ms", "seq")).over(Window.partitionBy("customer_id", "payment_id", "bucket").orderBy("ms", "seq"))
    bucket = lambda ms: F.call_function("div", ms - F.pmod(ms, F.lit(window_ms)), F.lit(window_ms))
    # an occurrence is seen in its own bucket and, as what came before, in the next
    copies = F.explode(F.array(F.struct(bucket(F.col("ms")).alias("bucket"), F.lit(True).alias("asks")), F.struct((bucket(F.col("ms")) + 1).alias("bucket"), F.lit(False).alias("asks"))))
    dealt = rows.select("*", copies.alias("c")).select("customer_id", "payment_id", "ms", "seq", "c.*").withColumn("again", again)
    # (at, step, seq): at one instant, what ends with the instant before comes first, then the events in their order
    expired = F.struct((F.col("ms") + window_ms + 1).alias("at"), F.lit(0).alias("step"), F.lit(0).cast("bigint").alias("seq"))
    replaced = F.struct(F.col("again.ms").alias("at"), F.lit(1).alias("step"), F.col("again.seq").cast("bigint").alias("seq"))
    begins = F.struct(F.col("ms").alias("at"), F.lit(1).alias("step"), F.col("seq").cast("bigint").alias("seq"))
    steps = F.array(F.struct(begins.alias("place"), F.lit(1).alias("change"), "asks"), F.struct(F.when(F.col("again").isNull(), expired).otherwise(F.least(expired, replaced)).alias("place"), F.lit(-1).alias("change"), F.lit(False).alias("asks")))
    line = dealt.select("customer_id", "bucket", "seq", F.explode(steps).alias("s")).select("customer_id", "bucket", "seq", "s.*")
    upto = Window.partitionBy("customer_id", "bucket").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return line.withColumn("velocity", F.sum("change").over(upto)).filter("asks").select("seq", F.col("velocity").cast("int").alias("velocity"))


def state_epochs(events: DataFrame, ttl_s: int = STATE_TTL_S) -> DataFrame:
    """(customer_id, hour, epoch): a new epoch begins after a silence longer than the time to live (one hour at least).

    Customers are reduced to their busy hours first; only these are put in order.
    """
    hour = F.call_function("div", F.col("ms") - F.pmod("ms", F.lit(3_600_000)), F.lit(3_600_000))
    busy = events.filter(F.col("customer_id").isNotNull() & F.col("ms").isNotNull()).groupBy("customer_id", hour.alias("hour")).agg(F.min("ms").alias("first"), F.max("ms").alias("last"))
    line = Window.partitionBy("customer_id").orderBy("hour")
    silent = (F.col("first") - F.lag("last").over(line)) > F.lit(ttl_s * 1000)
    marked = busy.withColumn("_new", F.when(silent, 1).otherwise(0))
    return marked.select("customer_id", "hour", F.sum("_new").over(line).alias("epoch"))


def first_uses(events: DataFrame, ttl_s: int = STATE_TTL_S) -> DataFrame:
    """(seq, new_device, cross_border, baseline_country) of every event with customer and event time."""
    hour = F.call_function("div", F.col("ms") - F.pmod("ms", F.lit(3_600_000)), F.lit(3_600_000))
    rows = events.filter(F.col("customer_id").isNotNull() & F.col("ms").isNotNull()).withColumn("hour", hour).join(state_epochs(events, ttl_s), ["customer_id", "hour"])
    place = F.struct("ms", "seq")
    device = rows.filter(F.col("device_id").isNotNull()).groupBy("customer_id", "epoch", "device_id").agg(F.min(place).alias("first_use"))
    home = rows.groupBy("customer_id", "epoch").agg(F.min_by("country", place).alias("baseline_country"))
    joined = rows.join(home, ["customer_id", "epoch"]).join(device, ["customer_id", "epoch", "device_id"], "left")
    return joined.select("seq", F.coalesce(F.col("first_use") == place, F.lit(False)).alias("new_device"), (~F.col("country").eqNullSafe(F.col("baseline_country"))).alias("cross_border"), "baseline_country")


def features(events: DataFrame, window_ms: int = WINDOW_MS, ttl_s: int = STATE_TTL_S) -> DataFrame:
    """(seq, velocity, new_device, cross_border, baseline_country)."""
    return velocity(events, window_ms).join(first_uses(events, ttl_s), "seq")

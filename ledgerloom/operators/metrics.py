"""Mergeable daily metrics: additive deltas by dimension, and what is derived from them after merging.

Each family is one aggregation by grouping sets, so a row is expanded only inside the map-side aggregation and only
partial sums are shuffled. A delta has six keys and additive measures; rates and averages are derived last and never
merged. Null dimensions form groups of their own; guards give null instead of dividing by nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The columns of a delta, and the names of families, dimensions and buckets below.
KEYS = ["event_date", "metric_family", "dimension_type", "dimension_value", "outcome", "metric_bucket"]
SUMS = ["event_count", "amount_minor_sum", "risk_score_sum", "risk_score_count", "latency_ms_sum", "latency_ms_count"]
LEAST = ["risk_score_min", "latency_ms_min"]
GREATEST = ["risk_score_max", "latency_ms_max"]
_MEASURES = {
    "event_count": "bigint", "amount_minor_sum": "bigint", "risk_score_sum": "bigint", "risk_score_count": "bigint", "risk_score_min": "int",
    "risk_score_max": "int", "latency_ms_sum": "bigint", "latency_ms_count": "bigint", "latency_ms_min": "bigint", "latency_ms_max": "bigint",
}


def _delta(df: DataFrame, family: str, kind: Column, value: Column, outcome: Column | None = None, bucket: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Aggregated rows in the form of a delta; measures that the family lacks are null, their counts 0."""
    none = F.lit(None).cast("string")
    zero = {"risk_score_count", "latency_ms_count"}
    measures = [F.col(m).cast(t).alias(m) if m in df.columns else F.lit(0 if m in zero else None).cast(t).alias(m) for m, t in _MEASURES.items()]
    keys = [F.col("event_date"), F.lit(family).alias("metric_family"), kind.alias("dimension_type"), value.alias("dimension_value")]
    return df.select(*by, *keys, (none if outcome is None else outcome).alias("outcome"), (none if bucket is None else bucket).alias("metric_bucket"), *measures)


def payment_volume(payments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count and amount: overall, by merchant, by country. Here and below ``by`` are further keys, which stay columns."""
    day, merchant, country = F.col("event_date"), F.col("merchant_id"), F.col("country")
    outer = ["event_date", *by]
    cube = payments.groupingSets([outer, [*outer, "merchant_id"], [*outer, "country"]], day, *map(F.col, by), merchant, country)
    found = cube.agg(F.grouping("merchant_id").alias("gm"), F.grouping("country").alias("gc"), F.count("*").alias("event_count"), F.sum("amount_minor").alias("amount_minor_sum"))
    kind = F.when(F.col("gm") == 0, "merchant").when(F.col("gc") == 0, "country").otherwise("overall")
    return _delta(found, "payment_volume", kind, F.when(F.col("gm") == 0, merchant).when(F.col("gc") == 0, country).otherwise("ALL"), by=by)


def decision_counts(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count by outcome."""
    found = decisions.groupBy("event_date", *by, "decision").agg(F.count("*").alias("event_count"))
    return _delta(found, "decision_rate", F.lit("overall"), F.lit("ALL"), outcome=F.col("decision"), by=by)


def score_bucket(score: Column) -> Column:
    """Ten-point buckets ``00-09`` to ``90-100``."""
    low = F.least(F.floor(score / F.lit(10)) * F.lit(10), F.lit(90)).cast("int")
    return F.format_string("%02d-%02d", low, F.when(low == 90, F.lit(100)).otherwise(low + 9))


def score_distribution(decisions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Scores by bucket: overall and by decision."""
    rows = decisions.select("event_date", *by, "decision", "risk_score", score_bucket(F.col("risk_score")).alias("bucket"))
    outer = ["event_date", *by, "bucket"]
    cube = rows.groupingSets([outer, [*outer, "decision"]], *map(F.col, outer), F.col("decision"))
    found = cube.agg(
        F.grouping("decision").alias("gd"), F.count("*").alias("event_count"), F.sum("risk_score").alias("risk_score_sum"),
        F.count("risk_score").alias("risk_score_count"), F.min("risk_score").alias("risk_score_min"), F.max("risk_score").alias("risk_score_max"),
    )
    whole = F.col("gd") == 1
    return _delta(found, "risk_score_distribution", F.when(whole, "overall").otherwise("decision"), F.when(whole, F.lit("ALL")).otherwise(F.col("decision")), bucket=F.col("bucket"), by=by)


def ingestion_latency(*streams: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Milliseconds from broker to lake by topic, at least 0."""
    late = F.greatest(F.lit(0).cast("bigint"), F.unix_millis("ingested_at") - F.unix_millis("kafka_timestamp"))
    rows = reduce(DataFrame.unionByName, [s.select("event_date", *by, "source_topic", late.alias("ms")) for s in streams])
    found = rows.groupBy("event_date", *by, "source_topic").agg(
        F.count("*").alias("event_count"), F.sum("ms").alias("latency_ms_sum"), F.count("ms").alias("latency_ms_count"), F.min("ms").alias("latency_ms_min"), F.max("ms").alias("latency_ms_max")
    )
    return _delta(found, "ingestion_latency", F.lit("source_topic"), F.col("source_topic"), by=by)


def quarantine_errors(quarantine: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count by topic and error code."""
    rows = quarantine.select("event_date", *by, "source_topic", F.explode("error_codes").alias("error_code"))
    found = rows.groupBy("event_date", *by, "source_topic", "error_code").agg(F.count("*").alias("event_count"))
    return _delta(found, "quarantine_error", F.lit("source_topic"), F.col("source_topic"), bucket=F.col("error_code"), by=by)


def daily_deltas(payments: DataFrame, decisions: DataFrame, quarantine: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The additive deltas of all families of one batch, or of several at once if ``by`` tells them apart."""
    families = [payment_volume(payments, by), decision_counts(decisions, by), score_distribution(decisions, by), ingestion_latency(payments, decisions, by=by), quarantine_errors(quarantine, by)]
    return reduce(DataFrame.unionByName, families)


def merge_deltas(deltas: DataFrame) -> DataFrame:
    """Deltas of several batches to one: sums are added, extremes taken; nothing derived is carried over."""
    sums = [F.sum(c).cast(_MEASURES[c]).alias(c) for c in SUMS]
    ends = [F.min(c).alias(c) for c in LEAST] + [F.max(c).alias(c) for c in GREATEST]
    merged = deltas.groupBy(*KEYS).agg(*sums, *ends)
    return merged.select(*KEYS, *_MEASURES)


def with_derived(deltas: DataFrame) -> DataFrame:
    """Adds denominators, rates and averages to merged deltas."""
    peers = Window.partitionBy("event_date", "metric_family", "dimension_type", "dimension_value")
    rated = deltas.withColumn("denominator_count", F.when(F.col("metric_family") == "decision_rate", F.sum("event_count").over(peers)))

    def ratio(over: str, under: str) -> Column:
        return F.when(F.col(under) > 0, F.col(over) / F.col(under))

    return rated.withColumns({
        "rate": ratio("event_count", "denominator_count"), "risk_score_avg": ratio("risk_score_sum", "risk_score_count"), "latency_ms_avg": ratio("latency_ms_sum", "latency_ms_count"),
    })


def inspection(metrics: DataFrame) -> DataFrame:
    """(section, member, event_count, amount_minor_sum, average, least, greatest) over all days of merged deltas."""
    rows = metrics.groupBy("metric_family", "dimension_type", "dimension_value", "outcome", "metric_bucket").agg(
        F.sum("event_count").alias("event_count"), F.sum("amount_minor_sum").alias("amount_minor_sum"), F.sum("latency_ms_sum").alias("ms"),
        F.sum("latency_ms_count").alias("timed"), F.min("latency_ms_min").alias("least"), F.max("latency_ms_max").alias("greatest"),
    )
    return rows.select(
        F.concat_ws(".", "metric_family", "dimension_type").alias("section"), F.concat_ws("|", "dimension_value", "outcome", "metric_bucket").alias("member"),
        "event_count", "amount_minor_sum", F.when(F.col("timed") > 0, F.col("ms") / F.col("timed")).alias("average_ms"), "least", "greatest",
    )

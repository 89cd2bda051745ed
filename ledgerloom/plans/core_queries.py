"""Queries of the general problems: parse failures, orphans, late events, repeated deliveries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import dedup, lateness, orphans, rejects
from ledgerloom.operators.orphans import Reference
from ledgerloom.session import materialize
from ledgerloom.tables import day_text, table

Query = Callable[[SparkSession, str], DataFrame]


def portable(df: DataFrame, nan_columns: tuple[str, ...] = ()) -> DataFrame:
    """For comparison with other engines: instants and days as text, lists joined by ``|``.

    No two engines agree on NaN, so each of ``nan_columns`` is null for it and a column ``..._is_nan`` keeps it apart.
    """
    for c in nan_columns:
        df = df.withColumns({c: F.when(~F.isnan(c), F.col(c)), f"{c}_is_nan": F.coalesce(F.isnan(c), F.lit(False))})
    forms = {"timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), "date": lambda c: F.col(c).cast("string"), "array<string>": lambda c: F.array_join(c, "|")}
    return df.withColumns({c: forms[kind](c) for c, kind in df.dtypes if kind in forms})


#: Which fields lead to which tables, by referring table: (key, arrival instant, references).
REFERENCES = {
    "payment_events": ("delivery_id", "ingested_at", [Reference("payment_events", "payment_id", "payments")]),
    "decision_events": (
        "delivery_id", "ingested_at",
        [Reference("decision_events", "payment_id", "payments"), Reference("decision_events", "source_event_id", "outbox_events")],
    ),
    "reconciliation_exceptions": ("exception_id", "reported_at", [Reference("reconciliation_exceptions", "payment_id", "payments")]),
}


def _screened(spark: SparkSession, d: str, load: bool = True) -> rejects.Screened:
    return rejects.Screened(table(spark, d, "broker_records"), table(spark, d, "contract_fields"), load)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _screened(spark, d, load=False).coordinates()


def p1_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return portable(_screened(spark, d).rejected().withColumn("reasons", F.array_join("reasons", ";")))


def p1_invalid_values(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct invalid values the dictionary holds by column and reason."""
    return _screened(spark, d, load=False).invalid_values().groupBy("source_topic", "path", "reason").agg(F.count("*").alias("n_values"))


def p1_payment_envelopes(spark: SparkSession, d: str) -> DataFrame:
    return portable(_screened(spark, d).valid("payments.created"))


def p1_decision_envelopes(spark: SparkSession, d: str) -> DataFrame:
    return portable(_screened(spark, d).valid("risk.decisions"))


def _orphans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    every = None
    for name, (key, arrived, fields) in REFERENCES.items():
        own = orphans.collect_references(table(spark, d, name), fields, key, arrived)
        every = own if every is None else every.unionByName(own)
    parents = {name: table(spark, d, name) for name in ("payments", "outbox_events")}
    return orphans.find_orphans(every, parents, table(spark, d, "deleted_records"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    _, dangling = _orphans(spark, d)
    return dangling.select("ref_table", "ref_field", "ref_key", day_text(F.col("day")).alias("ref_day"))


def p2_by_day(spark: SparkSession, d: str) -> DataFrame:
    every, dangling = _orphans(spark, d)
    return orphans.count_by_day(every, dangling)


def _streams(spark: SparkSession, d: str) -> DataFrame:
    payments = lateness.stream_rows(table(spark, d, "payment_events"), "payment_events", "occurred_at", "amount_minor")
    decisions = lateness.stream_rows(table(spark, d, "decision_events"), "decision_events", "decision_at", "risk_score")
    return payments.unionByName(decisions)


def _clocks(rows: DataFrame) -> DataFrame:
    # written once: the closings are asked for their size and then joined
    return materialize(lateness.source_clocks(rows), "clocks")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _streams(spark, d)
    return lateness.mark_diverted(rows, lateness.closings(_clocks(rows))).filter("diverted").select("stream_table", "delivery_id")


def p3_hourly(spark: SparkSession, d: str) -> DataFrame:
    rows = _streams(spark, d)
    clocks = _clocks(rows)
    closed = materialize(lateness.closings(clocks), "closings")
    return portable(lateness.hourly(lateness.hourly_deltas(lateness.mark_diverted(rows, closed)), closed, clocks))


def p3_after_close(spark: SparkSession, d: str) -> DataFrame:
    """The rows that came after all sources had closed their period, or after the time-out."""
    rows = _streams(spark, d)
    marked = lateness.mark_diverted(rows, lateness.closings(_clocks(rows)), exact=False)
    return marked.filter("diverted").select("stream_table", "delivery_id")


def _repeated(spark: SparkSession, d: str, name: str, ids: tuple[str, ...]) -> DataFrame:
    df = table(spark, d, name).select("delivery_id", *ids, *dedup.COORDINATES)
    found = dedup.redundant_rows(df, dedup.message_key(ids))
    return found.select(F.lit(name).alias("stream_table"), "delivery_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    payments = _repeated(spark, d, "payment_events", ("event_id",))
    return payments.unionByName(_repeated(spark, d, "decision_events", ("event_id", "decision_id")))


def p5_unique_payment_events(spark: SparkSession, d: str) -> DataFrame:
    return portable(dedup.unique_rows(table(spark, d, "payment_events"), dedup.message_key(("event_id",))))


def p5_unique_decision_events(spark: SparkSession, d: str) -> DataFrame:
    rows = dedup.unique_rows(table(spark, d, "decision_events"), dedup.message_key(("event_id", "decision_id")))
    return portable(rows, ("model_probability", "model_review_threshold"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_quarantine, p1_invalid_values, p1_payment_envelopes, p1_decision_envelopes, p2_found, p2_by_day,
        p3_found, p3_hourly, p3_after_close, p5_found, p5_unique_payment_events, p5_unique_decision_events,
    )
}


def _text(instant: str) -> str:
    """SQL for an instant as ``portable`` writes it."""
    return f"strftime({instant} AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S.%f')"


def _no_nan(column: str) -> str:
    return f"CASE WHEN NOT isnan({column}) THEN {column} END AS {column}"


_REFERENCES_SQL = """
refs AS (
  SELECT 'payment_events' ref_table, 'payment_id' ref_field, 'payments' parent, payment_id v, delivery_id ref_key, ingested_at arrived FROM payment_events
  UNION ALL SELECT 'decision_events', 'payment_id', 'payments', payment_id, delivery_id, ingested_at FROM decision_events
  UNION ALL SELECT 'decision_events', 'source_event_id', 'outbox_events', source_event_id, delivery_id, ingested_at FROM decision_events
  UNION ALL SELECT 'reconciliation_exceptions', 'payment_id', 'payments', payment_id, exception_id, reported_at FROM reconciliation_exceptions),
keyed AS (SELECT ref_table, ref_field, parent, lower(trim(v, ' ')) v, ref_key, CAST(floor(epoch_us(arrived) / 86400000000) AS BIGINT) d FROM refs WHERE trim(v, ' ') <> ''),
parents AS (
  SELECT 'payments' parent, lower(trim(id, ' ')) v, min(epoch_us(loaded_at)) loaded FROM payments GROUP BY ALL
  UNION ALL SELECT 'outbox_events', lower(trim(id, ' ')), min(epoch_us(loaded_at)) FROM outbox_events GROUP BY ALL),
gone AS (SELECT table_name parent, lower(trim(record_id, ' ')) v, epoch_us(deleted_at) since, epoch_us(restored_at) back FROM deleted_records),
judged AS (
  SELECT k.*, (p.loaded IS NULL OR p.loaded >= (k.d + 1) * 86400000000
    OR EXISTS (SELECT 1 FROM gone g WHERE g.parent = k.parent AND g.v = k.v AND g.since < (k.d + 1) * 86400000000 AND (g.back IS NULL OR g.back >= (k.d + 1) * 86400000000))) dangles
  FROM keyed k LEFT JOIN parents p ON p.parent = k.parent AND p.v = k.v)
"""
_DAY = "strftime(DATE '1970-01-01' + CAST(d AS INTEGER), '%Y-%m-%d')"
_STREAMS_SQL = """
raw AS (
  SELECT 'payment_events' stream_table, delivery_id, epoch_us(occurred_at) e, epoch_us(kafka_timestamp) k, amount_minor val, source_topic t, source_partition p FROM payment_events
  UNION ALL SELECT 'decision_events', delivery_id, epoch_us(decision_at), epoch_us(kafka_timestamp), risk_score, source_topic, source_partition FROM decision_events),
s AS (SELECT *, CAST(floor(e / 3600000000) AS BIGINT) h, coalesce(k > (CAST(floor(e / 3600000000) AS BIGINT) + 7) * 3600000000, false) late FROM raw)
"""
#: When each period was closed, from all pairs of its sources and periods.
_CLOSED_SQL = """
sources AS (SELECT DISTINCT stream_table, t, p FROM s WHERE k IS NOT NULL), bounds AS (SELECT DISTINCT stream_table, h FROM s WHERE h IS NOT NULL),
passed AS (SELECT b.stream_table, b.h, o.t, o.p, min(s.k) k FROM bounds b JOIN sources o USING (stream_table)
  LEFT JOIN s ON s.stream_table = b.stream_table AND s.t = o.t AND s.p = o.p AND s.k > (b.h + 7) * 3600000000 GROUP BY ALL),
closed AS (SELECT stream_table, h, max(least(coalesce(k, (h + 9) * 3600000000), (h + 9) * 3600000000)) c FROM passed GROUP BY ALL),
frontier AS (SELECT stream_table, max(k) f FROM s GROUP BY ALL)"""
_FIRSTS_SQL = "row_number() OVER (PARTITION BY {key} ORDER BY delivery_id) AS rn"
_REPLACE = "occurred_at, kafka_timestamp, ingested_at".split(", ")
_AS_MICROS = ", ".join(f"{_text(c)} AS {c}" for c in _REPLACE) + ", CAST(event_date AS VARCHAR) AS event_date"
_PAYMENT_KEY = "coalesce(nullif(lower(trim(event_id, ' ')), ''), concat('c:', source_topic, '|', source_partition, '|', source_offset, '|', leader_epoch))"
_DECISION_KEY = "coalesce(nullif(lower(trim(event_id, ' ')), ''), nullif(lower(trim(decision_id, ' ')), ''), concat('c:', source_topic, '|', source_partition, '|', source_offset, '|', leader_epoch))"

ORACLE: dict[str, str] = {
    "p2_found": f"WITH {_REFERENCES_SQL} SELECT ref_table, ref_field, ref_key, {_DAY} AS ref_day FROM judged WHERE dangles",
    "p2_by_day": f"WITH {_REFERENCES_SQL} SELECT ref_table, ref_field, {_DAY} AS ref_day, count(*) AS n_references, count(*) FILTER (dangles) AS n_dangling FROM judged GROUP BY ALL",
    "p3_found": f"WITH {_STREAMS_SQL} SELECT stream_table, delivery_id FROM s WHERE late",
    "p3_hourly": f"""WITH {_STREAMS_SQL}, {_CLOSED_SQL}
SELECT s.stream_table, {_text('make_timestamptz(s.h * 3600000000)')} AS event_hour, count(*) FILTER (NOT late) AS n_rows, CAST(sum(val) FILTER (NOT late) AS BIGINT) AS value_sum,
  count(*) FILTER (NOT late AND k >= (s.h + 1) * 3600000000) AS n_corrections, count(*) FILTER (late) AS n_diverted, count(*) FILTER (k >= c) AS n_after_close,
  {_text('make_timestamptz(any_value(c))')} AS closed_at, any_value(c) <= any_value(f) AS is_final
FROM s JOIN closed USING (stream_table, h) JOIN frontier USING (stream_table) WHERE s.h IS NOT NULL GROUP BY s.stream_table, s.h""",
    "p3_after_close": f"WITH {_STREAMS_SQL}, {_CLOSED_SQL} SELECT stream_table, delivery_id FROM s JOIN closed USING (stream_table, h) WHERE k >= c",
    "p5_found": f"""SELECT 'payment_events' AS stream_table, delivery_id FROM (SELECT delivery_id, {_FIRSTS_SQL.format(key=_PAYMENT_KEY)} FROM payment_events) WHERE rn > 1
UNION ALL SELECT 'decision_events', delivery_id FROM (SELECT delivery_id, {_FIRSTS_SQL.format(key=_DECISION_KEY)} FROM decision_events) WHERE rn > 1""",
    "p5_unique_payment_events": f"SELECT * EXCLUDE (rn) REPLACE ({_AS_MICROS}, {_text('created_at')} AS created_at) FROM (SELECT *, {_FIRSTS_SQL.format(key=_PAYMENT_KEY)} FROM payment_events) WHERE rn = 1",
    "p5_unique_decision_events": f"""SELECT * EXCLUDE (rn) REPLACE ({_AS_MICROS}, {_text('decision_at')} AS decision_at, array_to_string(reason_codes, '|') AS reason_codes, {_no_nan('model_probability')}, {_no_nan('model_review_threshold')}),
  coalesce(isnan(model_probability), false) AS model_probability_is_nan, coalesce(isnan(model_review_threshold), false) AS model_review_threshold_is_nan FROM (SELECT *, {_FIRSTS_SQL.format(key=_DECISION_KEY)} FROM decision_events) WHERE rn = 1""",
}

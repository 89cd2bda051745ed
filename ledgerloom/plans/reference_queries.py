"""Queries over payments, outbox, decisions and deliveries: metrics, controls, read models, features, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import hashing
from ledgerloom.functions import text as X
from ledgerloom.functions.profiles import DECISIONS_TOPIC, PAYMENTS_TOPIC
from ledgerloom.functions.rules import error_codes, first_error
from ledgerloom.operators import changes, curate, evaluate, features, metrics, reconcile, snapshot, validate
from ledgerloom.operators.rejects import read_contracts
from ledgerloom.plans import domain
from ledgerloom.plans.core_queries import Query, portable
from ledgerloom.session import materialize
from ledgerloom.tables import clean_id, table


def _at(text: str) -> Column:
    return F.lit(text).cast("timestamp")


# --- contracts and curation -------------------------------------------------------------------------------------------


def _curated(spark: SparkSession, d: str) -> curate.Curated:
    return curate.curate(table(spark, d, "broker_records"), read_contracts(table(spark, d, "contract_fields")))


def lake_payments(spark: SparkSession, d: str) -> DataFrame:
    return portable(_curated(spark, d).valid(PAYMENTS_TOPIC).drop("ingested_at"))


def lake_decisions(spark: SparkSession, d: str) -> DataFrame:
    return portable(_curated(spark, d).valid(DECISIONS_TOPIC).drop("ingested_at"))


def lake_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return portable(_curated(spark, d).quarantine().drop("quarantined_at"))


def decision_violations(spark: SparkSession, d: str) -> DataFrame:
    return domain.checked(spark, d, "decision_events").filter(F.col("errors") != "").select("delivery_id", "errors")


def payment_violations(spark: SparkSession, d: str) -> DataFrame:
    return domain.checked(spark, d, "payment_events").filter(F.col("errors") != "").select("delivery_id", "errors")


def violation_histogram(spark: SparkSession, d: str) -> DataFrame:
    parts = [domain.checked(spark, d, n).select(F.lit(n).alias("stream_table"), F.explode(error_codes(F.col("errors"))).alias("error_code")) for n in domain.TOPICS]
    return parts[0].unionByName(parts[1]).groupBy("stream_table", "error_code").agg(F.count("*").alias("n"))


def first_violations(spark: SparkSession, d: str) -> DataFrame:
    """Of each rejected decision only what its ordered checks find first."""
    rows = domain.checked(spark, d, "decision_events").select(first_error(F.col("errors")).alias("error_code"))
    return rows.filter("error_code IS NOT NULL").groupBy("error_code").agg(F.count("*").alias("n"))


def decision_errors(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that each rejected decision event fails, by the store's profile and by the worker's."""
    rows = table(spark, d, "decision_events").select("delivery_id", validate.decision_error().alias("store_error"), validate.decision_error("rules-v1").alias("worker_error"))
    return rows.filter("store_error IS NOT NULL OR worker_error IS NOT NULL")


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name in ("payment_events", "decision_events"):
        df = table(spark, d, name)
        parts.append(df.agg(F.lit(name).alias("stream_table"), F.count("*").alias("n_rows"), F.count_distinct(clean_id("event_id")).alias("n_events"), F.count_distinct("batch_id").alias("n_batches")))
    return parts[0].unionByName(parts[1])


# --- metrics ----------------------------------------------------------------------------------------------------------


def _metric_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid rows, each event once, and all rejected ones; written once, with only what the families need."""
    timed = ["event_date", "source_topic", "batch_id", "kafka_timestamp", "ingested_at"]
    paid = domain.unique_events(spark, d, "payment_events", *timed, "merchant_id", "country", "amount_minor").withColumn("merchant_id", F.trim("merchant_id"))
    decided = domain.unique_events(spark, d, "decision_events", *timed, "decision", "risk_score")
    bad = None
    for name in domain.TOPICS:
        rows = domain.checked(spark, d, name).filter(F.col("errors") != "")
        own = rows.select("batch_id", F.to_date("kafka_timestamp").alias("event_date"), "source_topic", error_codes(F.col("errors")).alias("error_codes"))
        bad = own if bad is None else bad.unionByName(own)
    return materialize(paid, "metric-payments"), materialize(decided, "metric-decisions"), materialize(bad, "metric-rejected")


def metrics_daily(spark: SparkSession, d: str) -> DataFrame:
    return portable(metrics.with_derived(metrics.daily_deltas(*_metric_inputs(spark, d))))


def metrics_merged(spark: SparkSession, d: str) -> DataFrame:
    """Deltas of every batch, in one pass with the batch as a key, then merged: the same as in one go."""
    deltas = metrics.daily_deltas(*_metric_inputs(spark, d), by=["batch_id"])
    return portable(metrics.with_derived(metrics.merge_deltas(deltas)))


def metrics_inspection(spark: SparkSession, d: str) -> DataFrame:
    return metrics.inspection(metrics.daily_deltas(*_metric_inputs(spark, d)))


# --- read models ------------------------------------------------------------------------------------------------------


def payments_current(spark: SparkSession, d: str) -> DataFrame:
    return portable(domain.payments(spark, d))


def payment_summary(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.summary(domain.payments(spark, d, "status", "amount_minor"), "status", ["PENDING_RISK", "ALLOWED", "REVIEW", "BLOCKED", "FAILED"], "amount_minor")


def decision_summary(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.decision_summary(domain.decisions(spark, d, "decision", "risk_score"))


def processing_summary(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.processing(domain.outbox(spark, d), domain.deliveries(spark, d))


def operational_gauges(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.gauges(domain.outbox(spark, d), domain.deliveries(spark, d), domain.reviews(spark, d))


def recent_decisions(spark: SparkSession, d: str) -> DataFrame:
    found = snapshot.recent(domain.decisions(spark, d, "payment_id", "decision", "risk_score", "decision_at"), domain.payments(spark, d, "customer_id", "merchant_id", "amount_minor", "currency", "country", "status"))
    return portable(found.select("decision_id", "payment_id", "customer_id", "merchant_id", "amount_minor", "currency", "country", "status", "decision", "risk_score", "decision_at"))


def latest_versions(spark: SparkSession, d: str) -> DataFrame:
    return portable(snapshot.latest_versions(domain.decisions(spark, d, "rule_version", "model_version", "decision_at")))


def pending_reviews(spark: SparkSession, d: str) -> DataFrame:
    queue = domain.reviews(spark, d).select("payment_id", "decision_id", "enqueued_at")
    paid = domain.payments(spark, d, "customer_id", "amount_minor", "currency")
    decided = domain.decisions(spark, d, "risk_score", "model_version")
    return portable(queue.join(paid, "payment_id").join(decided, "decision_id").orderBy("enqueued_at", "payment_id").limit(50))


def next_due_events(spark: SparkSession, d: str) -> DataFrame:
    return portable(snapshot.next_due(domain.outbox(spark, d), _at(domain.AS_OF)).select("id", "next_attempt_at", "delivery_attempts"))


def attention_count(spark: SparkSession, d: str) -> DataFrame:
    return snapshot.attention(snapshot.processing(domain.outbox(spark, d), domain.deliveries(spark, d)), domain.reviews(spark, d), _controls(spark, d))


def newest_decision(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.decisions(spark, d, "payment_id", "decision", "risk_score", "decision_at")
    return portable(snapshot.newest_by(rows, "payment_id", ["decision_at", "decision_id"]))


def decisions_by_day(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.decisions(spark, d, "decision", "decision_at").groupBy(F.to_date("decision_at").alias("decision_date"))
    counts = [F.count_if(F.col("decision") == v).alias(n) for v, n in (("ALLOW", "allowed"), ("REVIEW", "reviewed"), ("BLOCK", "blocked"))]
    return portable(rows.agg(F.count("*").alias("total"), *counts))


def dispositions(spark: SparkSession, d: str) -> DataFrame:
    return domain.deliveries(spark, d).groupBy("disposition").agg(F.count("*").alias("n"))


def outcome_shares(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.outcome_shares(domain.decisions(spark, d, "decision"), "decision")


# --- controls ---------------------------------------------------------------------------------------------------------


def _controls(spark: SparkSession, d: str) -> DataFrame:
    # seven controls read these, so each is reduced to what they need and written once
    paid = materialize(domain.payments(spark, d, "status", "created_at"), "payments")
    decided = materialize(domain.decisions(spark, d, "payment_id", "decision", "decision_at"), "decisions")
    delivered = materialize(domain.deliveries(spark, d), "deliveries")
    queue = materialize(domain.reviews(spark, d, paid, decided), "reviews")
    return reconcile.run_controls(paid, domain.outbox(spark, d), decided, delivered, queue, _at(domain.CUTOFF), domain.EXPECTED_STATUS)


def reconciliation_report(spark: SparkSession, d: str) -> DataFrame:
    return _controls(spark, d).orderBy(*reconcile.COLUMNS)


def reconciliation_counts(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.count_by_code(_controls(spark, d))


def reported_exceptions_by_code(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.count_by_code(table(spark, d, "reconciliation_exceptions"))


def outbox_cardinality(spark: SparkSession, d: str) -> DataFrame:
    """Payments that don't have exactly one outbox event."""
    sent = domain.outbox(spark, d).groupBy("payment_id").agg(F.count("*").alias("n"))
    joined = domain.payments(spark, d, "status").select("payment_id").join(sent, "payment_id", "left")
    return joined.select("payment_id", F.coalesce("n", F.lit(0)).alias("n_events")).filter("n_events <> 1")


def exception_context(spark: SparkSession, d: str) -> DataFrame:
    """Reported exceptions about decisions, joined on the payment only where their code says so."""
    reported = table(spark, d, "reconciliation_exceptions").withColumn("payment_id", clean_id("payment_id")).alias("x")
    paid = domain.payments(spark, d, "status").alias("p")
    on = (F.col("x.payment_id") == F.col("p.payment_id")) & F.col("x.code").like("%DECISION%")
    return reported.join(paid, on).select("exception_id", "code", "x.payment_id", "status")


# --- delays, histograms, evaluation -----------------------------------------------------------------------------------


def _delays(spark: SparkSession, d: str) -> DataFrame:
    sent = domain.outbox(spark, d).filter(F.col("published_at").isNotNull()).groupBy("payment_id").agg(F.min("published_at").alias("published_at"))
    decided = domain.decisions(spark, d, "payment_id", "ingested_at").groupBy("payment_id").agg(F.min("ingested_at").alias("decided_at"))
    joined = domain.payments(spark, d, "created_at", "country").join(sent, "payment_id").join(decided, "payment_id")
    ms = lambda a: ((F.unix_micros(a) - F.unix_micros("created_at")) / F.lit(1000.0))
    return joined.select("country", ms("published_at").alias("publish_ms"), ms("decided_at").alias("decision_ms"))


def _delay_percentiles(spark: SparkSession, d: str, value: str) -> DataFrame:
    found = evaluate.exact_percentiles(_delays(spark, d), "country", value, (0.5, 0.95, 0.99))
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c.endswith("_cont")})


def delay_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _delay_percentiles(spark, d, "publish_ms")


def decision_delay_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _delay_percentiles(spark, d, "decision_ms")


def delay_histogram(spark: SparkSession, d: str) -> DataFrame:
    timed = _delays(spark, d).select("country", (F.col("decision_ms") / 1000.0).alias("s"))
    return evaluate.cumulative_histogram(timed, "s", (0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 30, 60, 300), "country")


def stream_counters(spark: SparkSession, d: str) -> DataFrame:
    """What became of the records by stream and topic: accepted, repeated or rejected. Counted per event before topics are."""
    parts = []
    for name in domain.TOPICS:
        rows = domain.checked(spark, d, name).select("source_topic", (F.col("errors") != "").alias("bad"), clean_id("event_id").alias("event_id"), "delivery_id")
        per_event = rows.filter("NOT bad").groupBy("event_id", "source_topic").agg(F.count("*").alias("n"), F.min("delivery_id").alias("first"))
        # an event may come by several topics; it is accepted where it came first
        firsts = per_event.groupBy("event_id").agg(F.min("first").alias("accepted"))
        split = per_event.join(firsts, "event_id").select("source_topic", F.when(F.col("first") == F.col("accepted"), 1).otherwise(0).alias("accepted"), "n")
        counts = split.groupBy("source_topic").agg(F.sum("accepted").alias("accepted"), F.sum(F.col("n") - F.col("accepted")).alias("repeated"))
        rejected = rows.filter("bad").groupBy("source_topic").agg(F.count("*").alias("rejected"))
        cells = counts.select("source_topic", F.inline(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("n")) for o in ("accepted", "repeated")])))
        parts += [df.select(F.lit(name).alias("stream_table"), "source_topic", "outcome", "n") for df in (cells, rejected.select("source_topic", F.lit("rejected").alias("outcome"), F.col("rejected").alias("n")))]
    return reduce(DataFrame.unionByName, parts).filter("n > 0")


def load_summary(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "payment_events")
    seconds = (F.unix_micros(F.max("ingested_at")) - F.unix_micros(F.min("ingested_at"))) / F.lit(1e6)
    wait = F.unix_millis("ingested_at") - F.unix_millis("kafka_timestamp")
    return df.agg(
        F.count("*").alias("n_requests"), F.count_distinct(clean_id("payment_id")).alias("n_payments"), F.count_if(F.col("status") == "PENDING_RISK").alias("n_accepted"), F.count_if(~F.col("status").eqNullSafe("PENDING_RISK")).alias("n_other"),
        F.when(seconds > 0, F.count("*") / seconds).alias("per_second"), F.avg(wait).alias("wait_ms_avg"), F.min("amount_minor").alias("least"), F.max("amount_minor").alias("greatest"),
    )


def score_confusion(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.confusion(domain.labelled(spark, d), 0.05)


def score_ranking(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.ranking(domain.labelled(spark, d))
    return found.select(*[F.round(c, 9).alias(c) for c in found.columns])


def threshold_costs(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.costs(domain.labelled(spark, d), 500, 25)


def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.best_threshold(domain.labelled(spark, d), 500, 25)


def positive_rate(spark: SparkSession, d: str) -> DataFrame:
    return domain.labelled(spark, d).agg(F.count("*").alias("n"), F.avg("label").alias("positive_rate"))


# --- features, ids, requests ------------------------------------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.unique_events(spark, d, "payment_events", "customer_id", "payment_id", "device_id", "country", "occurred_at", "delivery_id")
    return rows.select("customer_id", clean_id("payment_id").alias("payment_id"), "device_id", "country", F.unix_millis("occurred_at").alias("ms"), F.col("delivery_id").alias("seq"))


def customer_features(spark: SparkSession, d: str) -> DataFrame:
    return features.features(materialize(_events(spark, d), "feature-events"))


def customer_features_hourly(spark: SparkSession, d: str) -> DataFrame:
    """The same over a window of an hour and an expiry of a day, where both have more to do."""
    return features.features(materialize(_events(spark, d), "feature-events"), window_ms=3_600_000, ttl_s=86_400)


def _requests(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "payments").select(clean_id("id").alias("payment_id"), X.request_key("idempotency_key").alias("request"), "request_fingerprint", "loaded_at", "status")
    return changes.create(rows, "request", "request_fingerprint", ["loaded_at", "status", "payment_id"])


def created_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every request with what became of it: created, a replay, or in conflict with the one that made the key."""
    return portable(_requests(spark, d))


def request_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


def request_violations(spark: SparkSession, d: str) -> DataFrame:
    """(payment_id, loaded_at, field, message) of normalized requests that break a rule."""
    rows = table(spark, d, "payments").select(
        clean_id("id").alias("payment_id"), "loaded_at", *[X.trim_white(c).alias(c) for c in ("customer_id", "merchant_id", "device_id")], "amount_minor", X.code("currency").alias("currency"), X.code("country").alias("country")
    )
    return portable(rows.select("payment_id", "loaded_at", F.explode(changes.request_errors()).alias("field", "message")))


def canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    """How the ids of payments are spelled: as version 4, as another UUID, or not as one."""
    kind = F.when(X.is_uuid4(X.trim_white("id")), "version 4").when(X.canonical_uuid("id").isNotNull(), "other").otherwise("none")
    return table(spark, d, "payments").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct(X.canonical_uuid("id")).alias("n_ids"))


def _decision_fields() -> dict[str, Column]:
    """The normalized fields of a decision event, in a form that is the same everywhere."""
    exact = lambda c: F.col(c).cast("decimal(20,9)")
    ids = {c: clean_id(c) for c in ("event_id", "aggregate_id", "trace_id", "decision_id", "payment_id", "source_event_id")}
    whole = {c: F.col(c) for c in ("schema_version", "risk_score", "rule_score", "model_score", "velocity_5m", "new_device", "cross_border")}
    texts = {c: F.trim(c) for c in ("event_type", "decision", "rule_version", "model_version", "baseline_country")}
    times = {c: F.unix_micros(c) for c in ("occurred_at", "decision_at")}
    shares = {c: F.when(~F.isnan(c), exact(c)) for c in ("model_probability", "model_review_threshold")}
    return ids | whole | texts | times | shares | {"reason_codes": F.array_join(F.transform("reason_codes", F.trim), "|")}


def event_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Digests of normalized decision events: spelling of ids and blanks make no difference."""
    return domain.valid(spark, d, "decision_events").select("delivery_id", hashing.fingerprint(_decision_fields()).alias("fingerprint"))


def _applied(spark: SparkSession, d: str) -> DataFrame:
    """The log of decision deliveries applied to the payments, as if none had been decided before."""
    rows = domain.checked(spark, d, "decision_events")
    record = F.concat_ws("|", "source_topic", F.col("source_partition").cast("string"), F.col("source_offset").cast("string"), F.col("leader_epoch").cast("string"))
    ids = {c: clean_id(c) for c in ("decision_id", "payment_id", "source_event_id")}
    mark = hashing.fingerprint(_decision_fields())
    log = rows.select("delivery_id", record.alias("record"), mark.alias("digest"), (F.col("errors") == "").alias("is_valid"), *[v.alias(c) for c, v in ids.items()], mark.alias("fingerprint"))
    paid = domain.payments(spark, d, "created_at").select("payment_id", F.lit("PENDING_RISK").alias("status"))
    return changes.apply_decisions(log, paid)


def decisions_applied(spark: SparkSession, d: str) -> DataFrame:
    return _applied(spark, d)


def _applied_rows(spark: SparkSession, d: str) -> DataFrame:
    done = _applied(spark, d).filter(F.col("disposition") == changes.APPLIED).select("delivery_id", "decision_id", "payment_id")
    return done.join(table(spark, d, "decision_events").select("delivery_id", "decision", "decision_at"), "delivery_id")


def audit_log(spark: SparkSession, d: str) -> DataFrame:
    return portable(changes.audit_events(_applied_rows(spark, d)))


def _commands(spark: SparkSession, d: str) -> DataFrame:
    """A log of review commands, made of the reported exceptions: every other one approves or rejects, some at a stale version."""
    third, half = F.pmod("exception_id", F.lit(3)), F.pmod("exception_id", F.lit(2))
    action = F.when(F.col("code").isNull(), "ESCALATE").when(half == 0, "APPROVE").otherwise("REJECT")
    return table(spark, d, "reconciliation_exceptions").select("exception_id", clean_id("payment_id").alias("payment_id"), "reported_at", action.alias("action"), F.when(third == 0, 2).otherwise(1).alias("expected_version"))


def reviews_resolved(spark: SparkSession, d: str) -> DataFrame:
    """The commands against the reviews that applied decisions made; payments are as the last snapshot has them."""
    queue = changes.review_entries(_applied_rows(spark, d))
    return portable(changes.resolve(queue, domain.payments(spark, d, "status"), _commands(spark, d), ["reported_at", "exception_id"]))


def outbox_drained(spark: SparkSession, d: str) -> DataFrame:
    """One attempt for each due event; an event that failed before fails the same way again."""
    rows = changes.drain(table(spark, d, "outbox_events"), _at(domain.AS_OF), F.col("last_error"), ["payments.created"])
    return portable(rows.select("id", "outcome", "published_at", "dead_lettered_at", "last_attempt_at", "next_attempt_at", "delivery_attempts", "last_error"))


def outbox_envelope_errors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "outbox_events").select("id", changes.envelope_error().alias("error"), F.get_json_object("payload", "$.amount_minor").alias("amount_text"))
    return rows.groupBy(F.coalesce("error", F.lit("none")).alias("error"), F.col("amount_text").isNull().alias("without_amount")).agg(F.count("*").alias("n"))


def forbidden_changes(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of the first deliveries that their last deliveries have changed."""
    rows = domain.valid(spark, d, "decision_events").withColumns({"decision_id": clean_id("decision_id"), "payment_id": clean_id("payment_id")})
    columns = ["decision_id", "payment_id", "decision", "risk_score", "rule_version"]
    first, last = snapshot.oldest_by(rows, "decision_id", ["delivery_id"], columns), snapshot.newest_by(rows, "decision_id", ["delivery_id"], columns)
    return changes.forbidden_changes(first, last, "decision_id", columns[1:])


def snapshot_contract(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the read model as it would be served; no rows if nothing is."""
    outbox, delivered = domain.outbox(spark, d), materialize(domain.deliveries(spark, d), "deliveries")
    parts = {
        "payments": snapshot.summary(domain.payments(spark, d, "status", "amount_minor"), "status", ["PENDING_RISK", "ALLOWED", "REVIEW", "BLOCKED", "FAILED"], "amount_minor"),
        "decisions": snapshot.decision_summary(domain.decisions(spark, d, "decision", "risk_score")), "processing": snapshot.processing(outbox, delivered),
    }
    return snapshot.contract_problems(snapshot.as_json(parts))


def request_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.payments(spark, d, "customer_id", "merchant_id", "device_id", "amount_minor", "currency", "country")
    fields = {"customer_id": F.trim("customer_id"), "merchant_id": F.trim("merchant_id"), "device_id": F.trim("device_id"), "amount_minor": F.col("amount_minor"), "currency": X.code("currency"), "country": X.code("country")}
    return rows.select("payment_id", hashing.fingerprint({"fingerprint_version": F.lit(1)} | fields).alias("fingerprint"))


def deterministic_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = domain.unique_events(spark, d, "payment_events", "delivery_id").select("event_id", hashing.uuid5(F.concat_ws(":", F.lit("decision"), F.lit("model-v2"), "event_id")).alias("id"))
    return rows


def coordinate_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Broker coordinates under which different messages were delivered."""
    digest = F.sha2(F.concat_ws("|", clean_id("event_id"), clean_id("payment_id"), F.col("decision"), F.col("risk_score").cast("string")), 256)
    rows = table(spark, d, "decision_events").groupBy("source_topic", "source_partition", "source_offset", "leader_epoch").agg(F.count_distinct(digest).alias("n_digests"))
    return rows.filter("n_digests > 1")


def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    """Milliseconds to the next attempt: doubling from 100 to 5,000, the exponent capped before the power is taken."""
    rows = table(spark, d, "outbox_events").filter("delivery_attempts > 0").groupBy("delivery_attempts").agg(F.count("*").alias("n"))
    return rows.select("delivery_attempts", "n", changes.backoff_ms(F.col("delivery_attempts")).alias("wait_ms"))


def outbox_payloads(spark: SparkSession, d: str) -> DataFrame:
    """JSON accessors: currency and amount of the payload, and whether its keys are the expected ones."""
    rows = table(spark, d, "outbox_events")
    get = lambda p: F.get_json_object("payload", f"$.{p}")
    bad = F.coalesce(X.json_keys_differ("payload", ["amount_minor", "currency", "country"]), F.lit(True))
    return rows.groupBy(get("currency").alias("currency")).agg(F.count("*").alias("n"), F.sum(get("amount_minor").cast("bigint")).alias("amount_minor_sum"), F.count_if(bad).alias("n_other_keys"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        lake_payments, lake_decisions, lake_quarantine, decision_violations, payment_violations, violation_histogram, first_violations, decision_errors, stream_counts, metrics_daily, metrics_merged,
        metrics_inspection, payments_current, payment_summary, decision_summary, processing_summary, operational_gauges, recent_decisions,
        latest_versions, pending_reviews, next_due_events, attention_count, newest_decision, decisions_by_day, dispositions, outcome_shares,
        reconciliation_report, reconciliation_counts, reported_exceptions_by_code, outbox_cardinality, exception_context, delay_percentiles,
        decision_delay_percentiles, delay_histogram, stream_counters, load_summary, score_confusion, score_ranking, threshold_costs, best_threshold, positive_rate,
        customer_features, customer_features_hourly, created_requests, request_outcomes, request_violations, canonical_ids, event_fingerprints, decisions_applied, audit_log,
        reviews_resolved, outbox_drained, outbox_envelope_errors, forbidden_changes, snapshot_contract, request_fingerprints, deterministic_ids, coordinate_conflicts, retry_backoff, outbox_payloads,
    )
}

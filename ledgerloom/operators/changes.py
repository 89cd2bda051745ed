"""Changes of stored state as batch operators over logs: create, apply, resolve, drain, and checks of what may change.

A service makes such changes one transaction at a time; here a whole log is decided at once, with the same results as if
its entries had been taken in order. Where an entry depends only on the first one of its key, that is a partial
minimum and a join. Where it depends on which earlier entries succeeded (``apply_decisions``), entries that are first
for all their keys succeed together, what they exclude drops out, and the rest is decided in the next round.

Defined results: nulls in keys are no keys; ties in the order can't be told apart and must not occur; empty logs change
nothing; other columns are carried through or ignored as said.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.session import materialize

#: Dispositions and codes of rejections.
APPLIED, REPLAYED, REJECTED, CONFLICTING = "APPLIED", "REPLAYED", "REJECTED", "CONFLICT"
INVALID_EVENT, NO_PAYMENT, DECISION_CONFLICT, STATE_CONFLICT, RECORD_CONFLICT = "invalid_event", "payment_not_found", "decision_conflict", "payment_state_conflict", "source_record_conflict"
#: What an action makes of a review and of its payment, and the name of its audit event.
ACTIONS = {"APPROVE": ("APPROVED", "ALLOWED", "MANUAL_REVIEW_APPROVED"), "REJECT": ("REJECTED", "BLOCKED", "MANUAL_REVIEW_REJECTED")}
#: Milliseconds of the first and the longest wait between attempts, and the longest error text.
FIRST_WAIT_MS, LONGEST_WAIT_MS, ERROR_CHARACTERS = 100, 5_000, 2_000

#: What is said of a request's fields.
MISSING, TOO_LONG, NOT_POSITIVE, NO_CURRENCY, NO_COUNTRY = "is required", "must be at most 255 characters", "must be greater than zero", "must be a three-letter currency code", "must be a two-letter country code"
#: What is said of an outbox event, in this order.
ENVELOPE_MESSAGES = {
    "id": "event_id is required", "event_type": "event_type is required", "aggregate_id": "aggregate_id is required", "schema_version": "schema_version must be positive",
    "occurred_at": "occurred_at is required", "trace_id": "trace_id is required", "payload": "payload must be a JSON object",
}


def create(requests: DataFrame, key: str, fingerprint: str, order: Sequence[str], known: DataFrame | None = None) -> DataFrame:
    """``requests`` with ``outcome`` and ``made_by``: the first of a key is CREATED, an equal later one REPLAYED, another CONFLICT.

    ``known`` (key, fingerprint) were created before. ``made_by`` is the fingerprint that the key stands for. Requests
    without a key are INVALID.
    """
    place = F.struct(*order)
    first = requests.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(place).alias("_place"), F.min_by(fingerprint, place).alias("_made"))
    joined = requests.join(first, key, "left")
    if known is None:
        made, new = F.col("_made"), F.col("_place") == place
    else:
        # repeated entries of ``known`` don't multiply the requests
        stored = known.groupBy(F.col(key)).agg(F.min(fingerprint).alias("_stored"), F.lit(True).alias("_is_stored"))
        joined = joined.join(stored, key, "left")
        made, new = F.when(F.col("_is_stored"), F.col("_stored")).otherwise(F.col("_made")), F.col("_is_stored").isNull() & (F.col("_place") == place)
    outcome = F.when(F.col(key).isNull(), "INVALID").when(new, "CREATED").when(F.col(fingerprint).eqNullSafe(made), "REPLAYED").otherwise("CONFLICT")
    return joined.select(*requests.columns, outcome.alias("outcome"), made.alias("made_by"))


def _first_of(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.groupBy(by).agg(F.min(order).alias(f"_first_{by}"))


def matched(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The rows that are taken if rows are taken in order, each unless one of its keys was taken before.

    ``rows`` has the keys and the order only, none null. A round takes every row that is first for all its keys, so the
    rounds are as many as the longest chain of rows that wait for each other, and each leaves less.
    """
    left, taken = materialize(rows.groupBy(*keys).agg(F.min(order).alias(order)), "waiting"), []
    while left.limit(1).count():
        ranked = reduce(lambda df, k: df.join(_first_of(left, k, order), k), keys, left)
        won = materialize(ranked.filter(reduce(lambda a, b: a & b, [F.col(f"_first_{k}") == F.col(order) for k in keys])).select(*keys, order), "taken")
        taken.append(won)
        left = materialize(reduce(lambda df, k: df.join(won.select(k), k, "left_anti"), keys, left), "waiting")
    return reduce(DataFrame.unionByName, taken) if taken else left


def apply_decisions(deliveries: DataFrame, payments: DataFrame, waiting: str = "PENDING_RISK", order: str = "delivery_id") -> DataFrame:
    """(order, decision_id, payment_id, disposition, error_code) of every delivery, checked in this sequence.

    The record's coordinates were seen (same digest: REPLAYED, or CONFLICT if the first was rejected; other digest:
    CONFLICT); the event is invalid; its payment doesn't exist; its decision is stored (same fingerprint: REPLAYED, else
    rejected); its source event belongs to another decision; the payment isn't waiting any more; else it is APPLIED.
    ``deliveries``: order, record (text of the coordinates), digest, is_valid, decision_id, payment_id, source_event_id,
    fingerprint. ``payments``: payment_id, status before the log.
    """
    ids = ["decision_id", "payment_id", "source_event_id"]
    rows = deliveries.select(order, "record", "digest", F.coalesce("is_valid", F.lit(False)).alias("is_valid"), *ids, "fingerprint")
    receipts = rows.groupBy("record").agg(F.min(order).alias("_receipt"), F.min_by("digest", order).alias("_digest"))
    rows = materialize(rows.join(receipts, "record").join(payments.select("payment_id", F.col("status").alias("_status")), "payment_id", "left"), "deliveries")
    fresh = F.col("_receipt") == F.col(order)
    ready = rows.filter(fresh & F.col("is_valid") & (F.col("_status") == waiting)).select(*ids, order).dropna()
    won = materialize(matched(ready, ids, order).join(rows.select(order, "fingerprint"), order), "applied")

    def seen(df: DataFrame, by: str, *more: Column) -> DataFrame:
        return df.join(won.select(by, F.col(order).alias(f"_at_{by}"), *more), by, "left")

    # each id is applied at most once, so these joins add no rows
    judged = seen(seen(seen(rows, "decision_id", F.col("fingerprint").alias("_stored")), "source_event_id"), "payment_id")
    before = lambda by: F.coalesce(F.col(f"_at_{by}") < F.col(order), F.lit(False))
    code = (
        F.when(~F.col("is_valid"), INVALID_EVENT).when(F.col("_status").isNull(), NO_PAYMENT)
        .when(before("decision_id"), F.when(F.col("_stored") == F.col("fingerprint"), "").otherwise(DECISION_CONFLICT))
        .when(before("source_event_id"), DECISION_CONFLICT).when((F.col("_status") != waiting) | before("payment_id"), STATE_CONFLICT).otherwise("")
    )
    own = judged.withColumn("_code", code).withColumn("_is_replay", before("decision_id") & (F.col("_code") == ""))
    firsts = own.filter(fresh).select("record", (F.col("_code") != "").alias("_first_rejected"))
    full = own.join(firsts, "record")
    again = F.when((F.col("digest") == F.col("_digest")) & ~F.col("_first_rejected"), REPLAYED).otherwise(CONFLICTING)
    disposition = F.when(~fresh, again).when(F.col("_code") != "", REJECTED).when(F.col("_is_replay"), REPLAYED).otherwise(APPLIED)
    found = full.withColumn("disposition", disposition)
    error = F.when(F.col("disposition") == CONFLICTING, RECORD_CONFLICT).when(F.col("disposition") == REJECTED, F.col("_code")).otherwise("")
    return found.select(order, "decision_id", "payment_id", "disposition", error.alias("error_code"))


def audit_events(applied: DataFrame) -> DataFrame:
    """One audit entry per applied decision: (audit_id, payment_id, event_type, actor_type, occurred_at)."""
    return applied.select(F.col("decision_id").alias("audit_id"), "payment_id", F.lit("RISK_DECISION_RECORDED").alias("event_type"), F.lit("SYSTEM").alias("actor_type"), F.col("decision_at").alias("occurred_at"))


def review_entries(applied: DataFrame) -> DataFrame:
    """The review list that applied decisions make: (payment_id, decision_id, enqueued_at, status, version)."""
    return applied.filter(F.col("decision") == "REVIEW").select("payment_id", "decision_id", F.col("decision_at").alias("enqueued_at"), F.lit("PENDING").alias("status"), F.lit(1).alias("version"))


def resolve(reviews: DataFrame, payments: DataFrame, commands: DataFrame, order: Sequence[str]) -> DataFrame:
    """``commands`` (payment_id, action, expected_version) with ``outcome``, ``review_status``, ``payment_status``, ``version``, ``audit_type``.

    A command succeeds if its review is pending at the expected version and its payment is in review; then the review is
    closed, so of a payment's commands at most one succeeds. The others: UNSUPPORTED_ACTION, NOT_FOUND, VERSION_CONFLICT,
    ALREADY_RESOLVED, STATE_CONFLICT. ``reviews``: payment_id, status, version; ``payments``: payment_id, status.
    """
    place = F.struct(*order)
    known = commands.join(reviews.select("payment_id", F.col("status").alias("_review"), F.col("version").alias("_version")), "payment_id", "left")
    known = known.join(payments.select("payment_id", F.col("status").alias("_payment")), "payment_id", "left")
    current = (F.col("_review") == "PENDING") & (F.col("_version") == F.col("expected_version"))
    able = F.coalesce(F.col("action").isin(*ACTIONS) & current & (F.col("_payment") == "REVIEW"), F.lit(False))
    first = known.filter(able).groupBy("payment_id").agg(F.min(place).alias("_winner"))
    joined = known.join(first, "payment_id", "left")
    closed = (F.col("_review") != "PENDING") | F.coalesce(F.col("_winner") < place, F.lit(False))
    outcome = (
        F.when(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False)), "UNSUPPORTED_ACTION").when(F.col("_review").isNull(), "NOT_FOUND")
        .when(F.coalesce(F.col("_winner") == place, F.lit(False)), "RESOLVED").when(closed, "ALREADY_RESOLVED").when(~F.coalesce(current, F.lit(False)), "VERSION_CONFLICT").otherwise("STATE_CONFLICT")
    )
    done = joined.withColumn("outcome", outcome)
    of_action = lambda k: F.when(F.col("outcome") == "RESOLVED", F.coalesce(*[F.when(F.col("action") == a, F.lit(v[k])) for a, v in ACTIONS.items()]))
    version = F.when(F.col("outcome") == "RESOLVED", F.col("_version") + 1)
    return done.select(*commands.columns, "outcome", of_action(0).alias("review_status"), of_action(1).alias("payment_status"), version.alias("version"), of_action(2).alias("audit_type"))


def backoff_ms(attempt: Column, first: int = FIRST_WAIT_MS, longest: int = LONGEST_WAIT_MS) -> Column:
    """Milliseconds to wait after an attempt: doubling up to the longest, the exponent capped before the power is taken."""
    doublings = F.greatest(F.lit(0), F.least(attempt - 1, F.lit(20)))
    return F.least(F.lit(longest), F.lit(first) * F.pow(F.lit(2.0), doublings)).cast("bigint")


def envelope_error(payload: str = "payload") -> Column:
    """The first thing wrong with an outbox event, or null."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    text = F.trim(F.coalesce(F.col(payload), F.lit("")))
    # as the only element of an array, so that nothing may follow the object
    only = F.concat(F.lit("["), F.col(payload), F.lit("]"))
    is_object = F.coalesce((F.json_array_length(only) == 1) & F.try_parse_json(only).isNotNull() & text.startswith("{"), F.lit(False))
    found = {c: blank(c) for c in ("id", "event_type", "aggregate_id", "trace_id")}
    found |= {"schema_version": F.coalesce(F.col("schema_version") < 1, F.lit(True)), "occurred_at": F.col("occurred_at").isNull(), "payload": ~is_object}
    return F.coalesce(*[F.when(found[c], F.lit(message)) for c, message in ENVELOPE_MESSAGES.items()])


def drain(outbox: DataFrame, now: Column, publish_error: Column, supported: Sequence[str]) -> DataFrame:
    """The due events of ``outbox`` after one attempt each, with ``outcome``: PUBLISHED, RETRY or DEAD_LETTERED.

    ``publish_error`` is what the broker answered, null for success. An event of an unsupported type or with a broken
    envelope is never sent and is dead-lettered at once; any other failure is retried after a growing wait.
    """
    due = outbox.filter(F.col("published_at").isNull() & F.col("dead_lettered_at").isNull() & (F.col("next_attempt_at") <= now))
    kind = F.when(~F.coalesce(F.col("event_type").isin(*supported), F.lit(False)), F.concat(F.lit("unsupported event type "), F.coalesce("event_type", F.lit("null"))))
    permanent = F.coalesce(envelope_error(), kind)
    tried = due.withColumns({"_permanent": permanent, "_error": F.coalesce(permanent, publish_error)})
    attempt = F.coalesce("delivery_attempts", F.lit(0)) + 1
    failed = F.col("_error").isNotNull()
    changed = {
        "outcome": F.when(F.col("_permanent").isNotNull(), "DEAD_LETTERED").when(failed, "RETRY").otherwise("PUBLISHED"),
        "published_at": F.when(~failed, now), "dead_lettered_at": F.when(F.col("_permanent").isNotNull(), now), "last_attempt_at": now, "delivery_attempts": attempt,
        "next_attempt_at": F.when(failed, F.timestamp_micros(F.unix_micros(now) + backoff_ms(attempt) * 1000)).otherwise(F.col("next_attempt_at")),
        "last_error": F.when(failed, X.cut("_error", ERROR_CHARACTERS)).otherwise(F.col("last_error")),
    }
    return tried.withColumns(changed).drop("_permanent", "_error")


def request_errors() -> Column:
    """Field names and messages of what is wrong with a request (already normalized), as a map; empty if nothing is."""
    def identifier(c: str) -> Column:
        value = F.coalesce(F.col(c), F.lit(""))
        return F.when(value == "", MISSING).when(F.length(value) > 255, TOO_LONG)

    found = {c: identifier(c) for c in ("customer_id", "merchant_id", "device_id")}
    found["amount_minor"] = F.when(F.coalesce(F.col("amount_minor") <= 0, F.lit(True)), NOT_POSITIVE)
    found["currency"] = F.when(~F.coalesce(F.col("currency").rlike(r"^[A-Z]{3}\z"), F.lit(False)), NO_CURRENCY)
    found["country"] = F.when(~F.coalesce(F.col("country").rlike(r"^[A-Z]{2}\z"), F.lit(False)), NO_COUNTRY)
    cells = F.array(*[F.struct(F.lit(name).alias("field"), message.alias("message")) for name, message in found.items()])
    return F.map_from_entries(F.filter(cells, lambda c: c["message"].isNotNull()))


def forbidden_changes(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change) of rows of an append-only table that are not as they were: UPDATE or DELETE. Keys are unique."""
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    old, new = before.select(key, digest.alias("_old")), after.select(key, digest.alias("_new"), F.lit(True).alias("_there"))
    joined = old.join(new, key, "left").filter(F.col("_there").isNull() | (F.col("_old") != F.col("_new")))
    return joined.select(key, F.when(F.col("_there").isNull(), "DELETE").otherwise("UPDATE").alias("change"))

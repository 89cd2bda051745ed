"""Changes of stored state, against the same logs taken entry by entry."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerloom.commits import AlreadyCommitted
from ledgerloom.operators import changes, snapshot, validate
from ledgerloom.operators.versioned import Forbidden, VersionedTable
from ledgerloom.streaming.supervise import retrying

NOW = datetime(2026, 8, 30, 12, tzinfo=timezone.utc)


def test_requests(spark):
    schema = "k string, fp string, at int, outcome string"
    rows = [("a", "1", 1, "x"), ("a", "1", 2, "x"), ("a", "2", 3, "x"), ("b", None, 1, "x"), ("b", None, 2, "x"), ("b", "1", 3, "x"), (None, "1", 1, "x"), (None, "1", 2, "x"), ("c", "9", 1, "x")]
    frame = spark.createDataFrame(rows, schema).withColumnRenamed("outcome", "extra")
    found = sorted((r.k or "", r.at, r.outcome, r.made_by) for r in changes.create(frame, "k", "fp", ["at"]).collect())
    assert found == [("", 1, "INVALID", None), ("", 2, "INVALID", None), ("a", 1, "CREATED", "1"), ("a", 2, "REPLAYED", "1"), ("a", 3, "CONFLICT", "1"), ("b", 1, "CREATED", None), ("b", 2, "REPLAYED", None), ("b", 3, "CONFLICT", None), ("c", 1, "CREATED", "9")]
    known = spark.createDataFrame([("c", "8"), ("c", "8"), ("a", "1")], "k string, fp string")
    again = {(r.k, r.at): r.outcome for r in changes.create(frame, "k", "fp", ["at"], known).collect()}
    assert again["c", 1] == "CONFLICT" and again["a", 1] == again["a", 2] == "REPLAYED" and again["b", 1] == "CREATED" and len(again) == 9 - 0
    assert changes.create(frame.limit(0), "k", "fp", ["at"]).count() == 0


def one_by_one(log, status):
    """The log as a service takes it, in order."""
    receipts, decided, sources, status, out = {}, {}, {}, dict(status), {}
    for n, record, digest, good, decision, payment, source, mark in sorted(log):
        if record in receipts:
            first_digest, rejected = receipts[record]
            out[n] = ("REPLAYED", "") if digest == first_digest and not rejected else ("CONFLICT", "source_record_conflict")
            continue
        if not good:
            found = ("REJECTED", "invalid_event")
        elif payment not in status:
            found = ("REJECTED", "payment_not_found")
        elif decision in decided:
            found = ("REPLAYED", "") if decided[decision] == mark else ("REJECTED", "decision_conflict")
        elif source in sources:
            found = ("REJECTED", "decision_conflict")
        elif status[payment] != "PENDING_RISK":
            found = ("REJECTED", "payment_state_conflict")
        else:
            found = ("APPLIED", "")
            decided[decision], sources[source], status[payment] = mark, decision, "DONE"
        receipts[record] = (digest, found[0] == "REJECTED")
        out[n] = found
    return out


@pytest.mark.parametrize("seed", range(3))
def test_decisions_are_applied_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    status = {f"p{k}": rng.choice(["PENDING_RISK"] * 4 + ["ALLOWED"]) for k in range(12)}
    log = []
    for n in range(150):
        mark = f"m{rng.randrange(3)}"
        # chains: payments share source events, decisions wander between payments
        log.append((n, f"r{rng.randrange(110)}", mark, rng.random() < 0.9, f"d{rng.randrange(25)}", f"p{rng.randrange(14)}", f"s{rng.randrange(15)}", mark))
    frame = spark.createDataFrame(log, "delivery_id bigint, record string, digest string, is_valid boolean, decision_id string, payment_id string, source_event_id string, fingerprint string")
    payments = spark.createDataFrame(list(status.items()), "payment_id string, status string")
    found = {r.delivery_id: (r.disposition, r.error_code) for r in changes.apply_decisions(frame, payments).collect()}
    assert found == one_by_one(log, status)
    assert len({d for d, _ in found.values()}) == 4


def test_no_deliveries(spark):
    frame = spark.createDataFrame([], "delivery_id bigint, record string, digest string, is_valid boolean, decision_id string, payment_id string, source_event_id string, fingerprint string")
    assert changes.apply_decisions(frame, spark.createDataFrame([], "payment_id string, status string")).count() == 0


def test_reviews(spark):
    applied = spark.createDataFrame([("d1", "p1", "REVIEW", NOW), ("d2", "p2", "REVIEW", NOW), ("d3", "p3", "ALLOW", NOW), ("d4", "p4", "REVIEW", NOW)], "decision_id string, payment_id string, decision string, decision_at timestamp")
    queue = changes.review_entries(applied)
    assert queue.count() == 3 and {r.audit_id for r in changes.audit_events(applied).collect()} == {"d1", "d2", "d3", "d4"}
    payments = spark.createDataFrame([("p1", "REVIEW"), ("p2", "REVIEW"), ("p4", "BLOCKED")], "payment_id string, status string")
    log = [
        (1, "p1", "APPROVE", 2, "VERSION_CONFLICT"), (2, "p1", "APPROVE", 1, "RESOLVED"), (3, "p1", "REJECT", 1, "ALREADY_RESOLVED"), (4, "p1", "REJECT", 2, "ALREADY_RESOLVED"),
        (5, "p2", "REJECT", 1, "RESOLVED"), (6, "p3", "APPROVE", 1, "NOT_FOUND"), (7, None, "APPROVE", 1, "NOT_FOUND"), (8, "p4", "APPROVE", 1, "STATE_CONFLICT"), (9, "p2", "DELETE", 1, "UNSUPPORTED_ACTION"), (10, "p2", None, 1, "UNSUPPORTED_ACTION"),
    ]
    commands = spark.createDataFrame(log, "n int, payment_id string, action string, expected_version int, want string")
    found = changes.resolve(queue, payments, commands, ["n"]).collect()
    assert len(found) == len(log) and all(r.outcome == r.want for r in found)
    done = {r.n: (r.review_status, r.payment_status, r.version, r.audit_type) for r in found if r.outcome == "RESOLVED"}
    assert done == {2: ("APPROVED", "ALLOWED", 2, "MANUAL_REVIEW_APPROVED"), 5: ("REJECTED", "BLOCKED", 2, "MANUAL_REVIEW_REJECTED")}


OUTBOX = "id string, event_type string, aggregate_id string, schema_version int, occurred_at timestamp, trace_id string, payload string, published_at timestamp, dead_lettered_at timestamp, next_attempt_at timestamp, delivery_attempts int, last_error string, error string"


def event(name, **more):
    row = {"id": name, "event_type": "payments.created", "aggregate_id": "a", "schema_version": 1, "occurred_at": NOW, "trace_id": "t", "payload": "{}", "published_at": None, "dead_lettered_at": None, "next_attempt_at": NOW - timedelta(hours=1), "delivery_attempts": 0, "last_error": None, "error": None}
    return tuple((row | more).values())


def test_outbox(spark):
    rows = [
        event("sent"), event("again", delivery_attempts=3, error="x" * 3000), event("long", delivery_attempts=60, error="down"), event("odd", event_type="other", error="down"), event("broken", payload="[1]"), event("text", payload='{} {"a":1}'),
        event("later", next_attempt_at=NOW + timedelta(seconds=1)), event("done", published_at=NOW), event("dead", dead_lettered_at=NOW), event("now", next_attempt_at=NOW), event("none", payload=None), event("trace", trace_id=" "), event("zero", schema_version=0), event("untold", delivery_attempts=None),
    ]
    found = {r.id: r for r in changes.drain(spark.createDataFrame(rows, OUTBOX), F.lit(NOW), F.col("error"), ["payments.created"]).collect()}
    assert {k: r.outcome for k, r in found.items()} == {"sent": "PUBLISHED", "again": "RETRY", "long": "RETRY", "odd": "DEAD_LETTERED", "broken": "DEAD_LETTERED", "text": "DEAD_LETTERED", "now": "PUBLISHED", "none": "DEAD_LETTERED", "trace": "DEAD_LETTERED", "zero": "DEAD_LETTERED", "untold": "PUBLISHED"}
    plain = lambda t: t.replace(tzinfo=timezone.utc)
    assert plain(found["again"].next_attempt_at) == NOW + timedelta(milliseconds=800) and len(found["again"].last_error) == 2000 and found["again"].delivery_attempts == 4
    assert plain(found["long"].next_attempt_at) == NOW + timedelta(seconds=5) and found["sent"].delivery_attempts == 1 and plain(found["sent"].published_at) == NOW
    assert found["odd"].last_error == "unsupported event type other" and plain(found["odd"].dead_lettered_at) == NOW and found["odd"].published_at is None


def test_request_messages(spark):
    rows = [("c", "m", "d", 1, "USD", "IN"), ("", None, "d" * 256, 0, "usd", "IND"), ("é" * 255, "m", "d", None, "US1", None)]
    frame = spark.createDataFrame(rows, "customer_id string, merchant_id string, device_id string, amount_minor bigint, currency string, country string")
    found = [r.e for r in frame.select(changes.request_errors().alias("e")).collect()]
    assert found[0] == {} and set(found[1]) == {"customer_id", "merchant_id", "device_id", "amount_minor", "currency", "country"} and set(found[2]) == {"amount_minor", "currency", "country"}
    assert found[1]["merchant_id"] == "is required" and found[1]["device_id"] == "must be at most 255 characters"


def test_forbidden_changes(spark):
    before = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 2)], "k int, v string, w int")
    after = spark.createDataFrame([(1, "a", None), (2, "b", None), (4, "new", 1)], "k int, v string, w int")
    assert sorted((r.k, r.change) for r in changes.forbidden_changes(before, after, "k", ["v", "w"]).collect()) == [(2, "UPDATE"), (3, "DELETE")]


def test_snapshot_contract(spark):
    good = '{"payments":{"n_rows":1,"amount_minor_sum":5,"n_pending_risk":0,"n_allowed":1,"n_review":0,"n_blocked":0,"n_failed":0},"decisions":{"n_rows":0,"n_allow":0,"n_review":0,"n_block":0,"risk_score_avg":0.0},"processing":{"n_pending":0,"n_retrying":0,"n_dead_lettered":0,"n_rejected":0}}'
    bad = good.replace('"n_allowed":1', '"n_allowed":-1').replace('"risk_score_avg":0.0', '"risk_score_avg":null').replace('"n_pending":0,', "")
    frame = spark.createDataFrame([(good,), (bad,), ("{",), (None,)], "snapshot string")
    found = sorted(r.problem for r in snapshot.contract_problems(frame).collect())
    assert found == ["malformed_json", "malformed_json", "missing:processing.n_pending", "null:decisions.risk_score_avg", "out_of_range:payments.n_allowed"]


def test_retries():
    waits, tries = [], []

    def flaky(batch, batch_id):
        tries.append(batch_id)
        if len(tries) < 3:
            raise OSError("busy")

    retrying(flaky, attempts=4, sleep=waits.append)("batch", 7)
    assert tries == [7, 7, 7] and waits == [0.1, 0.2]
    with pytest.raises(ValueError):
        retrying(lambda *_: (_ for _ in ()).throw(ValueError("bad row")), attempts=4, sleep=waits.append)("batch", 1)
    with pytest.raises(OSError):
        retrying(lambda *_: (_ for _ in ()).throw(OSError("down")), attempts=2, sleep=waits.append)("batch", 1)


def rows_of(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_versioned_table(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "k")
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int, at int, gone boolean")
    assert table.read() is None
    table.upsert(frame([("a", 1, 1, None), ("a", 2, 2, None), ("b", 1, 1, None)]), ["at"])
    table.upsert(frame([("b", 9, 3, True), ("c", 5, 3, None), ("a", None, 3, False)]), ["at"], F.col("gone"))
    assert [r[:2] for r in rows_of(table)] == [("a", None), ("c", 5)] and table.version() == 2
    assert sorted(r.k for r in table.read(1).collect()) == ["a", "b"]
    table.upsert(frame([]), ["at"])
    assert [r[:2] for r in rows_of(table)] == [("a", None), ("c", 5)]
    with pytest.raises(Forbidden):
        table.upsert(frame([(None, 1, 1, None)]), ["at"])
    stale = VersionedTable(spark, f"file://{tmp_path}/t", "k")
    stale.version = lambda: 2
    with pytest.raises(AlreadyCommitted):
        stale.upsert(frame([("z", 1, 1, None)]), ["at"])
    assert [r[0] for r in rows_of(table)] == ["a", "c"]


def test_append_only_table(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t", "k", append_only=True)
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    table.upsert(frame([("a", 1), ("b", None)]), ["v"])
    table.upsert(frame([("a", 1), ("b", None), ("c", 3)]), ["v"])
    for bad, deleted in (([("a", 2)], None), ([("b", 0)], None), ([("c", 3)], F.lit(True))):
        with pytest.raises(Forbidden):
            table.upsert(frame(bad), ["v"], deleted)
    assert rows_of(table) == [("a", 1), ("b", None), ("c", 3)]


DECISION = "event_id string, aggregate_id string, trace_id string, decision_id string, payment_id string, source_event_id string, event_type string, schema_version int, occurred_at timestamp, decision_at timestamp, decision string, risk_score int, rule_score int, model_score int, model_probability double, model_review_threshold double, reason_codes array<string>, rule_version string, model_version string, velocity_5m int, baseline_country string"


def test_decision_errors_in_order(spark):
    u = "{}0000000-0000-4000-8000-000000000001".format
    good = {"event_id": u(1), "aggregate_id": u(2), "trace_id": u(3), "decision_id": u(1), "payment_id": u(2), "source_event_id": u(4), "event_type": " risk.decision.completed", "schema_version": 2, "occurred_at": NOW, "decision_at": NOW, "decision": "ALLOW", "risk_score": 1, "rule_score": 0, "model_score": 100, "model_probability": 0.5, "model_review_threshold": 0.5, "reason_codes": ["A_1"], "rule_version": "rules-v2", "model_version": "m", "velocity_5m": 1, "baseline_country": "IN"}
    cases = [({}, None), ({"trace_id": None, "event_type": "x"}, "trace_id: must be a UUID"), ({"decision_id": u(5), "risk_score": None}, "event_id must match payload.decision_id"), ({"decision_at": None, "occurred_at": None}, "decision timestamps are required"), ({"model_probability": float("nan"), "reason_codes": []}, "model_probability must be between 0 and 1"), ({"reason_codes": None}, "reason_codes must contain at least one value"), ({"reason_codes": ["A", None]}, "invalid reason_code"), ({"rule_version": " " * 3}, "rule_version must contain 1-255 characters"), ({"baseline_country": "in"}, "baseline_country must contain two uppercase letters")]
    rows = [tuple((good | change).values()) for change, _ in cases]
    found = spark.createDataFrame(rows, DECISION).coalesce(1).select(validate.decision_error().alias("e"), validate.decision_error("rules-v1").alias("w")).collect()
    assert [r.e for r in found] == [want for _, want in cases] and found[0].w == "rule_version must contain 1-255 characters"

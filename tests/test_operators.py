"""Curation, metrics, controls, read models, features and evaluation on small fixtures."""

from __future__ import annotations

import json
import random
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.profiles import DECISIONS_TOPIC, PAYMENTS_TOPIC, default_contracts, default_rows
from ledgerloom.operators import curate, evaluate, features, metrics, reconcile, snapshot
from ledgerloom.sources import models, synthetic
from ledgerloom.sources.records import RECORD_SCHEMA, jdbc_table, lookup, snapshot_or_empty
from ledgerloom.sources.settings import Settings
from ledgerloom.streaming import sinks

NOON = datetime(2026, 8, 30, 12, tzinfo=timezone.utc)
U = "{}0000000-0000-4000-8000-000000000001".format


def payment(**more):
    payload = {"payment_id": U(1), "customer_id": "customer-1", "merchant_id": " merchant-1 ", "device_id": "device-1", "amount_minor": 125000, "currency": "USD", "country": "IN", "status": "PENDING_RISK", "created_at": "2026-08-30T12:00:00Z"}
    event = {"event_id": U(5).upper(), "event_type": "payments.created", "aggregate_id": U(1), "schema_version": 1, "occurred_at": "2026-08-30T12:00:00Z", "trace_id": U(6), "payload": payload}
    payload.update(more.pop("payload", {}))
    return event | more


def decision(**more):
    features_ = {"velocity_5m": 2, "new_device": True, "cross_border": False, "baseline_country": "IN", "decision_at": "2026-08-30T12:00:01Z"}
    payload = {
        "decision_id": U(7), "payment_id": U(1), "source_event_id": U(5), "decision": "REVIEW", "risk_score": 55, "rule_score": 55, "model_score": 42, "model_probability": 0.42, "model_review_threshold": 0.4,
        "reason_codes": ["HIGH_AMOUNT", "NEW_DEVICE"], "rule_version": "rules-v1", "model_version": "m", "decision_at": "2026-08-30T12:00:01Z", "features": features_ | more.pop("features", {}),
    }
    payload.update(more.pop("payload", {}))
    return {"event_id": U(7), "event_type": "risk.decision.completed", "aggregate_id": U(1), "schema_version": 2, "occurred_at": "2026-08-30T12:00:01Z", "trace_id": U(6), "payload": payload} | more


def records(spark, *values):
    rows = [(topic, k % 3, k, NOON, v if v is None or isinstance(v, str) else json.dumps(v)) for k, (topic, v) in enumerate(values)]
    return spark.createDataFrame(rows, RECORD_SCHEMA)


def curated(spark, *values):
    return curate.curate(records(spark, *values).withColumn("e0", F.lit("another column")), default_contracts())


def test_the_default_contracts_are_those_of_the_table(spark, data):
    table = [r.asDict() for r in spark.read.parquet(f"{data}/contract_fields.parquet").collect()]
    short = lambda rows: sorted(str(tuple((k, None if r[k] is None else str(r[k]).replace(" ", "")) for k in sorted(r))) for r in rows)
    assert short(default_rows()) == short(table)


def test_curated_rows(spark):
    found = curated(spark, ("payments.created", payment()), ("risk.decisions", decision()))
    p, d = found.valid(PAYMENTS_TOPIC).first(), found.valid(DECISIONS_TOPIC).first()
    assert found.quarantine().count() == 0
    assert (p.event_id, p.merchant_id, p.amount_minor, p.event_date, p.source_offset) == (U(5), "merchant-1", 125000, date(2026, 8, 30), 0)
    assert (d.decision, d.reason_codes, d.velocity_5m, d.source_partition) == ("REVIEW", ["HIGH_AMOUNT", "NEW_DEVICE"], 2, 1)
    assert d.decision_at.second == 1 and len(found.valid(DECISIONS_TOPIC).columns) == 6 + 12 + 1 + 4 + 4 + 2
    assert curated(spark).valid(PAYMENTS_TOPIC).count() == 0


@pytest.mark.parametrize(
    ("topic", "value", "codes"),
    [
        ("payments.created", payment(schema_version=9, payload={"currency": "usd"}), ["invalid_schema_version", "invalid_currency"]),
        ("payments.created", payment(occurred_at="2026-08-30T12:00:00"), ["occurred_at_not_utc"]),
        ("payments.created", payment(aggregate_id=U(2)), ["aggregate_payment_mismatch"]),
        ("payments.created", payment(payload={"customer_id": None, "device_id": "  ", "amount_minor": 0}), ["invalid_customer_id", "invalid_device_id", "invalid_amount_minor"]),
        ("risk.decisions", decision(payload={"decision_id": "not-a-uuid"}), ["invalid_decision_id", "event_decision_mismatch"]),
        ("risk.decisions", decision(payload={"reason_codes": []}), ["missing_reason_codes"]),
        ("risk.decisions", decision(payload={"reason_codes": ["ok"]}), ["invalid_reason_code"]),
        ("risk.decisions", decision(payload={"risk_score": 101, "model_probability": 1.5, "model_review_threshold": 1}), ["invalid_risk_score", "invalid_model_probability", "invalid_model_threshold"]),
        ("risk.decisions", decision(occurred_at="2026-08-30T12:00:02Z"), ["occurred_decision_time_mismatch"]),
        ("risk.decisions", decision(features={"velocity_5m": 0, "decision_at": "2026-08-30T12:00:03Z"}), ["invalid_velocity_5m", "feature_decision_time_mismatch"]),
        ("unexpected.topic", {"value": "ignored"}, ["unsupported_topic"]),
        (None, payment(), ["unsupported_topic"]),
    ],
)
def test_quarantined_codes(spark, topic, value, codes):
    found = curated(spark, (topic, value))
    row = found.quarantine().first()
    assert row.error_codes == codes and row.event_date == date(2026, 8, 30) and row.raw_value
    assert found.valid(PAYMENTS_TOPIC).count() == found.valid(DECISIONS_TOPIC).count() == 0


@pytest.mark.parametrize("raw", ["{not-json", "", None, json.dumps(payment(occurred_at="yesterday"))])
def test_malformed(spark, raw):
    assert "malformed_json" in curated(spark, ("payments.created", raw)).quarantine().first().error_codes


def metric_frames(spark):
    at = lambda ms: NOON + timedelta(milliseconds=ms)
    p = spark.createDataFrame([("e1", NOON.date(), "merchant-1", "IN", 125000, "payments.created", NOON, at(250))], "event_id string, event_date date, merchant_id string, country string, amount_minor bigint, source_topic string, kafka_timestamp timestamp, ingested_at timestamp")
    d = spark.createDataFrame([("d1", NOON.date(), "REVIEW", 55, "risk.decisions", NOON, at(500)), ("d2", NOON.date(), "ALLOW", 20, "risk.decisions", NOON, at(700))], "event_id string, event_date date, decision string, risk_score int, source_topic string, kafka_timestamp timestamp, ingested_at timestamp")
    q = spark.createDataFrame([(NOON.date(), "risk.decisions", 0, 1, ["a", "b"])], "event_date date, source_topic string, source_partition int, source_offset bigint, error_codes array<string>")
    return p, d, q


def test_metric_families(spark):
    found = metrics.with_derived(metrics.daily_deltas(*metric_frames(spark))).collect()
    by = lambda family: [r for r in found if r.metric_family == family]
    assert {f: sum(r.event_count for r in by(f)) for f in {r.metric_family for r in found}} == {"decision_rate": 2, "ingestion_latency": 3, "payment_volume": 3, "quarantine_error": 2, "risk_score_distribution": 4}
    assert {r.dimension_value: r.latency_ms_sum for r in by("ingestion_latency")} == {"payments.created": 250, "risk.decisions": 1200}
    assert {r.outcome: (r.denominator_count, r.rate) for r in by("decision_rate")} == {"REVIEW": (2, 0.5), "ALLOW": (2, 0.5)}
    assert next(r.risk_score_avg for r in by("risk_score_distribution") if r.metric_bucket == "50-59" and r.dimension_type == "overall") == 55.0


def test_deltas_merge_to_the_whole(spark):
    rng = random.Random(4)
    rows = [(f"e{k}", date(2026, 1, 1 + k % 3), rng.choice(["m1", "m2", None]), rng.choice(["IN", None]), rng.randrange(100), "t", NOON, NOON) for k in range(200)]
    p, d, q = metric_frames(spark)
    whole = spark.createDataFrame(rows, p.schema)
    parts = [spark.createDataFrame(rows[a : a + 67], p.schema) for a in range(0, 200, 67)]
    merged = metrics.payment_volume(parts[0])
    for part in parts[1:]:
        merged = merged.unionByName(metrics.payment_volume(part))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, metrics.merge_deltas(merged).collect())) == sorted(map(key, metrics.payment_volume(whole).collect()))
    assert metrics.with_derived(metrics.daily_deltas(whole.limit(0), d.limit(0), q.limit(0))).count() == 0


def control_frames(spark):
    t = lambda m: NOON + timedelta(minutes=m)
    pay = spark.createDataFrame([("p1", "ALLOWED", t(0)), ("p2", "ALLOWED", t(0)), ("p3", "PENDING_RISK", t(0)), ("p4", "PENDING_RISK", t(9)), ("p5", "PENDING_RISK", t(0)), ("p6", "BLOCKED", t(0))], "payment_id string, status string, created_at timestamp")
    out = spark.createDataFrame([(p, "payments.created", None if p == "p5" else t(1), None, 0) for p in ("p1", "p2", "p3", "p4", "p5")] + [("p3", "payments.created", t(1), None, 0)], "payment_id string, event_type string, published_at timestamp, dead_lettered_at timestamp, delivery_attempts int")
    dec = spark.createDataFrame([("p1", "d1", "ALLOW"), ("p2", "d2", "REVIEW"), ("p6", "d6", "BLOCK"), ("p6", "d7", "BLOCK")], "payment_id string, decision_id string, decision string")
    got = spark.createDataFrame([("d1", "APPLIED", 0, None), ("d1", "REPLAYED", 1, None), ("d2", "APPLIED", 2, None), ("x", "REJECTED", 3, "invalid_event"), ("d6", "REJECTED", 4, "late")], "decision_id string, disposition string, source_offset bigint, error_code string").selectExpr("*", "'t' AS source_topic", "0 AS source_partition")
    rev = spark.createDataFrame([("p1", "d1", "PENDING")], "payment_id string, decision_id string, status string")
    return pay, out, dec, got, rev


def test_controls(spark):
    pay, out, dec, got, rev = control_frames(spark)
    expected = {"ALLOW": "ALLOWED", "REVIEW": "REVIEW", "BLOCK": "BLOCKED"}
    found = reconcile.run_controls(pay, out, dec, got, rev, F.lit(NOON + timedelta(minutes=5)), expected)
    assert sorted((r.code, r.payment_id, r.decision_id) for r in found.collect()) == [
        ("DUPLICATE_DECISION", "p6", ""), ("DUPLICATE_DELIVERY", "p1", "d1"), ("MISSING_DECISION", "p3", ""), ("PAYMENT_STATUS_MISMATCH", "p2", "d2"),
        ("REJECTED_DECISION_EVENT", "", ""), ("REJECTED_DECISION_EVENT", "", ""), ("REVIEW_QUEUE_MISSING", "p2", "d2"), ("UNEXPECTED_REVIEW_QUEUE", "p1", "d1"),
    ]
    assert {r.code: r.n for r in reconcile.count_by_code(found).collect()}["REJECTED_DECISION_EVENT"] == 2
    empty = [f.limit(0) for f in (pay, out, dec, got, rev)]
    assert reconcile.run_controls(*empty, F.lit(NOON), expected).count() == 0


def test_read_models(spark):
    pay, out, dec, got, rev = control_frames(spark)
    assert snapshot.processing(out, got).first().asDict() == {"n_pending": 1, "n_retrying": 0, "n_dead_lettered": 0, "n_rejected": 2}
    assert snapshot.processing(out.limit(0), got.limit(0)).first().asDict() == {"n_pending": 0, "n_retrying": 0, "n_dead_lettered": 0, "n_rejected": 0}
    assert snapshot.gauges(out, got, rev).first().n_reviews == 1
    assert snapshot.attention(snapshot.processing(out, got), rev, pay).first().n_attention == 1 + 0 + 2 + 6
    full = dec.selectExpr("*", "10 AS risk_score", "'r' AS rule_version", "concat('m', decision_id) AS model_version", "TIMESTAMP '2026-01-01' AS decision_at")
    assert snapshot.latest_versions(full).first().model_version == "md7" and snapshot.latest_versions(full.limit(0)).count() == 0
    assert snapshot.decision_summary(full.limit(0)).first().risk_score_avg == 0.0
    assert {r.payment_id: r.decision_id for r in snapshot.newest_by(full.select("payment_id", "decision_id", "decision_at"), "payment_id", ["decision_at", "decision_id"]).collect()}["p6"] == "d7"
    assert lookup(pay, "payment_id", "p3").first().status == "PENDING_RISK"
    assert snapshot_or_empty(spark, "file:///nowhere/at/all", "a int, b string").count() == 0


def simulate(events, window, ttl):
    """Event-time order, one customer's state at a time."""
    state, out = {}, {}
    for e in sorted((e for e in events if e["customer_id"] and e["ms"] is not None), key=lambda e: (e["ms"], e["seq"])):
        s = state.get(e["customer_id"])
        if s is None or e["ms"] - s["last"] > ttl:
            s = state[e["customer_id"]] = {"devices": set(), "home": e["country"], "seen": (s or {}).get("seen", [])}
        s["last"] = e["ms"]
        s["seen"].append(e)
        recent = {x["payment_id"] for x in s["seen"] if e["ms"] - window <= x["ms"] <= e["ms"]}
        fresh = e["device_id"] is not None and e["device_id"] not in s["devices"]
        s["devices"].add(e["device_id"])
        out[e["seq"]] = (len(recent), fresh, s["home"] != e["country"], s["home"])
    return out


def test_features_against_a_simulation(spark):
    rng = random.Random(3)
    hour = 3_600_000
    events = [
        {"customer_id": rng.choice(["hot", "hot", "c1", "c2", None]), "payment_id": f"p{rng.randrange(300)}", "device_id": rng.choice(["d1", "d2", "d3", None]), "country": rng.choice(["IN", "GB"]), "ms": rng.choice([None, rng.randrange(3 * hour), rng.randrange(90 * hour)]), "seq": k}
        for k in range(500)
    ]
    for k in range(40):
        events.append(events[k] | {"seq": 1000 + k})
    frame = spark.createDataFrame([tuple(e.values()) for e in events], "customer_id string, payment_id string, device_id string, country string, ms bigint, seq bigint")
    found = {r.seq: (r.velocity, r.new_device, r.cross_border, r.baseline_country) for r in features.features(frame, 300_000, 20 * 3600).collect()}
    assert found == simulate(events, 300_000, 20 * hour)
    assert features.features(frame.limit(0)).count() == 0


def test_evaluation(spark):
    scored = spark.createDataFrame([(0.1, 0), (0.9, 0), (0.2, 1), (0.8, 1)], "score double, label int")
    r = evaluate.confusion(scored, 0.5).first()
    assert (r.tn, r.fp, r.fn, r.tp, r.precision, r.recall, r.f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    assert evaluate.confusion(scored.limit(0), 0.5).first().f1 == 0.0
    costs = spark.createDataFrame([(0.01, 0), (0.2, 0), (0.4, 0), (0.3, 1), (0.8, 1)], "score double, label int")
    assert tuple(evaluate.best_threshold(costs, 100, 10).first()) == (21, 10)
    pairs = [(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.1, 0)]
    r = evaluate.ranking(spark.createDataFrame(pairs, "score double, label int")).first()
    auc = sum((a > b) + 0.5 * (a == b) for a, la in pairs for b, lb in pairs if la > lb) / 6
    assert abs(r.roc_auc - auc) < 1e-12 and abs(r.average_precision - (1 / 2 * 1 + 1 / 2 * 2 / 4)) < 1e-12
    assert tuple(evaluate.ranking(scored.limit(0)).first()) == (None, None)
    found = {(r.label, r.edge): r.n for r in evaluate.cumulative_histogram(scored, "score", (0.1, 0.5), "label").collect()}
    assert found == {(0, "0.1"): 1, (0, "0.5"): 1, (0, "+Inf"): 2, (1, "0.1"): 0, (1, "0.5"): 1, (1, "+Inf"): 2}
    assert {(r.label, r.n, r.percent) for r in evaluate.outcome_shares(costs, "label").collect()} == {(0, 3, 60), (1, 2, 40)}


def test_settings():
    env = {"KAFKA_BROKERS": "b:9092"}
    found = Settings.from_env(env)
    assert (found.trigger_interval, found.max_offsets_per_trigger, found.starting_offsets) == ("5 seconds", 10_000, "earliest")
    for bad in ({"KAFKA_BROKERS": ""}, {"PAYMENTS_TOPIC": "risk.decisions"}, {"SPARK_TRIGGER_INTERVAL": "0 seconds"}, {"SPARK_STARTING_OFFSETS": "middle"}, {"SPARK_MAX_OFFSETS_PER_TRIGGER": "x"}, {"SPARK_MAX_OFFSETS_PER_TRIGGER": "-1"}, {"SPARK_OUTPUT_ROOT": "here"}, {"SPARK_OUTPUT_ROOT": "/a/../b"}, {"KAFKA_BROKERS": "a b"}, {"SPARK_OUTPUT_ROOT": "/a/"}, {"SPARK_OUTPUT_ROOT": "/a", "SPARK_CHECKPOINT_ROOT": "/a"}):
        with pytest.raises(ValueError):
            Settings.from_env(env | bad)


def test_models(spark, tmp_path):
    made = synthetic.labelled_payments(spark, 4000, 7)
    assert made.select("id", "amount_minor", "label").exceptAll(synthetic.labelled_payments(spark, 4000, 7).select("id", "amount_minor", "label")).count() == 0
    r = made.agg(F.min("amount_minor").alias("a"), F.max("velocity_5m").alias("v"), F.avg("label").alias("y"), F.avg(F.col("new_device").cast("int")).alias("n")).first()
    assert r.a >= 300 and r.v <= 20 and 0.01 < r.y < 0.1 and 0.16 < r.n < 0.24
    with pytest.raises(ValueError):
        synthetic.labelled_payments(spark, 10)
    scored = models.closed_form()(made).select("score", (F.col("probability")).alias("p"), "label")
    assert evaluate.ranking(scored.withColumnRenamed("score", "s"), score="p").first().roc_auc > 0.65
    model = models.train(made, rounds=3)
    held_out = models.trained(model)(synthetic.labelled_payments(spark, 4000, 8))
    assert evaluate.ranking(held_out.drop("score"), score="probability").first().roc_auc > 0.6
    assert models.preprocess(made).first().features[2] in (0.0, 1.0)
    split = models.stratified_split(made)
    parts = {(r.part, r.label): r["count"] for r in split.groupBy("part", "label").count().collect()}
    for label in (0, 1):
        whole = sum(n for (_, of), n in parts.items() if of == label)
        assert all(abs(parts[part, label] - share * whole) <= 2 for part, share in enumerate((0.6, 0.2, 0.2)))


def test_built_models_and_their_gates(spark, tmp_path):
    built = models.build(spark, str(tmp_path), samples=3000, rounds=4)
    meta, artifact = tmp_path / "model.json", tmp_path / "model"
    assert models.load_metadata(str(meta), str(artifact)) == built and 0 < built.threshold < 1 and built.rounds <= 4
    assert built.report["test"]["tp"] + built.report["test"]["fn"] > 0 and sum(built.report["rows"].values()) == 3000
    good = json.loads(meta.read_text())
    for bad in ({"form": 2}, {"preprocessing": "other"}, {"features": []}, {"threshold": 1}, {"rounds": -1}, {"version": " "}, {"sha256": "0"}, {"unknown": 1}):
        meta.write_text(json.dumps(good | bad))
        with pytest.raises(models.Unavailable):
            models.load_metadata(str(meta), str(artifact))
    with pytest.raises(models.Unavailable):
        models.load_metadata(str(tmp_path / "none.json"), str(artifact))


def test_database_tables(spark, tmp_path):
    """Spark's own Derby, where its jar is there."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    try:
        spark.range(100).selectExpr("id AS k", "id % 7 AS v").write.format("jdbc").options(url=url, dbtable="t", **driver).save()
    except Exception as e:
        pytest.skip(str(e)[:80])
    found = jdbc_table(spark, url, "t", "k", (0, 100), 4, **driver)
    assert found.rdd.getNumPartitions() == 4 and found.count() == 100 and found.filter("v = 3").count() == 14


def test_messages_and_reports(spark, tmp_path):
    out = spark.createDataFrame([(U(5), U(1), "payments.created", 1, NOON, U(6), '{"amount_minor":5}')], "id string, aggregate_id string, event_type string, schema_version int, occurred_at timestamp, trace_id string, payload string")
    row = sinks.outbox_messages(out).first()
    assert row.key == U(1) and {h.key: bytes(h.value).decode() for h in row.headers} == {"event_id": U(5), "event_type": "payments.created", "schema_version": "1", "trace_id": U(6)}
    assert json.loads(row.value)["payload"] == {"amount_minor": "5"}
    bad = curated(spark, ("payments.created", "{not-json")).quarantine()
    first, second = sinks.rejection_messages(bad).first(), sinks.rejection_messages(bad).first()
    assert first.key == second.key and "not-json" not in first.value
    sinks.write_topic(sinks.rejection_messages(bad), f"file://{tmp_path}", "risk.invalid-events")
    assert spark.read.parquet(f"file://{tmp_path}/risk.invalid-events").count() == 1
    sinks.write_json(bad.select("source_topic"), f"file://{tmp_path}/report")
    assert json.loads(sinks.json_summary({"counts": bad.groupBy("source_topic").count()})) == {"counts": [{"count": 1, "source_topic": "payments.created"}]}
    with pytest.raises(ValueError):
        sinks.json_summary({"x": spark.range(5)}, 4)

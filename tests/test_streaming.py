"""Streams: restarts on one checkpoint, deduplication, late rows, keyed state, supervision."""

from __future__ import annotations

import json
import threading
from datetime import datetime, timedelta, timezone
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import lateness
from ledgerloom.sources.records import RECORD_SCHEMA, replayed_stream
from ledgerloom.streaming import hourly, inspect, lake, online, sinks
from ledgerloom.streaming.supervise import lag, supervise
from tests.test_operators import U, decision, payment

NOON = datetime(2026, 8, 30, 12, tzinfo=timezone.utc)


def append(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_table_sink_restarts(spark, tmp_path):
    schema, root = "event_id string, event_date date", f"file://{tmp_path}"
    for rows in ([("event-1", NOON.date())], [("event-2", NOON.date())], []):
        if rows:
            append(spark, f"{root}/in", rows, schema)
        sinks.start_table(replayed_stream(spark, f"{root}/in", schema), f"{root}/out", "events", f"{root}/c", ["event_date"], availableNow=True).awaitTermination()
    found = sinks.BatchLog(spark, f"{root}/out").read("events")
    assert sorted((r.event_id, r.event_date) for r in found.collect()) == [("event-1", NOON.date()), ("event-2", NOON.date())]
    assert list((tmp_path / "out" / "tables" / "events").glob("*/event_date=2026-08-30"))
    with pytest.raises(ValueError):
        sinks.start_table(replayed_stream(spark, f"{root}/in", schema), f"{root}/out", "events", f"{root}/c")


def test_readers_see_whole_batches_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "LIST_EVERY", 3)
    total = lambda f: f.groupBy("y").agg(F.sum("x").alias("x"))
    log = sinks.BatchLog(spark, f"file://{tmp_path}/m", {"sums": total})
    assert log.read("sums") is None
    rows = lambda k: spark.createDataFrame([(k, "a"), (10 * k, "b")], "x bigint, y string")
    for k in range(1, 9):
        log.write(k, {"sums": total(rows(k)), "rows": rows(k)}, {"rows": ["y"]})
        log.write(k, {"sums": total(rows(100)), "rows": rows(100)})  # the same batch again
        assert {r.y: r.x for r in log.read("sums").collect()} == {"a": k * (k + 1) // 2, "b": 5 * k * (k + 1)}
        assert log.read("rows").count() == 2 * k

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(log.log, "commit", dies)
        log.write(9, {"sums": total(rows(9)), "rows": rows(9)})
    assert log.read("rows").count() == 16
    log.write(9, {"sums": total(rows(9)).limit(0), "rows": rows(9).limit(0)}, {"rows": ["y"]})
    assert log.read("rows").count() == 16 and log.read("sums").count() == 2
    assert len(list((tmp_path / "m" / "tables" / "sums").iterdir())) < 10  # merged ones were removed


def test_lake_job(spark, tmp_path):
    root = f"file://{tmp_path}"
    value = lambda v: v if isinstance(v, str) else json.dumps(v)
    batches = [
        [("payments.created", payment()), ("payments.created", payment()), ("risk.decisions", decision()), ("payments.created", "{bad")],
        [("payments.created", payment()), ("payments.created", payment(event_id=U(8))), ("elsewhere", "x")],
    ]
    for k, batch in enumerate(batches):
        append(spark, f"{root}/in", [(t, 0, 10 * k + i, NOON, value(v)) for i, (t, v) in enumerate(batch)], RECORD_SCHEMA)
        for q in lake.start_lake(replayed_stream(spark, f"{root}/in"), f"{root}/out", f"{root}/check", availableNow=True):
            q.awaitTermination()
            assert q.exception() is None
    rows = {name: lake.read_table(spark, f"{root}/out", name).collect() for name in lake.LOGS}
    assert sorted(r.event_id for r in rows["payments"]) == [U(5), U(8)]
    assert len(rows["decisions"]) == 1 and len(rows["quarantine"]) == 2
    told = json.loads(inspect.summary(spark, f"{root}/out"))
    assert told["payments"] == [{"rows": 2, "distinct_event_id": 2, "distinct_payment_id": 1}] and {r["error_code"]: r["rows"] for r in told["quarantine"]}["unsupported_topic"] == 1
    assert json.loads(inspect.summary(spark, f"{root}/nothing")) == {}
    found = lake.read_deltas(spark, f"{root}/out").collect()
    assert {(r.dimension_type, r.dimension_value): (r.event_count, r.amount_minor_sum) for r in found if r.metric_family == "payment_volume"} == {("overall", "ALL"): (2, 250000), ("merchant", "merchant-1"): (2, 250000), ("country", "IN"): (2, 250000)}
    assert sum(r.event_count for r in found if r.metric_family == "quarantine_error" and r.metric_bucket == "unsupported_topic") == 1


def test_hourly_stream_gives_what_the_batch_gives(spark, tmp_path):
    root, schema = f"file://{tmp_path}", "delivery_id bigint, occurred_at timestamp, kafka_timestamp timestamp, amount bigint, source_topic string, source_partition int"
    rows = [(k, NOON + timedelta(minutes=37 * k % 900), NOON + timedelta(minutes=37 * k % 900 + (k % 11) ** 3), k, "t", k % 10 // 9) for k in range(200)]
    rows.sort(key=lambda r: r[2])  # as the broker delivers them
    assert hourly.read_hourly(spark, f"{root}/out") is None
    for part in (rows[:90], rows[90:150], rows[150:]):
        append(spark, f"{root}/in", part, schema)
        stream = lateness.stream_rows(replayed_stream(spark, f"{root}/in", schema), "s", "occurred_at", "amount")
        hourly.start_hourly(stream, f"{root}/out", f"{root}/c", availableNow=True).awaitTermination()
    batch = lateness.stream_rows(spark.createDataFrame(rows, schema), "s", "occurred_at", "amount")
    clocks = lateness.source_clocks(batch)
    closed = lateness.closings(clocks)
    marked = lateness.mark_diverted(batch, closed)
    want = lateness.hourly(lateness.hourly_deltas(marked), closed, clocks)
    key = lambda f: sorted(map(str, (tuple(r[c] for c in want.columns) for r in f.collect())))
    assert key(hourly.read_hourly(spark, f"{root}/out")) == key(want)
    late = hourly.hourly_log(spark, f"{root}/out").read("late").collect()
    assert sorted(r.delivery_id for r in late) == sorted(r.delivery_id for r in marked.filter("diverted").collect()) != []
    # some came while their hour still waited for the slow source: the exact check diverts them, not the closing
    assert 0 < sum(r.after_close for r in late) < len(late)


def simulate(events, window, ttl):
    state, out = {}, {}
    cache = {}
    for customer, event, paid, device, country, ms, _ in events:
        if (customer, event) not in cache:
            s = state.get(customer)
            if s is None or ms - s["last"] > ttl:
                s = state[customer] = {"recent": {}, "devices": set(), "home": country, "last": ms}
            s["last"] = max(s["last"], ms)
            s["recent"] = {p: t for p, t in s["recent"].items() if t >= ms - window} | {paid: ms}
            velocity = sum(ms - window <= t <= ms for t in s["recent"].values())
            cache[customer, event] = (velocity, device not in s["devices"], country != s["home"], s["home"])
            s["devices"].add(device)
        out.setdefault((customer, event), []).append(cache[customer, event])
    return out


@pytest.fixture
def one_partition(spark):
    """A state store per partition and state is written for every batch; one partition is enough here."""
    settings = {"spark.sql.shuffle.partitions": "1", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_online_features(spark, tmp_path, one_partition):
    import random

    rng = random.Random(1)
    root, schema = f"file://{tmp_path}", "customer_id string, event_id string, payment_id string, device_id string, country string, ms bigint, seq bigint"
    events = [("c1", "e1", "p1", "d1", "IN", 0, 0), ("c1", "e1", "p1", "d1", "IN", 20_000, 1), ("c1", "e2", "p2", "d1", "GB", 30_000, 2)]
    events += [(rng.choice(["c1", "c2", "c3"]), f"x{rng.randrange(80)}", f"p{rng.randrange(60)}", rng.choice("abc"), rng.choice(["IN", "GB"]), rng.randrange(1_500_000), 3 + k) for k in range(120)]
    day = 86_400_000
    # 20 days apart all is kept, 31 days apart all of the customer's state is gone, the home country too
    events += [("c4", f"y{k}", f"q{k}", "d1", country, ms, 200 + k) for k, (country, ms) in enumerate([("IN", 0), ("GB", 20 * day), ("GB", 45 * day), ("GB", 76 * day), ("IN", 77 * day)])]
    got = {}

    def collect(batch, _):
        for r in batch.collect():
            got.setdefault((r.customer_id, r.event_id), []).append((r.velocity, r.new_device, r.cross_border, r.baseline_country))

    for part in (events[:40], events[40:125], events[125:]):
        append(spark, f"{root}/in", part, schema)
        stream = online.online_features(replayed_stream(spark, f"{root}/in", schema))
        stream.writeStream.foreachBatch(collect).option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination()
    assert got == simulate(events, online.WINDOW_MS, online.TTL_MS)
    assert [got["c4", f"y{k}"][0] for k in range(5)] == [(1, True, False, "IN"), (1, False, True, "IN"), (1, False, True, "IN"), (1, True, False, "GB"), (1, False, True, "GB")]
    assert got[("c1", "e1")] == [(1, True, False, "IN")] * 2 and got[("c1", "e2")] == [(2, False, True, "IN")]


def test_the_first_answer_wins(spark, tmp_path, one_partition):
    root, schema, got = f"file://{tmp_path}", "cache_key string, answer string, seq bigint", {}
    for part in ([("a", "ALLOW", 2), ("a", "BLOCK", 1), ("b", "REVIEW", 3)], [("a", "ALLOW", 4), ("b", "BLOCK", 5), ("c", "ALLOW", 6)]):
        append(spark, f"{root}/in", part, schema)
        stream = online.cached_answers(replayed_stream(spark, f"{root}/in", schema))
        stream.writeStream.foreachBatch(lambda b, _: got.update({r.seq: (r.cache_key, r.answer) for r in b.collect()})).option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination()
    assert got == {1: ("a", "BLOCK"), 2: ("a", "BLOCK"), 3: ("b", "REVIEW"), 4: ("a", "BLOCK"), 5: ("b", "REVIEW"), 6: ("c", "ALLOW")}


def test_supervision(spark, tmp_path):
    root = f"file://{tmp_path}"
    append(spark, f"{root}/in", [(1,)], "x int")
    start = lambda name, each: sinks.start_batches(replayed_stream(spark, f"{root}/in", "x int"), each, f"{root}/{name}", name, processingTime="1 second")

    def broken(batch, _):
        raise RuntimeError("broken")

    pair = [start("good", lambda b, _: None), start("bad", broken)]
    assert supervise(pair, 0.2) == 1 and not any(q.isActive for q in pair)
    stop = threading.Event()
    one = start("again", lambda b, _: None)
    one.processAllAvailable()
    assert lag(one) == []  # files have no offsets of a broker
    offsets = lambda a, b: json.dumps({"t": {"0": a, "1": b}})
    busy = SimpleNamespace(lastProgress={"sources": [{"description": "k", "endOffset": offsets(5, 9), "latestOffset": offsets(12, 7)}]})
    assert [(r["topic"], r["partition"], r["lag"]) for r in lag(busy)] == [("t", 0, 7), ("t", 1, 0)]
    stop.set()
    assert supervise([one], 0.2, stop) == 0 and not one.isActive

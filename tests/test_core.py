"""Orphans, late events and repeated deliveries: edge cases, and the SQL of the queries."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from ledgerloom.commits import AlreadyCommitted
from ledgerloom.operators import bloom, dedup, lateness, orphans
from ledgerloom.operators.orphans import Reference
from ledgerloom.plans import registry

DAY0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(days: float) -> datetime:
    return DAY0 + timedelta(days=days)


def orphans_of(spark, refs, parents, gone):
    child = spark.createDataFrame(refs, "k bigint, ref string, arrived timestamp").selectExpr("*", "'c' AS target", "1 AS day", "2 AS block")
    parent = spark.createDataFrame(parents, "id string, loaded_at timestamp")
    deleted = spark.createDataFrame(gone, "table_name string, record_id string, deleted_at timestamp, restored_at timestamp")
    found = orphans.collect_references(child, [Reference("child", "ref", "p")], "k", "arrived")
    every, out = orphans.find_orphans(found, {"p": parent}, deleted)
    return sorted(r.ref_key for r in out.collect()), orphans.count_by_day(every, out)


def test_orphans_as_of_the_end_of_the_day(spark):
    parents = [("A", at(0.5)), (" a ", at(3)), ("b", at(1)), ("c", at(2.0)), ("d", at(0)), ("n", None), (None, at(0)), ("", at(0))]
    gone = [("p", "D ", at(1), None), ("p", "b", at(2), at(3.0)), ("p", "b", at(2), at(3.0)), ("q", "a", at(0), None), ("p", "a", None, None), ("p", "c", at(5.5), at(5.6))]
    refs = [
        (1, " a", at(0.1)),  # loaded later that day
        (2, "B", at(0.9)),  # loaded at the midnight that ends the day: not there
        (3, "b", at(1.9)),  # deleted at that midnight: still there
        (4, "b", at(2.1)),  # deleted, and restored exactly at the end: gone
        (5, "b", at(3.1)),  # restored
        (6, "d", at(0.5)), (7, "d", at(1.5)),  # deleted for good from day 1
        (8, "nobody", at(0)), (9, None, at(0)), (10, "  ", at(0)), (11, "n", at(9)), (12, "c", at(5.1)),  # deleted and restored within the day
        (13, "a", None), (14, "d", None),  # judged at the end of all time
    ]
    found, counts = orphans_of(spark, refs, parents, gone)
    assert found == [2, 4, 7, 8, 11, 14]
    by_day = {r.ref_day: (r.n_references, r.n_dangling) for r in counts.collect()}
    assert by_day["2024-01-01"] == (4, 2) and by_day[None] == (2, 1)


def test_orphans_without_rows(spark):
    assert orphans_of(spark, [], [], [])[0] == []
    assert orphans_of(spark, [(1, "x", at(0))], [], [])[0] == [1]


def test_a_hot_reference(spark):
    refs = [(k, "hot" if k % 3 == 0 else f"k{k}", at(1)) for k in range(3000)]
    found, _ = orphans_of(spark, refs, [("hot", at(0))], [("p", "hot", at(5 + k % 3), at(6)) for k in range(50)])
    assert found == [k for k in range(3000) if k % 3]


@pytest.mark.parametrize("limit", [bloom.MAX_BROADCAST_BYTES, 2 * bloom.BLOCK_BYTES])
def test_bloom_never_drops(spark, monkeypatch, limit):
    monkeypatch.setattr(bloom, "MAX_BROADCAST_BYTES", limit)
    keys = spark.range(20_000).selectExpr("if(id % 4 = 0, 'a', 'b') AS part", "concat('k', id) AS key")
    built = bloom.build(keys.unionByName(spark.createDataFrame([("b", None), ("c", "x")], "part string, key string")), {"a": 5_000, "b": 15_000, "empty": 0})
    assert built.blocks == 2 + 5 + 1 and {len(r.words) for r in built.table.collect()} == {bloom.WORDS}
    assert bloom.test(keys, "part", "key", built, "maybe").filter("not maybe").count() == 0
    others = spark.range(20_000).selectExpr("if(id % 4 = 0, 'b', 'a') AS part", "concat('k', id) AS key")
    assert bloom.test(others, "part", "key", built, "maybe").filter("maybe").count() < 20_000 * 0.05
    strange = spark.createDataFrame([("empty", "k1"), ("c", "x"), ("a", None), (None, "k0")], "part string, key string")
    assert bloom.test(strange, "part", "key", built, "maybe").filter("maybe").count() == 0


STREAM = "delivery_id bigint, occurred_at timestamp, kafka_timestamp timestamp, amount bigint, source_topic string, source_partition int"


def hours(x: float) -> datetime:
    return DAY0 + timedelta(hours=x)


def closings_of(stream):
    clocks = lateness.source_clocks(stream)
    return lateness.closings(clocks), clocks


def test_late_rows_and_closings(spark):
    second = 1 / 3600
    rows = [
        (1, hours(0.5), hours(0.6), 10, "t", 0),
        (2, hours(0.5), hours(7), 20, "t", 0),  # exactly at the bound
        (3, hours(0.5), hours(7) + timedelta(microseconds=1), 40, "t", 0),
        (4, None, hours(50), 1, "t", 0), (5, hours(0.7), None, 5, "t", 1),
        (6, datetime(1969, 12, 31, 23, 59, tzinfo=timezone.utc), hours(0.1), 7, "t", 1),
        (7, hours(2), hours(9.5), None, "t", 1),
        (7, hours(2), hours(9.5), None, "t", 1),
        (8, hours(90), hours(1), 3, "t", 1), (9, hours(3.2), hours(3.2 + second), 2**62, "t", None), (10, hours(3.2), hours(3.3), 2**62, None, 0),
    ]
    frame = spark.createDataFrame(rows, STREAM).selectExpr("*", "1 AS hour", "2 AS tick")
    stream = lateness.stream_rows(frame, "s", "occurred_at", "amount")
    closed, clocks = closings_of(stream)
    marked = lateness.mark_diverted(stream, closed)
    assert sorted(r.delivery_id for r in marked.filter("diverted").collect()) == [3, 6, 7, 7]
    by_hour = {r.event_hour.isoformat(): r for r in lateness.hourly(lateness.hourly_deltas(marked), closed, clocks).collect()}
    first = by_hour["2024-01-01T00:00:00"]
    assert (first.n_rows, first.value_sum, first.n_corrections, first.n_diverted, first.is_final) == (3, 35, 1, 1, True)
    assert by_hour["2024-01-01T03:00:00"].value_sum is None or by_hour["2024-01-01T03:00:00"].value_sum == 2**63
    assert not by_hour["2024-01-04T18:00:00"].is_final
    assert by_hour["1969-12-31T23:00:00"].n_diverted == 1


def test_a_period_waits_for_every_source_but_not_for_idle_ones(spark):
    rows = [(1, hours(0.5), hours(0.5), 1, "t", 0), (2, hours(9), hours(7.2), 1, "t", 0), (3, hours(9), hours(8.5), 1, "t", 1), (4, hours(9), hours(30), 1, "t", 0)]
    stream = lateness.stream_rows(spark.createDataFrame(rows, STREAM), "s", "occurred_at", "amount")
    closed, clocks = closings_of(stream)
    marked = lateness.mark_diverted(stream, closed)
    found = {r.event_hour.isoformat(): r.closed_at.isoformat() for r in lateness.hourly(lateness.hourly_deltas(marked), closed, clocks).collect()}
    assert found["2024-01-01T00:00:00"] == "2024-01-01T08:30:00"  # source 1 is the last to pass hour 7
    assert found["2024-01-01T09:00:00"] == "2024-01-01T18:00:00"  # both silent for two hours after hour 16


def test_the_closing_decides_what_is_diverted_and_the_exact_check_what_lies_between(spark):
    """Row 3 lies beyond the bound of its hour, but source 1 still holds the hour open; only row 5 comes after the closing."""
    rows = [
        (1, hours(0.5), hours(0.5), 1, "t", 0), (2, hours(7), hours(7.1), 1, "t", 0), (3, hours(0.5), hours(7.2), 10, "t", 0),
        (4, hours(7), hours(7.5), 1, "t", 1), (5, hours(0.5), hours(7.6), 100, "t", 0), (6, hours(0.4), hours(1), 1000, "t", 1),
    ]
    stream = lateness.stream_rows(spark.createDataFrame(rows, STREAM), "s", "occurred_at", "amount")
    closed, clocks = closings_of(stream)
    diverted = lambda **how: sorted(r.delivery_id for r in lateness.mark_diverted(stream, closed, **how).filter("diverted").collect())
    assert diverted(exact=False) == [5] and diverted(exact=True) == [3, 5]
    hour = {r.event_hour.isoformat(): r for r in lateness.hourly(lateness.hourly_deltas(lateness.mark_diverted(stream, closed)), closed, clocks).collect()}["2024-01-01T00:00:00"]
    assert (hour.value_sum, hour.n_diverted, hour.n_after_close, hour.closed_at.isoformat()) == (1001, 2, 1, "2024-01-01T07:30:00")
    # without punctuations nothing is closed before the time-out
    assert sorted(r.delivery_id for r in lateness.mark_diverted(stream, closed.limit(0), exact=False).filter("diverted").collect()) == []


def test_closings_against_all_pairs_of_sources_and_periods(spark):
    import random

    rng = random.Random(7)
    rows = [(k, hours(rng.randrange(0, 60)), hours(rng.choice([rng.uniform(0, 70), rng.uniform(20, 30)])), 1, "t", rng.choice([0, 0, 0, 1, 1, 2])) for k in range(150)]
    stream = lateness.stream_rows(spark.createDataFrame(rows, STREAM), "s", "occurred_at", "amount")
    closed, clocks = closings_of(stream)
    found = {r.event_hour: r.closed_at for r in lateness.hourly(lateness.hourly_deltas(lateness.mark_diverted(stream, closed)), closed, clocks).collect()}
    for hour, got in found.items():
        bound = hour.replace(tzinfo=timezone.utc) + timedelta(hours=7)
        limit = bound + timedelta(hours=2)
        want = max(min([limit, *[r[2] for r in rows if r[5] == source and r[2] > bound]]) for source in {r[5] for r in rows})
        assert got.replace(tzinfo=timezone.utc) == want


def test_no_stream(spark):
    stream = lateness.stream_rows(spark.createDataFrame([], STREAM), "s", "occurred_at", "amount")
    closed, clocks = closings_of(stream)
    assert lateness.hourly(lateness.hourly_deltas(lateness.mark_diverted(stream, closed)), closed, clocks).count() == 0


MESSAGES = "delivery_id bigint, event_id string, decision_id string, source_topic string, source_partition int, source_offset bigint, leader_epoch int"


def test_message_keys_and_redundant_rows(spark):
    rows = [
        (1, "A", "x", "t", 0, 0, 1), (2, " a ", "y", "t", 0, 1, 1),  # the same event id
        (3, None, "D", "t", 0, 2, 1), (4, "  ", "d", "t", 0, 3, 1), (5, "", None, "t", 0, 4, 1), (6, None, "", "t", 0, 4, 1), (7, None, None, "t", 0, 4, 2),
        (8, None, None, None, None, None, None), (9, None, None, None, None, None, None), (10, None, None, None, 0, 4, 1), (11, None, None, None, 0, 4, 1), (12, "d", None, "t", 9, 9, 9),
    ]
    frame = spark.createDataFrame(rows, MESSAGES).selectExpr("*", "1 AS key", "2 AS shard", "3 AS code")
    key = dedup.message_key(("event_id", "decision_id"))
    assert sorted(r.delivery_id for r in dedup.redundant_rows(frame, key).collect()) == [2, 4, 6, 11, 12]
    kept = dedup.unique_rows(frame, key)
    assert sorted(r.delivery_id for r in kept.collect()) == [1, 3, 5, 7, 8, 9, 10] and kept.columns == frame.columns
    assert dedup.redundant_rows(frame.limit(0), key).count() == 0


def test_repeats_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(dedup, "MAX_BROADCAST_BYTES", 0)
    rows = [(k, "hot" if k % 3 == 0 else f"e{k // 2}", None, "t", 0, k, 1) for k in range(300)]
    key = dedup.message_key(("event_id", "decision_id"))
    first, want = {}, []
    for k, e, *_ in rows:
        want += [k] if e in first else []
        first.setdefault(e, k)
    frame = spark.createDataFrame(rows, MESSAGES)
    assert sorted(r.delivery_id for r in dedup.redundant_rows(frame, key).collect()) == want
    assert dedup.unique_rows(frame, key).count() == len(first)


def batch_of(spark, rows):
    return spark.createDataFrame(rows, "arrival bigint, key string")


def kept_of(store, rows):
    return sorted(r.arrival for r in store.select(batch_of(store.spark, rows)).collect())


def test_batches_share_what_was_seen(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dedup, "COMPACT_EVERY", 3)
    store = dedup.SeenStore(spark, f"file://{tmp_path}/seen", 8)
    batches = [[(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c")], [], [(6, "c"), (7, "d"), (8, "d"), (9, None)], [(10, "d")]]
    kept = [k for batch in batches for k in kept_of(store, batch)]
    assert kept == [1, 2, 5, 7] and store.versions() == [1, 2, 3, 4, 5]
    codes = store.dictionary().collect()
    assert len(codes) == 4 and len({(r.shard, r.code) for r in codes}) == 4
    # versions 1 to 3 became one folder, and what it replaced is gone
    assert len(store.state()["folders"]) == 1 and len(list((tmp_path / "seen" / "data").iterdir())) <= 1 + dedup.COMPACT_EVERY


def test_the_number_of_shards_belongs_to_the_state(spark, tmp_path):
    path, ids = f"file://{tmp_path}/seen", [(k, f"id{k}") for k in range(200)]
    assert len(kept_of(dedup.SeenStore(spark, path, 8), ids)) == 200
    with pytest.raises(ValueError, match="8 shards"):
        kept_of(dedup.SeenStore(spark, path, 16), ids)
    assert kept_of(dedup.SeenStore(spark, path), ids) == []


def test_of_two_runs_one_commits(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/seen"
    slow, fast = dedup.SeenStore(spark, path, 8), dedup.SeenStore(spark, path, 8)
    mine, other = [(k, f"b{k}") for k in range(100)], [(k, f"a{k}") for k in range(100)]
    encode = dedup.SeenStore._encode

    def overtaken(self, firsts, state):
        if self is slow:
            monkeypatch.setattr(dedup.SeenStore, "_encode", encode)
            assert len(kept_of(fast, other)) == 100
        return encode(self, firsts, state)

    monkeypatch.setattr(dedup.SeenStore, "_encode", overtaken)
    with pytest.raises(AlreadyCommitted):
        slow.apply(batch_of(spark, mine))
    # nothing of the lost run is left: no code has two ids, and its messages are still new
    codes = slow.dictionary().collect()
    assert len(codes) == 100 and len({(r.shard, r.code) for r in codes}) == 100
    assert len(kept_of(slow, mine)) == 100 and kept_of(fast, mine + other) == []


def test_a_batch_that_died_before_its_commit_is_repeated(spark, tmp_path, monkeypatch):
    store = dedup.SeenStore(spark, f"file://{tmp_path}/seen", 8)

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store.log, "commit", dies)
        with pytest.raises(OSError):
            store.apply(batch_of(spark, [(1, "a"), (2, "a"), (3, "b")]))
    assert store.versions() == []
    assert kept_of(store, [(1, "a"), (2, "a"), (3, "b")]) == [1, 3]


def cell(value):
    if value is None or value != value:
        return "~" if value is None else "NaN"
    return f"{value:.9g}" if isinstance(value, float) and not value.is_integer() else str(int(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle()))
def test_queries_against_sql(spark, data, name):
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for path in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = registry.queries()[name](spark, data)
    want = con.execute(registry.oracle()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    order = sorted(columns)
    mine = sorted(tuple(cell(r[c]) for c in order) for r in found.collect())
    theirs = sorted(tuple(cell(dict(zip(columns, r, strict=True))[c]) for c in order) for r in want.fetchall())
    assert mine == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.oracle()) <= set(__spark_entry__.queries())

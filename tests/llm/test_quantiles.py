"""Percentiles: intervals that hold, errors within the bound, merging in any grouping."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import quantiles as Q


def ranks(values: np.ndarray, x: float) -> tuple[int, int]:
    """The ranks that a value's occurrences take."""
    return int((values < x).sum()) + 1, int((values <= x).sum())


def check_summary(values, n, value, low, high, error):
    values = np.sort(values)
    assert n == len(values) and (value[1:] >= value[:-1]).all() and value[0] == values[0] and value[-1] == values[-1]
    assert (low <= high).all() and low[0] == 1 and high[-1] == n
    for v, lo, hi in zip(value, low, high, strict=True):
        a, b = ranks(values, v)
        assert lo <= b and hi >= a, (v, lo, hi, a, b)
    gaps = high[1:] - low[:-1]
    assert len(gaps) == 0 or gaps.max() <= max(1, 2 * error * n)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(-50, 50).map(lambda x: round(x)) | st.sampled_from([math.inf, -math.inf]), min_size=1, max_size=120), min_size=1, max_size=7), st.sampled_from([0.01, 0.05, 0.2]))
def test_merging_keeps_the_intervals(parts, error):
    made = [Q.summarise(np.zeros(len(p), np.int64), np.array(p, float), Q.permitted(error, 0)) for p in parts]
    at = np.concatenate([[0], np.cumsum([m[2][-1] for m in made])])
    merged = Q.merge(np.zeros(len(made), np.int64), np.array([m[1][0] for m in made]), at, *[np.concatenate([m[k] for m in made]) for k in (3, 4, 5)])
    every = np.concatenate(parts)
    check_summary(every, merged[1][0], *merged[3:], Q.permitted(error, 0))
    kept = Q.compress(merged[1], *merged[2:], Q.permitted(error, 1))
    check_summary(every, merged[1][0], *kept[1:], Q.permitted(error, 1))


def test_groups_do_not_mix():
    codes = np.array([1, 0, 1, 0, 2])
    found, n, at, value, low, high = Q.summarise(codes, np.array([5.0, 3.0, 4.0, 9.0, 1.0]), 0.01)
    assert found.tolist() == [0, 1, 2] and n.tolist() == [2, 2, 1] and value.tolist() == [3, 9, 4, 5, 1] and low.tolist() == [1, 2, 1, 2, 1]
    merged = Q.merge(np.array([1, 0, 1]), np.array([2, 1, 1]), np.array([0, 2, 3, 4]), np.array([1.0, 5.0, 7.0, 3.0]), np.array([1, 2, 1, 1]), np.array([1, 2, 1, 1]))
    assert merged[0].tolist() == [0, 1] and merged[1].tolist() == [1, 3] and merged[3].tolist() == [7, 1, 3, 5] and merged[4].tolist() == [1, 1, 2, 3] == merged[5].tolist()


def answers(spark, rows, keys, error=Q.ERROR, permille=(1, 250, 500, 990, 1000), partitions=9):
    frame = spark.createDataFrame(rows, "g string, d string, x double").selectExpr("*", "1 AS n", "2 AS part", "3 AS value").repartition(partitions)
    return frame, Q.percentiles(Q.build_summaries(frame, keys, "x", error), keys, permille)


def check_answers(found, values, error):
    for r in found:
        own = np.sort(values[r.g])
        rank = max(1, math.ceil(r.permille * len(own) / 1000))
        a, b = ranks(own, r.percentile)
        off = max(0, a - rank, rank - b)
        assert r.n == len(own) and off <= r.rank_error <= max(0.5, error * len(own)), (r, a, b, rank)


@pytest.mark.parametrize(("fan_in", "flush"), [(2, 32 << 20), (64, 32 << 20), (64, 2_000), (2, 500)])
def test_frames_and_periods(spark, monkeypatch, fan_in, flush):
    monkeypatch.setattr(Q, "FAN_IN", fan_in)
    monkeypatch.setattr(Q, "FLUSH_BYTES", flush)
    monkeypatch.setattr(Q, "TASK_BYTES", 100_000)
    monkeypatch.setattr(Q, "BATCH_ROWS", 400)
    rng = np.random.default_rng(2)
    values = {"hot": rng.lognormal(8, 3, 9000).round(), "ties": rng.integers(0, 5, 3000).astype(float), "few": rng.normal(size=7), "one": np.array([4.0])}
    rows = [(g, f"d{k % 6}", float(x)) for g, xs in values.items() for k, x in enumerate(xs)]
    frame, found = answers(spark, rows, ["g"], 0.01)
    check_answers(found.collect(), values, 0.01)
    daily = Q.build_summaries(frame, ["g", "d"], "x", 0.01)
    combined = Q.percentiles(Q.combine(daily, ["g"], 0.01), ["g"], (100, 500, 999))
    check_answers(combined.collect(), values, 0.01)


def test_sizes_are_bounded(spark):
    frame = spark.range(200_000).selectExpr("'g' AS g", "cast(id * 7919 % 200003 AS double) AS x").repartition(8)
    r = Q.build_summaries(frame, ["g"], "x", 0.01).selectExpr("n", "size(value) AS k").first()
    assert r.n == 200_000 and r.k <= 2 / 0.01


def test_nulls_nan_and_nothing(spark):
    rows = [("a", None, None), ("a", None, float("nan")), ("a", None, 1.0), (None, None, 2.0), (None, "x", float("inf")), ("b", None, None)]
    _, found = answers(spark, rows, ["g"], permille=(500,))
    assert {(r.g, r.n, r.percentile, r.rank_error) for r in found.collect()} == {("a", 1, 1.0, 0), (None, 2, 2.0, 0)}
    assert answers(spark, [], ["g"])[1].count() == 0
    assert Q.combine(Q.build_summaries(answers(spark, [], ["g"])[0], ["g", "d"], "x"), ["g"]).count() == 0


def test_runs_agree(spark):
    rows = [("g", "d", float(k * 31 % 997)) for k in range(5000)]
    a = sorted(map(tuple, answers(spark, rows, ["g"])[1].collect()))
    assert a == sorted(map(tuple, answers(spark, rows, ["g"])[1].collect()))

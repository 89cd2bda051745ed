"""Containers: nothing lost, nothing over the capacity, few of them."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import packing


def least(sizes, capacity):
    """The optimum, by trying all."""
    best = [len(sizes)]

    def go(rest, bins):
        if len(bins) >= best[0]:
            return
        if not rest:
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + rest[0] <= capacity and bins[k] not in bins[:k]:
                go(rest[1:], [*bins[:k], bins[k] + rest[0], *bins[k + 1 :]])
        go(rest[1:], [*bins, rest[0]])

    go(sorted(sizes, reverse=True), [])
    return best[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=11))
def test_small_groups_are_near_the_optimum(sizes):
    of, fills = packing.pack_group(np.array(sizes), 20, 0)
    assert fills.max() <= 20 and fills.sum() == sum(sizes) and np.bincount(of, weights=sizes).tolist() == fills.tolist()
    assert len(fills) <= least(sizes, 20) + 1


def test_the_search_empties_bins():
    rng = np.random.default_rng(3)
    sizes = rng.integers(300, 1400, 2000)
    start = packing.best_fit(sizes, 2048)
    better = packing.improve(start, sizes, 2048, 0)
    squares = lambda bins: sum(int(sizes[b].sum()) ** 2 for b in bins)
    assert len(better) < len(start) and squares(better) > squares(start)
    assert sorted(k for b in better for k in b) == list(range(2000)) and max(int(sizes[b].sum()) for b in better) <= 2048


@pytest.mark.parametrize(("giver", "receiver", "free", "step"), [([5], [3], 5, ((0,), ())), ([7], [4], 3, ((0,), (0,))), ([3, 4], [5], 2, ((0, 1), (0,))), ([9], [1], 3, None), ([2, 3], [9], 5, ((0, 1), ()))])
def test_steps(giver, receiver, free, step):
    assert packing.best_step(giver, receiver, free) == step


def check(rows, sizes, capacity):
    fills, got = defaultdict(int), defaultdict(list)
    for r in rows:
        fills[r.container_id] += r.n_tokens
        got[r.doc_id].append((r.first_token, r.n_tokens, r.piece))
    assert max(fills.values(), default=0) <= capacity
    assert set(got) == {k for k, n in sizes.items() if n}
    for k, parts in got.items():
        parts.sort()
        assert [p for _, _, p in parts] == list(range(len(parts))) and sum(n for _, n, _ in parts) == sizes[k]
        assert [f for f, _, _ in parts] == [capacity * i for i in range(len(parts))] and (len(parts) == 1 or sizes[k] > capacity)
    return len(fills)


def test_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 300)
    rng = np.random.default_rng(5)
    sizes = {k: int(n) for k, n in enumerate(rng.lognormal(5.6, 1.1, 2500).astype(int))} | {90_000: 2048, 90_001: 2049, 90_002: 4096, 90_003: 0}
    frame = spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint").selectExpr("*", "'x' AS bin", "1 AS group_id", "2 AS piece")
    rows = packing.containers(frame).collect()
    number = check(rows, sizes, 2048)
    assert number <= 1.01 * -(-sum(sizes.values()) // 2048) + 1
    again = packing.containers(frame.repartition(7)).collect()
    assert {(r.doc_id, r.piece, r.container_id) for r in rows} == {(r.doc_id, r.piece, r.container_id) for r in again}
    report = packing.fill_report(packing.containers(frame)).first()
    assert (report.n_containers, report.n_tokens, report.n_over) == (number, sum(sizes.values()), 0)


def test_items_that_cannot_be_combined(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 50)
    sizes = {k: 1100 for k in range(400)}
    rows = packing.containers(spark.createDataFrame(list(sizes.items()), "doc_id bigint, n_tokens bigint")).collect()
    assert check(rows, sizes, 2048) == 400


def test_nothing_to_pack(spark):
    empty = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.containers(empty).count() == 0
    report = packing.fill_report(packing.containers(empty)).first()
    assert (report.n_containers, report.n_tokens, report.least_containers) == (0, 0, 0)
    assert packing.containers(spark.createDataFrame([(1, 0), (2, None)], "doc_id bigint, n_tokens bigint")).count() == 0

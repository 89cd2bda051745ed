"""Filling fixed-capacity containers: a first placement, then a swap-based local search until bins empty.

Items are dealt to groups by a hash of their id, so a group is a bounded, random sample of the sizes. Within a group the
items are placed best-fit decreasing; then the underfull bins are searched: an item is moved, exchanged for another, or
two are exchanged for one, wherever this raises the sum of the squared fills, so full bins get fuller and poor ones
emptier until they can be given up. What is still open after that is dealt anew, to fewer groups, level by level, so
that the last open bins of all groups end up in one search. Sizes and containers are written once per level; no group
grows with the data, and nothing is collected.

Defined results: an item longer than the capacity is cut into pieces of the capacity and a rest, each a row; items
without tokens get no row; equal items are told apart by id and piece; no container exceeds the capacity; an empty
table gives no containers; the same rows give the same containers in every run.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize

CAPACITY = 2048
#: Items of one group: bounds a task's work (the search may look at all pairs of a group's underfull bins) and memory.
GROUP_ITEMS = 4_000
#: Up to so many groups get a task each; of more, a task gets so many.
MANY_TASKS, GROUPS_PER_TASK = 4_000, 16
#: A container with less unused than this share is closed at its level.
CLOSED_SHARE = 0.004
#: Levels at most; the last one closes what is left. 10,000 ** levels exceeds any number of items long before.
MAX_LEVELS = 6


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items, largest first, each into the fullest bin that still takes it. A bit per free amount finds that bin."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fitting = open_ >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                open_ &= ~(1 << free)
            bins[b].append(k)
        else:
            free, b = capacity, len(bins)
            bins.append([k])
        left = free - size
        by_free[left].append(b)
        if left:
            open_ |= 1 << left
    return bins


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int, closed_free: int) -> list[list[int]]:
    """Local search over the bins with more than ``closed_free`` unused, the emptiest ones as givers.

    A giver offers its items to the fuller bins, whose items are indexed by size. With f the receiver's fill, g the
    giver's and d > 0 what the receiver gains, the squared fill rises by 2d(f - g + d), so any gain of a bin that is at
    least as full as the giver counts. The largest gain that fits is taken: a move, an exchange for one smaller item,
    or two items for one. The search goes on until a whole round finds no exchange at all; it ends because every exchange
    raises the sum of the squared fills.
    """
    done = [b for b in bins if capacity - sum(int(sizes[k]) for k in b) <= closed_free]
    work = [b for b in bins if capacity - sum(int(sizes[k]) for k in b) > closed_free]
    while True:
        fills = [sum(int(sizes[k]) for k in b) for b in work]
        order = sorted(range(len(work)), key=lambda b: (fills[b], b))
        changed = False
        for giver in order:
            if not work[giver]:
                continue
            for receiver in reversed(order):
                if not work[giver]:
                    break
                if receiver == giver:
                    continue
                free = capacity - fills[receiver]
                if free <= 0 or fills[receiver] < fills[giver] or not work[receiver]:
                    continue
                step = best_step([int(sizes[k]) for k in work[giver]], [int(sizes[k]) for k in work[receiver]], free)
                if step is None:
                    continue
                give, take = step
                given, taken = [work[giver][i] for i in give], [work[receiver][i] for i in take]
                gain = sum(int(sizes[k]) for k in given) - sum(int(sizes[k]) for k in taken)
                work[giver] = [k for i, k in enumerate(work[giver]) if i not in give] + taken
                work[receiver] = [k for i, k in enumerate(work[receiver]) if i not in take] + given
                fills[giver] -= gain
                fills[receiver] += gain
                changed = True
        emptied = [b for b in work if b]
        done += [b for b in emptied if capacity - sum(int(sizes[k]) for k in b) <= closed_free]
        work = [b for b in emptied if capacity - sum(int(sizes[k]) for k in b) > closed_free]
        if not changed or len(work) < 2:
            break
    return done + work


def best_step(giver: list[int], receiver: list[int], free: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """The exchange that gains the receiver most within ``free``: (indices given, indices taken), or None."""
    best, found = 0, None
    for i, a in enumerate(giver):
        if best < a <= free:
            best, found = a, ((i,), ())
        for j, b in enumerate(receiver):
            if best < a - b <= free:
                best, found = a - b, ((i,), (j,))
    if best < free:
        for i, a in enumerate(giver):
            for i2 in range(i + 1, len(giver)):
                pair = a + giver[i2]
                if best < pair <= free:
                    best, found = pair, ((i, i2), ())
                for j, b in enumerate(receiver):
                    if best < pair - b <= free:
                        best, found = pair - b, ((i, i2), (j,))
                if best == free:
                    return found
    return found


def pack_group(sizes: np.ndarray, capacity: int = CAPACITY, closed_share: float = CLOSED_SHARE) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each item, fill of each bin)."""
    bins = improve(best_fit(sizes, capacity), sizes, capacity, int(capacity * closed_share))
    of = np.empty(len(sizes), np.int64)
    for b, items in enumerate(bins):
        of[items] = b
    return of, np.bincount(of, weights=sizes, minlength=len(bins)).astype(np.int64)


def pieces(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, first_token, n_tokens): items cut to the capacity; items without tokens are left out."""
    count = F.ceil(F.col(size) / F.lit(capacity)).cast("int")
    parts = sizes.filter(F.col(size) > 0).select(key, F.col(size).alias("_all"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece"))
    first = F.col("piece").cast("bigint") * capacity
    return parts.select(key, "piece", first.alias("first_token"), F.least(F.lit(capacity), F.col("_all") - first).cast("int").alias("n_tokens"))


_PLACED = "group_id bigint, bin bigint, closed boolean"


def _place(key: str, capacity: int, level: int, final: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([key, "piece"], kind="stable").reset_index(drop=True)
        of, fills = pack_group(rows["n_tokens"].to_numpy(np.int64), capacity)
        closed = (capacity - fills <= int(capacity * CLOSED_SHARE)) | final
        return rows.assign(bin=of, closed=closed[of])

    return run


def containers(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, first_token, n_tokens, container_id), one row per piece.

    A container's id is made of its level, its group and its number there.
    """
    kind = sizes.schema[key].dataType.simpleString()
    items = materialize(pieces(sizes, key, size, capacity), "pieces")
    waiting, placed = items.filter(F.col("n_tokens") < capacity), []
    alone = items.filter(F.col("n_tokens") == capacity)
    placed.append(alone.withColumn("container_id", F.concat_ws("-", F.lit("full"), F.col(key).cast("string"), F.col("piece").cast("string"))))
    before = None
    for level in range(MAX_LEVELS):
        count = waiting.count()
        if not count:
            break
        groups = -(-count // GROUP_ITEMS)
        # what did not shrink by half can't be combined any better by dealing it again
        final = groups == 1 or level == MAX_LEVELS - 1 or (before is not None and count > before // 2)
        before = count
        dealt = waiting.withColumn("group_id", F.pmod(F.xxhash64(F.col(key), F.col("piece"), F.lit(level)), F.lit(groups)))
        # a group is little data but seconds of work, so the number of tasks is not left to the size of the data
        dealt = dealt.repartition(max(1, min(groups, max(MANY_TASKS, groups // GROUPS_PER_TASK))), "group_id")
        schema = f"`{key}` {kind}, piece int, first_token bigint, n_tokens int, {_PLACED}"
        done = materialize(dealt.groupBy("group_id").applyInPandas(_place(key, capacity, level, final), schema), f"packed{level}")
        name = F.concat_ws("-", F.lit(str(level)), F.col("group_id").cast("string"), F.col("bin").cast("string"))
        placed.append(done.filter("closed").withColumn("container_id", name).select(key, "piece", "first_token", "n_tokens", "container_id"))
        if final:
            break
        waiting = done.filter(~F.col("closed")).select(key, "piece", "first_token", "n_tokens")
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def fill_report(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers, and containers over the capacity."""
    fills = placed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    return fills.agg(
        F.count("*").alias("n_containers"), F.coalesce(F.sum("fill"), F.lit(0)).alias("n_tokens"),
        F.ceil(F.coalesce(F.sum("fill"), F.lit(0)) / F.lit(capacity)).alias("least_containers"), F.count_if(F.col("fill") > capacity).alias("n_over"),
    )

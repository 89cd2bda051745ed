"""Percentiles of very large columns from mergeable summaries of rank intervals.

A summary is a sorted list of values of the column, each with the least and the greatest rank it can have among the n
values summarised. A partition's own summary comes from its sorted values, so its ranks are exact; it keeps so few of
them that neighbours lie within the permitted uncertainty. Merging adds ranks: a value's interval in the union follows
from its neighbours in the other summaries, for any number of summaries at once by two running sums. Compressing drops
values while neighbouring intervals stay within the uncertainty permitted at that level, which grows from half of the
error bound to the whole. So the error of any answer is known from the intervals, and at most ``error * n`` ranks.

Summaries are merged hierarchically: the partials of a group are dealt to buckets of bounded fan-in, level by level, so
a group with a third of all rows is never gathered in one task. Nothing is random: the same partials give the same
summaries. Groups of fewer than 1/error values keep every value, and their answers are exact.

Defined results: nulls and NaN are left out, infinities are values like others; a group without values has no row; ties
count as separate values; null group keys form a group of their own; the p-th percentile is the value of rank
ceil(p*n), 1 at least; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize

#: Greatest error of a rank, as a share of the number of values.
ERROR = 0.005
#: Rows that a task summarises at a time, and the partials that are merged at once.
BATCH_ROWS = 2_000_000
FAN_IN = 64
#: Bytes of partials that a merging task collects before it merges the whole groups among them.
FLUSH_BYTES = 32 << 20
#: Bytes of partials that a merging task is meant to read; sets the number of tasks.
TASK_BYTES = 128 << 20
#: Percentiles in thousandths.
PERMILLE = (500, 900, 990)

_SUMMARY = "n bigint, value array<double>, low array<bigint>, high array<bigint>"
_ARROW = [("n", pa.int64()), ("value", pa.list_(pa.float64())), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))]


def permitted(error: float, level: int) -> float:
    """The error that summaries of a level may have: half of the bound for partitions, nearing it with the levels."""
    return error * (1 - 0.5 ** (level + 1))


def starts_of(codes: np.ndarray) -> np.ndarray:
    """Where groups begin in sorted codes."""
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.empty(0, np.int64)


def summarise(codes: np.ndarray, values: np.ndarray, error: float) -> tuple[np.ndarray, ...]:
    """(code of each group, n, where its values begin (with the end), values, low, high) from rows in any order."""
    order = np.lexsort((values, codes))
    codes, values = codes[order], values[order]
    heads = starts_of(codes)
    sizes = np.diff(np.append(heads, len(codes)))
    n = np.repeat(sizes, sizes)
    rank = np.arange(len(codes)) - np.repeat(heads, sizes) + 1
    step = np.maximum(1, np.floor(2 * error * n).astype(np.int64))
    keep = (rank == 1) | (rank == n) | (rank % step == 0)
    group = np.repeat(np.arange(len(heads)), sizes)[keep]
    at = np.searchsorted(group, np.arange(len(heads) + 1))
    return codes[heads], sizes, at, values[keep], rank[keep], rank[keep]


def merge(codes: np.ndarray, n: np.ndarray, at: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """The summaries of equal code become one; same form as ``summarise`` gives, uncompressed."""
    sizes = np.diff(at)
    part = np.repeat(np.arange(len(codes)), sizes)
    first = np.zeros(len(value), bool)
    first[at[:-1]] = True
    last = np.zeros(len(value), bool)
    last[at[1:] - 1] = True
    # what a value adds to the least rank of those after it, and what passing it adds to the greatest
    gain = low - np.where(first, 0, np.concatenate([[0], low[:-1]]))
    following = np.where(last, np.repeat(n, sizes) + 1, np.concatenate([high[1:], [0]]))
    passing = following - high
    order = np.lexsort((part, value, codes[part]))
    group = codes[part][order]
    heads = starts_of(group)
    counts = np.diff(np.append(heads, len(group)))
    cum_gain, cum_pass = np.cumsum(gain[order]), np.cumsum(passing[order])
    before = np.concatenate([[0], cum_pass[:-1]])
    base_gain = np.concatenate([[0], cum_gain])[heads]
    base_pass = before[heads]
    # before anything is passed, each summary's first value has the greatest rank ``high``
    by_code = pd.Series(high[at[:-1]] - 1).groupby(codes, sort=True).sum().to_numpy()
    total = pd.Series(n).groupby(codes, sort=True).sum().to_numpy()
    new_low = cum_gain - np.repeat(base_gain, counts)
    new_high = before - np.repeat(base_pass, counts) + np.repeat(by_code, counts) + 1
    return group[heads], total, np.append(heads, len(group)), value[order], new_low, new_high


def compress(n: np.ndarray, at: np.ndarray, value: np.ndarray, low: np.ndarray, high: np.ndarray, error: float) -> tuple[np.ndarray, ...]:
    """(at, value, low, high) with values dropped while neighbours stay within ``2 * error * n`` ranks."""
    keep = np.ones(len(value), bool)
    for g in np.flatnonzero((np.diff(at) > 2) & (2 * error * n >= 2)):
        a, b = at[g], at[g + 1]
        width = int(2 * error * n[g])
        lows, highs = low[a:b], high[a:b]
        chosen, k = [0], 0
        while k < b - a - 1:
            k = max(k + 1, int(np.searchsorted(highs, lows[k] + width, side="right")) - 1)
            chosen.append(min(k, b - a - 1))
        keep[a:b] = False
        keep[a + np.array(chosen)] = True
    kept = np.concatenate([[0], np.cumsum(keep)])[at]
    return kept, value[keep], low[keep], high[keep]


def _lists(at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))


def _codes(frame: pd.DataFrame) -> tuple[np.ndarray, pd.DataFrame]:
    """A number for each distinct row, and these rows in order of the numbers. Nulls equal nulls."""
    if not len(frame):
        return np.empty(0, np.int64), frame
    codes = frame.groupby(list(frame.columns), dropna=False, sort=False).ngroup().to_numpy()
    first = np.full(int(codes.max()) + 1, -1)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, frame.iloc[first].reset_index(drop=True)


def _rows(keys: pd.DataFrame, schema: pa.Schema, columns: tuple[np.ndarray, ...], extra: dict[str, pa.Array]) -> pa.RecordBatch:
    codes, n, at, value, low, high = columns
    found = [pa.array(keys[c].iloc[codes], schema.field(c).type, from_pandas=True) for c in keys.columns]
    arrays = found + list(extra.values()) + [pa.array(n, pa.int64()), _lists(at, value, pa.float64()), _lists(at, low, pa.int64()), _lists(at, high, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=[*keys.columns, *extra, "n", "value", "low", "high"])


def _summarise_task(keys: Sequence[str], error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            frame = table.select(list(keys)).to_pandas(types_mapper=pd.ArrowDtype)
            codes, distinct = _codes(frame)
            columns = summarise(codes, table.column("x").to_numpy(), error)
            return _rows(distinct, table.schema, columns, {"part": pa.array(np.zeros(len(columns[0]), np.int64))})

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= BATCH_ROWS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _merge_task(keys: Sequence[str], error: float):
    """Merges rows that come in order of ``keys`` and ``part``: whole groups at a time, as soon as enough are there."""
    names = [*keys, "part"]

    def merged(table: pa.Table, codes: np.ndarray, distinct: pd.DataFrame) -> pa.RecordBatch:
        flat = [table.column(c).combine_chunks() for c in ("value", "low", "high")]
        flat = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in flat]
        at = flat[0].offsets.to_numpy() - flat[0].offsets[0].as_py()
        value, low, high = (c.flatten().to_numpy(zero_copy_only=False) for c in flat)
        found, n, at, value, low, high = merge(codes, table.column("n").to_numpy(), at, value, low, high)
        at, value, low, high = compress(n, at, value, low, high, error)
        return _rows(distinct, table.schema, (found, n, at, value, low, high), {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, limit = 0, FLUSH_BYTES
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < limit:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            codes, _ = _codes(table.select(names).to_pandas(types_mapper=pd.ArrowDtype))
            # the last group may go on; the rows before it are whole groups
            done = int(np.flatnonzero(codes == codes[-1])[0])
            if done:
                whole = table.slice(0, done)
                yield merged(whole.combine_chunks(), *_codes(whole.select(names).to_pandas(types_mapper=pd.ArrowDtype)))
            held = table.slice(done).combine_chunks().to_batches()
            size = sum(b.nbytes for b in held)
            limit = max(FLUSH_BYTES, 2 * size)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield merged(table, *_codes(table.select(names).to_pandas(types_mapper=pd.ArrowDtype)))

    return run


def _types(df: DataFrame, columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def partials(df: DataFrame, keys: Sequence[str], value: str, error: float = ERROR) -> DataFrame:
    """(keys, part, n, value, low, high): one summary per group and partition; nothing is shuffled."""
    number = F.col(value).cast("double")
    rows = df.select(*keys, number.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    found = rows.mapInArrow(_summarise_task(keys, permitted(error, 0)), f"{_types(df, keys)}, part bigint, {_SUMMARY}")
    # told apart by the partition they come from; a partition's flushes share its number
    return found.withColumn("part", F.spark_partition_id().cast("bigint"))


def merge_summaries(found: DataFrame, keys: Sequence[str], error: float = ERROR, level: int = 1) -> DataFrame:
    """(keys, n, value, low, high) from summaries with a column ``part``: by buckets of parts until one is left.

    There is one round at least, because a partition may hold several summaries of a group.
    """
    schema = f"{_types(found, keys)}, part bigint, {_SUMMARY}"
    asked = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        size = found.agg(F.max("part").alias("part"), F.sum(F.size("value") * 24 + 100).alias("bytes")).first()
        parts = -(-((size["part"] or 0) + 1) // FAN_IN)
        dealt = found.withColumn("part", F.call_function("div", F.col("part"), F.lit(FAN_IN)))
        dealt = dealt.repartition(max(asked, -(-(size["bytes"] or 0) // TASK_BYTES)), *keys, "part").sortWithinPartitions(*keys, "part")
        found = dealt.mapInArrow(_merge_task(keys, permitted(error, level)), schema)
        level += 1
        if parts == 1:
            return found.drop("part")
        found = materialize(found, "summaries")


def build_summaries(df: DataFrame, keys: Sequence[str], value: str, error: float = ERROR) -> DataFrame:
    """The summary of every group of ``df``."""
    return merge_summaries(materialize(partials(df, keys, value, error), "partials"), keys, error)


def combine(summaries: DataFrame, keys: Sequence[str], error: float = ERROR, level: int = 4) -> DataFrame:
    """Summaries of finer groups (days, batches) to those of ``keys``; rank errors add up in the intervals."""
    numbered = summaries.withColumn("part", F.pmod(F.xxhash64("n", "value"), F.lit(FAN_IN * FAN_IN)))
    return merge_summaries(numbered.select(*keys, "part", "n", "value", "low", "high"), keys, error, level)


def _answer(permille: Sequence[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, low, high = (batch.column(batch.schema.get_field_index(c)) for c in ("value", "low", "high"))
            at = value.offsets.to_numpy() - value.offsets[0].as_py()
            values, lows, highs = (c.flatten().to_numpy(zero_copy_only=False) for c in (value, low, high))
            n = batch.column(batch.schema.get_field_index("n")).to_numpy()
            picked = np.empty((len(n), len(permille)), np.int64)
            wrong = np.empty((len(n), len(permille)), np.int64)
            for g in range(len(n)):
                a, b = at[g], at[g + 1]
                for k, p in enumerate(permille):
                    rank = max(1, -(-p * int(n[g]) // 1000))
                    # the error falls with the least rank and rises with the greatest; they cross where the middle passes
                    j = a + int(np.searchsorted(lows[a:b] + highs[a:b], 2 * rank))
                    near = [i for i in (j - 1, j) if a <= i < b]
                    off = [max(rank - int(lows[i]), int(highs[i]) - rank) for i in near]
                    best = int(np.argmin(off))
                    picked[g, k], wrong[g, k] = near[best], off[best]
            times = len(permille)
            keep = [i for i, name in enumerate(batch.schema.names) if name not in ("value", "low", "high")]
            index = pa.array(np.repeat(np.arange(len(n)), times))
            columns = [batch.column(i).take(index) for i in keep]
            columns += [pa.array(np.tile(np.array(permille, np.int32), len(n))), pa.array(values[picked.ravel()] if len(n) else np.empty(0)), pa.array(wrong.ravel())]
            yield pa.RecordBatch.from_arrays(columns, names=[batch.schema.names[i] for i in keep] + ["permille", "percentile", "rank_error"])

    return run


def percentiles(summaries: DataFrame, keys: Sequence[str], permille: Sequence[int] = PERMILLE) -> DataFrame:
    """(keys, n, permille, percentile, rank_error): ``rank_error`` bounds how far the answer's rank is from the asked."""
    return summaries.select(*keys, "n", "value", "low", "high").mapInArrow(_answer(permille), f"{_types(summaries, keys)}, n bigint, permille int, percentile double, rank_error bigint")

"""Long exact spans shared between records, by level-wise doubling of repeated windows.

A character is shared if it lies in a window of ``length`` characters that another text holds verbatim. Such a window
can only repeat if its shorter windows do. So each level looks at windows of one length, L/4, L/2 and L: those repeated
in another text at one level are extended to twice the length at the next, within what is left, and the windows of length
L that are repeated make up the spans. ``longest_levels`` goes on doubling until no window survives.

Below L a window of L characters is stood for by one of its short windows, the leftmost one of least hash. Equal windows
choose equal short windows at the same place, so no repeated window is lost, while only about one position in 75 (or 50)
is looked at. A window of L characters stays a candidate while the short window that it chose is repeated; a wrong
repeat there only keeps a candidate for longer. From L on, windows are told apart by two polynomial hashes modulo the
prime 2**61 - 1 whose bases are drawn anew for each run, so whatever the texts, two different windows of n characters
agree with a chance of at most (n / 2**61)**2: with 10**12 windows of 200, one wrong pair in 10**8 runs. The windows of
length L that survive are then compared by their characters: neighbours go together, in groups of up to 32, to where equal
ones go, a task's own copies having been settled before. The further levels of ``longest_levels`` rest on the hashes.

Repeats are found with one shuffle a level, of packed hashes. A task first compares its own rows: a window that two of
its texts share is settled there, and one marker stands for it, so however many texts share a window, a task sends it
once for each text at most if it knows it from one text only. The hashes are cut into shards by their value, as many as
the texts need, and settled one shard after the other. Texts move once at most: what is left of them after the first
level is written to the shared folder, and the later levels read only that.

Defined results: null texts and texts shorter than ``length`` share nothing; repeats within one text don't count, nor
does a key that occurs in several rows count as several texts; identical texts share everything; nothing is normalised;
characters are code points; a text of any length is taken whole; an empty table gives no spans.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import bloom
from ledgerloom.session import materialize

LENGTH = 200
#: Code points that are hashed together; a power of two that leaves 44 bits for hashes beside a position.
BLOCK = 1 << 18
POSITION_BITS = 20
#: Rows a task packs at a time.
FLUSH_ROWS = 4_000_000
#: Texts a shard of hashes is meant for, and the shards that a task settles, one after the other.
TEXTS_PER_SHARD = 1_000
SHARDS_PER_TASK = 16
#: Bytes of surviving positions that may be broadcast to the scan of the texts; more are joined by shuffle.
MAX_BROADCAST_BYTES = 48 << 20

_BASE, _MIX = np.uint64(0xD6E8FEB86659FD93), (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
#: Position of a marker: the window is known to be in two texts.
MARKER = -1


class Hasher:
    """Quick polynomial hashes of all windows of a block, from prefix sums modulo 2**64, for the levels below L."""

    def __init__(self, size: int):
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        self.power, self.inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_BASE, inverse))

    def prefix(self, points: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(points) + 1, np.uint64)
        spread = (points.astype(np.uint64) + np.uint64(1)) * _MIX[0]
        spread ^= spread >> np.uint64(29)
        spread *= self.power[: len(points)]
        np.cumsum(spread, out=sums[1:])
        return sums

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all windows of ``length``."""
        out = (prefix[length:] - prefix[:-length]) * self.inverse[: len(prefix) - length]
        out ^= np.uint64(length)
        out ^= out >> np.uint64(33)
        out *= _MIX[0]
        out ^= out >> np.uint64(29)
        return out


PRIME = np.uint64(2**61 - 1)
_LOW32, _LOW29 = np.uint64(2**32 - 1), np.uint64(2**29 - 1)
_S61, _S32, _S29, _S3 = np.uint64(61), np.uint64(32), np.uint64(29), np.uint64(3)


def _reduce(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the prime, in [0, PRIME)."""
    x = (x & PRIME) + (x >> _S61)
    return np.where(x >= PRIME, x - PRIME, x)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime of numbers below it, by halves of 32 bits; 2**61 counts as 1."""
    a1, a0, b1, b0 = a >> _S32, a & _LOW32, b >> _S32, b & _LOW32
    low, middle, high = a0 * b0, a1 * b0 + a0 * b1, a1 * b1
    return _reduce((low & PRIME) + (low >> _S61) + (middle >> _S29) + ((middle & _LOW29) << _S32) + (high << _S3))


class ExactHasher:
    """Polynomial hashes of windows modulo the prime, from prefix sums."""

    def __init__(self, base: int, size: int):
        self.power, self.inverse = self._powers(base, size), self._powers(pow(base, -1, int(PRIME)), size)

    @staticmethod
    def _powers(base: int, size: int) -> np.ndarray:
        out, step = np.ones(1, np.uint64), base
        while len(out) <= size:
            out = np.concatenate([out, multiply(out, np.full(len(out), step, np.uint64))])
            step = step * step % int(PRIME)
        return out[: size + 1]

    def prefix(self, points: np.ndarray) -> np.ndarray:
        terms = multiply(points.astype(np.uint64) + np.uint64(1), self.power[: len(points)])
        high, low = np.cumsum(terms >> _S32), np.cumsum(terms & _LOW32)
        sums = np.zeros(len(points) + 1, np.uint64)
        sums[1:] = _reduce((high >> _S29) + ((high & _LOW29) << _S32) + low)
        return sums

    def windows(self, prefix: np.ndarray, length: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows of ``length`` that begin at ``at``."""
        return multiply(_reduce(prefix[at + length] + PRIME - prefix[at]), self.inverse[at])


def new_bases() -> tuple[int, int]:
    """The bases of one run, the same in all its tasks."""
    return 2 + secrets.randbelow(int(PRIME) - 3), 2 + secrets.randbelow(int(PRIME) - 3)


@cache
def hasher(size: int = BLOCK) -> Hasher:
    return Hasher(size)


@lru_cache(maxsize=4)
def exact_hasher(base: int, size: int) -> ExactHasher:
    return ExactHasher(base, size)


def leftmost_minima(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes, the position of its least one, the leftmost of equals."""
    n = len(hashes)
    keys = (hashes & ~np.uint64((1 << POSITION_BITS) - 1)) | np.arange(n, dtype=np.uint64)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = keys
    rows = padded.reshape(-1, width)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return (np.minimum(onward[:count], upto[width - 1 : width - 1 + count]) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)


def blocks(keys: list[int], offsets: list[int], texts: list[str | None], length: int, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of code points from several texts: (points, text number, where it begins in the block, its offset).

    Every window of ``length`` lies in exactly one block: the parts of a text that exceeds a block overlap.
    """
    held: list[tuple[int, int, np.ndarray]] = []
    size, most = 0, most or BLOCK

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for _, _, p in held])
        return np.concatenate([p for _, _, p in held]), np.array([k for k, _, _ in held]), np.cumsum(sizes) - sizes, np.array([o for _, o, _ in held])

    for k, text in enumerate(texts):
        if text is None or len(text) < length:
            continue
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        for low in range(0, len(points) - length + 1, most - length + 1):
            part = points[low : low + most]
            if held and size + len(part) > most:
                yield joined()
                held, size = [], 0
            held.append((k, offsets[k] + low, part))
            size += len(part)
    if held:
        yield joined()


def starts_that_fit(total: int, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of windows that lie in one text, number of that text)."""
    ends = np.append(begins[1:], total) - length + 1
    counts = np.maximum(ends - begins, 0)
    shift = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(begins)), counts)
    return np.arange(int(counts.sum())) - shift[owner] + begins[owner], owner


class Rows:
    """Rows (hash, second hash, key, position) of one task; settles what its own texts share, packs the rest by shard.

    Below the last level there is no second hash; then the first takes its place.
    """

    def __init__(self, shards: int):
        self.shards = shards
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, hashes: np.ndarray, seconds: np.ndarray | None, keys: np.ndarray, positions: np.ndarray) -> None:
        if len(hashes):
            self.parts.append((hashes, hashes if seconds is None else seconds, keys, positions))
            self.size += len(hashes)

    def pack(self, with_seconds: bool) -> Iterator[pa.RecordBatch]:
        """Batches of packed rows; those without hashes are settled."""
        if not self.parts:
            return
        hashes, seconds, keys, positions = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        seconds = seconds if with_seconds else hashes
        shared, heads = shared_rows(hashes, seconds, keys, positions)
        settled = np.flatnonzero(shared)
        own = [pack_row(-1 - int(keys[settled[0]] % self.shards), None, None, keys[settled], positions[settled])] if len(settled) else []
        sent = np.concatenate([np.flatnonzero(~shared), heads])
        hashes, seconds, keys = hashes[sent], seconds[sent], keys[sent]
        positions = positions[sent]
        positions[len(sent) - len(heads) :] = MARKER
        shard = ((hashes * _MIX[1]) >> np.uint64(20)).astype(np.int64) % self.shards
        order = np.lexsort((positions, keys, shard))
        hashes, seconds, keys, positions, shard = hashes[order], seconds[order], keys[order], positions[order], shard[order]
        cut = np.flatnonzero(np.diff(shard)) + 1
        bounds = np.concatenate([[0], cut, [len(shard)]])
        rows = own + [pack_row(int(shard[a]), hashes[a:b], seconds[a:b] if with_seconds else None, keys[a:b], positions[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]
        yield pa.RecordBatch.from_pylist(rows, schema=PACKED)


PACKED = pa.schema([("shard", pa.int64()), ("hashes", pa.binary()), ("seconds", pa.binary()), ("keys", pa.binary()), ("positions", pa.binary())])
_PACKED = "shard bigint, hashes binary, seconds binary, keys binary, positions binary"


def pack_row(shard: int, hashes: np.ndarray | None, seconds: np.ndarray | None, keys: np.ndarray, positions: np.ndarray) -> dict:
    """Keys and positions as differences, which the shuffle's compression makes small."""
    return {
        "shard": shard, "hashes": None if hashes is None else hashes.tobytes(), "seconds": None if seconds is None else seconds.tobytes(),
        "keys": np.diff(keys, prepend=0).astype(np.int64).tobytes(), "positions": np.diff(positions, prepend=0).astype(np.int32).tobytes(),
    }


def unpack(row: dict) -> tuple[np.ndarray | None, np.ndarray | None, np.ndarray, np.ndarray]:
    hashes = None if row["hashes"] is None else np.frombuffer(row["hashes"], np.uint64)
    seconds = hashes if row["seconds"] is None else np.frombuffer(row["seconds"], np.uint64)
    return hashes, seconds, np.cumsum(np.frombuffer(row["keys"], np.int64)), np.cumsum(np.frombuffer(row["positions"], np.int32), dtype=np.int32)


def shared_rows(hashes: np.ndarray, seconds: np.ndarray, keys: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have hashes that two keys have or that are marked, the first row of each such pair of hashes)."""
    order = np.lexsort((seconds, hashes)) if seconds is not hashes else np.argsort(hashes, kind="stable")
    one, two = hashes[order], seconds[order]
    heads = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
    by_key = keys[order]
    several = np.minimum.reduceat(by_key, heads) != np.maximum.reduceat(by_key, heads)
    several |= np.minimum.reduceat(positions[order], heads) == MARKER
    shared = np.empty(len(hashes), bool)
    shared[order] = np.repeat(several, np.diff(np.append(heads, len(hashes))))
    return shared, order[heads[several]]


def _by_key(keys: np.ndarray, positions: np.ndarray) -> pa.RecordBatch:
    """(key, starts) with the positions of each key in order."""
    order = np.lexsort((positions, keys))
    keys, positions = keys[order], positions[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    lists = pa.ListArray.from_arrays(pa.array(np.append(heads, len(keys)), pa.int32()), pa.array(positions, pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(keys[heads], pa.int64()), lists], names=["key", "starts"])


def _settle(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch | None:
    """(key, starts) of a shard's rows whose window is repeated."""
    single = all(s is h for h, s, _, _ in parts)
    hashes, seconds, keys, positions = (np.concatenate(x) for x in zip(*parts, strict=True))
    shared, _ = shared_rows(hashes, hashes if single else seconds, keys, positions)
    shared &= positions != MARKER
    return _by_key(keys[shared], positions[shared]) if shared.any() else None


def _survivors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of some shards, in order of the shards, to (key, starts) of those whose window is repeated."""
    waiting: list[tuple[np.ndarray, ...]] = []
    current = None
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            hashes, seconds, keys, positions = unpack(row)
            if hashes is None:
                yield _by_key(keys, positions)
                continue
            if row["shard"] != current:
                if waiting and (found := _settle(waiting)) is not None:
                    yield found
                waiting, current = [], row["shard"]
            waiting.append((hashes, seconds, keys, positions))
    if waiting and (found := _settle(waiting)) is not None:
        yield found


def repeated(packed: DataFrame, shards: int) -> DataFrame:
    """(key, starts): the positions of each text whose windows other texts hold too; one shuffle by hash, one by text.

    A task has a bounded number of shards whatever the session's setting, and holds one of them at a time.
    """
    tasks = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // SHARDS_PER_TASK))
    found = packed.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_survivors_of, "key bigint, starts array<int>")
    return found.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _scan(length: int, level: int, shards: int):
    """A pass over texts (key, offset, text) at a level below ``length``; the rows of the level, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing, rows = hasher(), Rows(shards)
        for batch in batches:
            keys, offsets, texts = (batch.column(k).to_pylist() for k in range(3))
            for points, owner, begins, shift in blocks(keys, offsets, texts, length):
                starts, part = starts_that_fit(len(points), begins, length)
                every = hashing.windows(hashing.prefix(points), level)
                minima = leftmost_minima(every, length - level + 1)[starts]
                fresh = np.concatenate([[True], (minima[1:] != minima[:-1])]) if len(minima) else np.empty(0, bool)
                chosen, part_of = minima[fresh], part[fresh]
                positions = (chosen - begins[part_of] + shift[part_of]).astype(np.int32)
                rows.add(every[chosen], None, np.array(keys, np.int64)[owner[part_of]], positions)
            if rows.size > FLUSH_ROWS:
                yield from rows.pack(False)
        yield from rows.pack(False)

    return run


def _scan_exactly(length: int, level: int, below: int | None, shards: int, bases: tuple[int, int]):
    """A pass over texts (key, offset, text, starts) at ``level``, ``length`` or a doubling of it; its rows, packed.

    Candidates are the windows whose short window of length ``below`` has survived, or, without ``below``, those both of
    whose halves have.
    """
    most = max(BLOCK, 4 * level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, rows = *(exact_hasher(b, most) for b in bases), Rows(shards)
        for batch in batches:
            keys, offsets, texts = (batch.column(k).to_pylist() for k in range(3))
            for points, owner, begins, shift in blocks(keys, offsets, texts, level, most):
                starts, part = starts_that_fit(len(points), begins, level)
                if below is None:
                    alive = _marked(len(points) + 1, owner, begins, shift, batch.column(3))
                    good = alive[starts] & alive[starts + level // 2]
                    starts, part = starts[good], part[good]
                else:
                    starts, part = _candidates(hasher(), hasher().prefix(points), starts, part, below, length, owner, begins, shift, batch.column(3))
                if len(starts):
                    positions = (starts - begins[part] + shift[part]).astype(np.int32)
                    rows.add(one.windows(one.prefix(points), level, starts), two.windows(two.prefix(points), level, starts), np.array(keys, np.int64)[owner[part]], positions)
            if rows.size > FLUSH_ROWS:
                yield from rows.pack(True)
        yield from rows.pack(True)

    return run


def _marked(size: int, owner, begins, shift, alive) -> np.ndarray:
    """Which positions of a block are among the surviving ones of their text."""
    keep = np.zeros(size, bool)
    for k in range(len(owner)):
        where = alive[int(owner[k])].values
        if where is not None:
            at = np.asarray(where) - shift[k]
            end = (begins[k + 1] if k + 1 < len(begins) else size - 1) - begins[k]
            keep[begins[k] + at[(at >= 0) & (at < end)]] = True
    return keep


def _candidates(hashing, prefix, starts, part, level, length, owner, begins, shift, alive):
    """Of the windows, those whose chosen short window of the given level is among the surviving positions."""
    minima = leftmost_minima(hashing.windows(prefix, level), length - level + 1)
    keep = _marked(len(prefix), owner, begins, shift, alive)
    good = keep[minima[starts]]
    return starts[good], part[good]


def _cut(length: int, level: int):
    """Texts (key, offset, text, starts) to the parts of them that still hold candidates (key, offset, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = hasher()
        for batch in batches:
            keys, offsets, texts = (batch.column(k).to_pylist() for k in range(3))
            out: tuple[list, list, list] = ([], [], [])
            for points, owner, begins, shift in blocks(keys, offsets, texts, length):
                starts, part = starts_that_fit(len(points), begins, length)
                starts, part = _candidates(hashing, hashing.prefix(points), starts, part, level, length, owner, begins, shift, batch.column(3))
                if not len(starts):
                    continue
                heads = np.flatnonzero(np.concatenate([[True], (np.diff(starts) > length) | (np.diff(part) != 0)]))
                tails = np.append(heads[1:], len(starts)) - 1
                for a, b in zip(heads, tails, strict=True):
                    k, low, high = part[a], starts[a], starts[b] + length
                    out[0].append(keys[owner[k]])
                    out[1].append(int(low - begins[k] + shift[k]))
                    out[2].append(points[low:high].tobytes().decode("utf-32-le", "replace"))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["key", "offset", "text"])

    return run


#: Windows at most whose characters are sent together: neighbours that lie alike around the short window that they chose.
GROUP = 32
#: Code points that a task holds before it compares and packs them.
FLUSH_POINTS = 4_000_000
TEXTS = pa.schema([("shard", pa.int64()), ("keys", pa.binary()), ("positions", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary())])
_TEXTS = "shard bigint, keys binary, positions binary, sizes binary, text binary"


def _ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of several stretches, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


def _equal_stretches(points: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each stretch at ``a`` has the characters of the one at ``b``; compared in parts of bounded size."""
    out = np.empty(len(a), bool)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // (1 << 22))) + 1
    for low, high in zip(np.concatenate([[0], cuts]), np.append(cuts, len(a)), strict=True):
        if high > low:
            same = points[_ragged(a[low:high], sizes[low:high])] == points[_ragged(b[low:high], sizes[low:high])]
            out[low:high] = np.logical_and.reduceat(same, np.cumsum(sizes[low:high]) - sizes[low:high])
    return out


def compared(points: np.ndarray, sizes: np.ndarray, keys: np.ndarray, known: np.ndarray, length: int, hashing: ExactHasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of several segments: (segment, whether another key has its characters, whether it is the first such).

    Segment k has ``sizes[k]`` windows and belongs to ``keys[k]``; ``known`` ones are in two texts already. Hashes only
    bring windows together; whether they are equal is decided by their characters.
    """
    widths = sizes + length - 1
    begins = np.cumsum(widths) - widths
    segment = np.repeat(np.arange(len(sizes)), sizes)
    at = _ragged(begins, sizes)
    hashes = np.empty(len(at), np.uint64)
    room = len(hashing.power) - 1
    block, first = begins // (room // 2), 0
    for low in np.unique(block):
        mine = slice(first, int(np.searchsorted(block, low, side="right")))
        first = mine.stop
        base, end = begins[mine.start], begins[mine.stop - 1] + widths[mine.stop - 1]
        windows = slice(int(np.searchsorted(segment, mine.start)), int(np.searchsorted(segment, mine.stop)))
        hashes[windows] = hashing.windows(hashing.prefix(points[base:end]), length, at[windows] - base)
    order = np.argsort(hashes, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
    group = np.empty(len(at), np.int64)
    group[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(at))))
    like = order[heads][group]
    others = np.flatnonzero(like != np.arange(len(at)))
    if len(others):
        # neighbours that are like neighbours are compared in one stretch
        twin = like[others]
        fresh = np.concatenate([[True], (np.diff(others) != 1) | (np.diff(twin) != 1) | (np.diff(segment[others]) != 0) | (np.diff(segment[twin]) != 0)])
        runs = np.flatnonzero(fresh)
        counts = np.diff(np.append(runs, len(others)))
        good = _equal_stretches(points, at[others[runs]], at[twin[runs]], counts + length - 1)
        doubtful = np.unique(group[others[np.repeat(~good, counts)]])
        if len(doubtful):
            names: dict[bytes, int] = {}
            for w in np.flatnonzero(np.isin(group, doubtful)):
                group[w] = names.setdefault(points[at[w] : at[w] + length].tobytes(), len(heads) + len(names))
    order = np.argsort(group, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    of_key = keys[segment][order]
    several = np.minimum.reduceat(of_key, heads) != np.maximum.reduceat(of_key, heads)
    several |= np.logical_or.reduceat(known[segment][order], heads)
    shared = np.empty(len(at), bool)
    shared[order] = np.repeat(several, np.diff(np.append(heads, len(at))))
    is_head = np.zeros(len(at), bool)
    is_head[order[heads[several]]] = True
    return segment, shared, is_head


class Segments:
    """Stretches of neighbouring windows with their characters; settles what a task's own texts share, packs the rest."""

    def __init__(self, shards: int, length: int, hashing: ExactHasher):
        self.shards, self.length, self.hashing = shards, length, hashing
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, points: np.ndarray, starts: np.ndarray, sizes: np.ndarray, route: np.ndarray, keys: np.ndarray, positions: np.ndarray) -> None:
        held = points[_ragged(starts, sizes + self.length - 1)]
        self.parts.append((held, sizes, route, keys, positions))
        self.size += len(held)

    def pack(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        points, sizes, route, keys, positions = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.size = [], 0
        segment, shared, is_head = compared(points, sizes, keys, np.zeros(len(sizes), bool), self.length, self.hashing)
        within = np.arange(len(segment)) - (np.cumsum(sizes) - sizes)[segment]
        place = positions[segment] + within
        rows = []
        if shared.any():
            rows.append(_text_row(-1 - int(keys[segment[shared]][0] % self.shards), keys[segment[shared]], place[shared].astype(np.int32), None, None))
        sent = np.flatnonzero(~shared | is_head)
        if len(sent):
            fresh = np.concatenate([[True], (np.diff(sent) != 1) | (np.diff(segment[sent]) != 0) | (is_head[sent][1:] != is_head[sent][:-1])])
            runs = np.flatnonzero(fresh)
            first, counts = sent[runs], np.diff(np.append(runs, len(sent)))
            widths = sizes + self.length - 1
            begins = (np.cumsum(widths) - widths)[segment[first]] + within[first]
            own = np.where(is_head[first], MARKER, place[first]).astype(np.int32)
            shard = ((route[segment[first]] * _MIX[1]) >> np.uint64(20)).astype(np.int64) % self.shards
            order = np.argsort(shard, kind="stable")
            cut = np.flatnonzero(np.diff(shard[order])) + 1
            for low, high in zip(np.concatenate([[0], cut]), np.append(cut, len(order)), strict=True):
                mine = order[low:high]
                text = points[_ragged(begins[mine], counts[mine] + self.length - 1)]
                rows.append(_text_row(int(shard[mine[0]]), keys[segment[first[mine]]], own[mine], counts[mine], text))
        yield pa.RecordBatch.from_pylist(rows, schema=TEXTS)


def _text_row(shard: int, keys: np.ndarray, positions: np.ndarray, sizes: np.ndarray | None, text: np.ndarray | None) -> dict:
    return {
        "shard": shard, "keys": np.diff(keys, prepend=0).astype(np.int64).tobytes(), "positions": np.diff(positions, prepend=0).astype(np.int32).tobytes(),
        "sizes": None if sizes is None else sizes.astype(np.int32).tobytes(), "text": None if text is None else text.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"),
    }


def _scan_texts(length: int, below: int, shards: int, base: int):
    """A pass over texts (key, offset, text, starts) with the windows of ``length`` that survived; their characters, packed.

    Equal windows choose the same short window at the same place, so they are in the same group around it and have the
    characters that all windows of a group share; these decide where a group is sent.
    """
    group = min(GROUP, length // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, quick = exact_hasher(base, max(BLOCK, 4 * length)), hasher()
        held = Segments(shards, length, exact)
        for batch in batches:
            keys, offsets, texts = (batch.column(k).to_pylist() for k in range(3))
            for points, owner, begins, shift in blocks(keys, offsets, texts, length):
                starts, part = starts_that_fit(len(points), begins, length)
                good = _marked(len(points) + 1, owner, begins, shift, batch.column(3))[starts]
                starts, part = starts[good], part[good]
                if not len(starts):
                    continue
                pivot = leftmost_minima(quick.windows(quick.prefix(points), below), length - below + 1)[starts]
                which = (pivot - starts) // group
                fresh = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(part) != 0) | (np.diff(pivot) != 0) | (np.diff(which) != 0)])
                runs = np.flatnonzero(fresh)
                common = exact.windows(exact.prefix(points), length - group + 1, pivot[runs] - group * which[runs])
                positions = (starts[runs] - begins[part[runs]] + shift[part[runs]]).astype(np.int64)
                held.add(points, starts[runs], np.diff(np.append(runs, len(starts))), common, np.array(keys, np.int64)[owner[part[runs]]], positions)
                if held.size > FLUSH_POINTS:
                    yield from held.pack()
        yield from held.pack()

    return run


def _compare_task(length: int, base: int):
    """The rows of some shards, in order of the shards, to (key, starts) of the windows whose characters are repeated."""

    def settle(rows: list[dict]) -> pa.RecordBatch | None:
        sizes = np.concatenate([np.frombuffer(r["sizes"], np.int32) for r in rows]).astype(np.int64)
        keys = np.concatenate([np.cumsum(np.frombuffer(r["keys"], np.int64)) for r in rows])
        positions = np.concatenate([np.cumsum(np.frombuffer(r["positions"], np.int32)) for r in rows])
        points = np.frombuffer(b"".join(r["text"].decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass") for r in rows), np.uint32)
        known = positions == MARKER
        segment, shared, _ = compared(points, sizes, keys, known, length, exact_hasher(base, max(BLOCK, 4 * length)))
        shared &= ~known[segment]
        place = positions[segment] + np.arange(len(segment)) - (np.cumsum(sizes) - sizes)[segment]
        return _by_key(keys[segment[shared]], place[shared].astype(np.int32)) if shared.any() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["text"] is None:
                    yield _by_key(np.cumsum(np.frombuffer(row["keys"], np.int64)), np.cumsum(np.frombuffer(row["positions"], np.int32), dtype=np.int32))
                    continue
                if waiting and row["shard"] != waiting[0]["shard"]:
                    if (found := settle(waiting)) is not None:
                        yield found
                    waiting = []
                waiting.append(row)
        if waiting and (found := settle(waiting)) is not None:
            yield found

    return run


def _verified(left: DataFrame, alive: DataFrame, length: int, shards: int, base: int) -> DataFrame:
    """(key, starts) of the surviving windows whose characters another text has."""
    keep, scan = _keep(length), _scan_texts(length, length // 2, shards, base)
    packed = _narrow(left, alive).mapInArrow(lambda batches: scan(keep(batches)), _TEXTS)
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shards // SHARDS_PER_TASK))
    found = packed.repartition(tasks, "shard").sortWithinPartitions("shard").mapInArrow(_compare_task(length, base), "key bigint, starts array<int>")
    return found.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def _keep(length: int):
    """Texts (key, offset, text, starts) to the parts that hold surviving windows of ``length``, with their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for key, offset, text, starts in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                at = np.unique(np.asarray(starts.values))
                at = at[(at >= offset) & (at <= offset + len(text) - length)]
                if not len(at):
                    continue
                heads = np.flatnonzero(np.concatenate([[True], np.diff(at) > length]))
                for a, b in zip(heads, np.append(heads[1:], len(at)), strict=True):
                    out[0].append(key)
                    out[1].append(int(at[a]))
                    out[2].append(text[at[a] - offset : at[b - 1] - offset + length])
                    out[3].append(at[a:b])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.int32()))], names=["key", "offset", "text", "starts"])

    return run


def _narrow(texts: DataFrame, alive: DataFrame) -> DataFrame:
    """Texts with the surviving positions of their key; texts without any drop out.

    Beyond the broadcast limit texts are moved to their positions, after a filter of bounded pieces has taken out those
    that have none.
    """
    size = alive.agg(F.count("*").alias("n"), F.sum(F.size("starts") * 4 + 40).alias("b")).first()
    if (size["b"] or 0) <= MAX_BROADCAST_BYTES:
        alive = F.broadcast(alive)
    else:
        named = lambda df: df.withColumns({"_set": F.lit(""), "_name": F.col("key").cast("string")})
        filters = bloom.build(named(alive), {"": size["n"]}, "_set", "_name")
        texts = bloom.test(named(texts), "_set", "_name", filters, "_possible").filter("_possible")
    return texts.join(alive, "key").select("key", "offset", "text", "starts")


def shards_for(texts: int) -> int:
    shards = 64
    while shards * TEXTS_PER_SHARD < texts:
        shards *= 2
    return shards


def _levels_below(documents: DataFrame, key: str, text: str, length: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """What is left of the texts (key, offset, text), and the same with the repeated short windows of the level before ``length``."""
    if length < 8 or length >= BLOCK // 2:
        raise ValueError(f"length {length} is not in 8 to {BLOCK // 2}")
    texts = documents.select(F.col(key).cast("bigint").alias("key"), F.lit(0).alias("offset"), F.col(text).alias("text"))
    texts = texts.filter(F.length("text") >= length)
    alive = materialize(repeated(texts.mapInArrow(_scan(length, length // 4, shards), _PACKED), shards), "spans-first")
    left = materialize(_narrow(texts, alive).mapInArrow(_cut(length, length // 4), "key bigint, offset int, text string"), "spans-left")
    alive = materialize(repeated(left.mapInArrow(_scan(length, length // 2, shards), _PACKED), shards), "spans-second")
    return left, _narrow(left, alive)


def shared_windows(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, starts): where the windows of ``length`` begin that another text holds too, character by character; unordered."""
    shards, bases = shards_for(documents.count()), new_bases()
    left, narrowed = _levels_below(documents, key, text, length, shards)
    alive = materialize(repeated(narrowed.mapInArrow(_scan_exactly(length, length, length // 2, shards, bases), _PACKED), shards), "spans-alive")
    return _verified(left, alive, length, shards, bases[0])


def longest_levels(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, longest_level) of the texts that share anything: the greatest of L, 2L, 4L, ... at which they share a window.

    A window of twice the length is a candidate if both its halves are repeated. Each level reads what the one before
    has left; the loop ends with the first level at which nothing is repeated.
    """
    shards = shards_for(documents.count())
    left = materialize(_levels_below(documents, key, text, length, shards)[1], "level-left")
    packed = left.mapInArrow(_scan_exactly(length, length, length // 2, shards, new_bases()), _PACKED)
    found, level = None, length
    while True:
        alive = materialize(repeated(packed, shards), f"level-{level}")
        own = alive.select("key", F.lit(level).alias("longest_level"))
        found = own if found is None else found.unionByName(own)
        if not alive.limit(1).count():
            break
        left = materialize(_narrow(left.drop("starts"), alive).mapInArrow(_keep(level), "key bigint, offset int, text string, starts array<int>"), "level-left")
        level *= 2
        packed = left.mapInArrow(_scan_exactly(length, level, None, shards, new_bases()), _PACKED)
    return found.groupBy(F.col("key").alias(key)).agg(F.max("longest_level").alias("longest_level"))


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, begin, end = [], [], []
            for key, starts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at = np.unique(np.asarray(starts.values))
                heads = np.flatnonzero(np.concatenate([[True], np.diff(at) > length]))
                begin.append(at[heads])
                end.append(at[np.append(heads[1:], len(at)) - 1] + length)
                keys.append(np.full(len(heads), key, np.int64))
            if keys:
                columns = [pa.array(np.concatenate(keys), pa.int64()), pa.array(np.concatenate(begin), pa.int32()), pa.array(np.concatenate(end), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "span_start", "span_end"])

    return run


def shared_spans(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, span_start, span_end): the maximal runs of shared characters of each text."""
    found = shared_windows(documents, key, text, length).mapInArrow(_runs(length), "key bigint, span_start int, span_end int")
    return found.withColumnRenamed("key", key)


def shared_shares(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_chars, shared_chars, share) of every text; null texts have null characters and share."""
    spans = shared_spans(documents, key, text, length)
    shared = spans.groupBy(key).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared_chars"))
    sized = documents.select(key, F.length(text).cast("bigint").alias("n_chars")).join(shared, key, "left")
    count = F.coalesce("shared_chars", F.lit(0).cast("bigint"))
    return sized.select(key, "n_chars", count.alias("shared_chars"), F.when(F.col("n_chars") > 0, count / F.col("n_chars")).alias("share"))

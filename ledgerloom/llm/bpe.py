"""Byte-level BPE as numpy: whole texts to the token ids of a public vocabulary.

A batch of texts becomes one array of code points. Splitting is a few array passes: characters are classed by a lookup
table, and the pattern's alternatives reduce to rules about runs of a class and what precedes them. The pieces are
named by a 64-bit polynomial hash of their bytes, checked byte by byte against the piece that the name stands for, so
each distinct piece is merged once per task while its dictionary lasts.

The merging works on length-bucketed padded matrices of token ids. In every round each row merges its leftmost pair of
least rank; pairs are looked up in a hash table of the vocabulary, only the pairs beside a merge are looked up again, and
rows that have no pair left are stored and taken out. Pieces longer than the widest matrix are rows by themselves; there
the least pair comes from a heap, because a round of a matrix costs the whole row.

Defined results: null and empty texts give the empty list; text that looks like a special token is plain text; texts of
any length are encoded whole; equal texts get equal lists.
"""

from __future__ import annotations

import heapq
import json
import os
import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd

#: Code points of texts that are handled together; arrays of this size stay in the cache.
CHUNK = 1 << 18
#: Distinct pieces that a task remembers.
REMEMBERED_PIECES = 400_000
#: Widths of the padded matrices; longer pieces are merged one by one.
WIDTHS = (4, 6, 8, 12, 16, 24, 32, 64, 128)
#: Cells of a matrix, so that it stays small beside the batch.
MATRIX_CELLS = 1 << 20
NO_RANK = np.int32(2**31 - 1)

OTHER, LETTER, DIGIT, SPACE = 0, 1, 2, 3
#: The endings after an apostrophe that the vocabulary's pattern splits off.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: The code points that the pattern counts as white space (Unicode White_Space).
WHITE = [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]

_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokenizer_file(name: str = "byte_bpe_50k.json", path: str | None = None) -> str:
    """Where the vocabulary is: ``path``, or the folder in LEDGERLOOM_TOKENIZERS, or /opt/tokenizers."""
    return path or os.path.join(os.environ.get("LEDGERLOOM_TOKENIZERS", "/opt/tokenizers"), name)


def character_classes() -> np.ndarray:
    """The class of every code point, by its general category. Planes 4 to 16 hold no letters and digits."""
    first = {"L": LETTER, "N": DIGIT}
    classes = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    classes[: 4 << 16] = np.fromiter((first.get(unicodedata.category(chr(c))[0], OTHER) for c in range(4 << 16)), dtype=np.uint8, count=4 << 16)
    classes[WHITE] = SPACE
    return classes


def byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself if it is one, else 256 and following."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Merges and ids of a byte-level BPE file, with the pairs in an open-addressing hash table."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.zeros(256, np.int32)
        for letter, byte in byte_letters().items():
            self.byte_ids[byte] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._fill((left << np.uint64(32)) | right, merged)
        #: The pairs as a dictionary, made for the first long row: (rank, id) by pair.
        self.pairs: dict[int, tuple[int, int]] | None = None

    def _fill(self, keys: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1), np.uint64)
        self.slot_rank = np.full(size, NO_RANK, np.int32)
        self.slot_id = np.full(size, -1, np.int32)
        waiting, at = np.arange(len(keys)), self._slot(keys)
        self.probes = 0
        while len(waiting):
            self.probes += 1
            free = self.keys[at] == np.uint64(2**64 - 1)
            # of those that want the same free slot, the first gets it
            _, firsts = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[firsts]
            self.keys[at[chosen]] = keys[waiting[chosen]]
            self.slot_rank[at[chosen]] = waiting[chosen]
            self.slot_id[at[chosen]] = merged[waiting[chosen]]
            left = np.ones(len(waiting), bool)
            left[chosen] = False
            waiting, at = waiting[left], (at[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _BASE) >> np.uint64(64 - self.bits)).astype(np.int64)

    def slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, or -1. Negative ids are padding and in no pair."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64)
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, at, -1)
        open_ = np.flatnonzero((found != keys) & (found != np.uint64(2**64 - 1)))
        size = len(self.keys)
        while len(open_):
            at[open_] = (at[open_] + 1) & (size - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        out[(left < 0) | (right < 0)] = -1
        return out

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, id) of each pair's merge."""
        at = self.slots(left.ravel(), right.ravel()).reshape(left.shape)
        return np.where(at >= 0, self.slot_rank[at], NO_RANK), self.slot_id[at]

    def merge_matrix(self, ids: np.ndarray, names: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge every row of a padded (-1) matrix to the end: (names, matrix of tokens), in groups of rows."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, new = self.lookup(ids[:, :-1], ids[:, 1:])
        while len(ids) and rank.shape[1]:
            where = rank.argmin(axis=1)
            rows = np.arange(len(ids))
            going = rank[rows, where] != NO_RANK
            if not going.all():
                done.append((names[~going], ids[~going]))
                ids, rank, new, names, where = ids[going], rank[going], new[going], names[going], where[going]
                rows = rows[: len(ids)]
            if not len(ids):
                break
            # every row loses one token and one pair, so the matrices stay rectangular and get narrower
            ids[rows, where] = new[rows, where]
            keep = np.ones(ids.shape, bool)
            keep[rows, where + 1] = False
            ids = ids[keep].reshape(len(ids), -1)
            keep = np.ones(rank.shape, bool)
            keep[rows, where] = False
            rank, new = rank[keep].reshape(len(ids), -1), new[keep].reshape(len(ids), -1)
            for beside in (where - 1, where):
                inside = np.flatnonzero((beside >= 0) & (beside < rank.shape[1]))
                at = beside[inside]
                rank[inside, at], new[inside, at] = self.lookup(ids[inside, at], ids[inside, at + 1])
        if len(ids):
            done.append((names, ids))
        return done

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row: the pair of least rank, the leftmost of equals, again and again, from a heap.

        A merge looks up only the two pairs beside it, so the work is that of sorting the row's pairs.
        """
        if self.pairs is None:
            filled = np.flatnonzero(self.keys != np.uint64(2**64 - 1))
            self.pairs = dict(zip(self.keys[filled].tolist(), zip(self.slot_rank[filled].tolist(), self.slot_id[filled].tolist(), strict=True), strict=True))
        pairs, tokens, n = self.pairs, ids.tolist(), len(ids)
        rank, _ = self.lookup(ids[:-1], ids[1:])
        at = np.flatnonzero(rank != NO_RANK)
        # an entry is (rank, place); it is outdated unless the pair at its place still has that rank
        heap = ((rank[at].astype(np.int64) << 40) | at).tolist()
        heapq.heapify(heap)
        place, before, after = (1 << 40) - 1, list(range(-1, n - 1)), [*range(1, n), -1]
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            k = entry & place
            left, right = tokens[k], after[k]
            if left < 0 or right < 0:
                continue
            found = pairs.get((left << 32) | tokens[right])
            if found is None or found[0] != entry >> 40:
                continue
            tokens[k], tokens[right] = found[1], -1
            beyond = after[right]
            after[k] = beyond
            if beyond >= 0:
                before[beyond] = k
                found = pairs.get((tokens[k] << 32) | tokens[beyond])
                if found is not None:
                    push(heap, (found[0] << 40) | k)
            behind = before[k]
            if behind >= 0:
                found = pairs.get((tokens[behind] << 32) | tokens[k])
                if found is not None:
                    push(heap, (found[0] << 40) | behind)
        out = np.array(tokens, np.int32)
        return out[out >= 0]

    def merge_pieces(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of all pieces one after the other, number of tokens of each); pieces are slices of ``data``."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for width in WIDTHS:
            mine = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for part in np.array_split(mine, max(1, len(mine) * width // MATRIX_CELLS)):
                index = starts[part][:, None] + np.arange(width)[None, :]
                inside = np.arange(width)[None, :] < lengths[part][:, None]
                ids = np.where(inside, self.byte_ids[data[np.where(inside, index, 0)]], np.int32(-1))
                done += self.merge_matrix(ids, part)
        for k in np.flatnonzero(lengths > low):
            done.append((np.array([k]), self.merge_long(self.byte_ids[data[starts[k] : starts[k] + lengths[k]]])[None, :]))
        counts = np.zeros(len(starts), np.int64)
        for names, ids in done:
            counts[names] = (ids >= 0).sum(axis=1)
        ends = np.cumsum(counts)
        tokens = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for names, ids in done:
            inside = ids >= 0
            tokens[(ends[names] - counts[names])[:, None].repeat(ids.shape[1], 1)[inside] + np.arange(ids.shape[1])[None, :].repeat(len(ids), 0)[inside]] = ids[inside]
        return tokens, counts


def piece_starts(points: np.ndarray, classes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces begin, in an array of code points that holds several texts, which begin at ``firsts``."""
    n = len(points)
    kind = classes[points]
    begins = np.zeros(n, bool)
    begins[firsts] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= begins
    white = kind == SPACE
    start = change.copy()
    # a blank right before a run of another kind belongs to that run; any other last white character stands alone
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~begins[1:]
    start |= last
    joined = np.zeros(n, bool)
    joined[1:] = last[:-1] & (points[:-1] == 32)
    start &= ~joined
    # an apostrophe alone, not after a blank, splits off an ending from the letters that follow
    quote = np.flatnonzero((points[:-1] == 39) & change[:-1] & ~joined[:-1] & (kind[1:] == LETTER) & ~begins[1:]) if n > 1 else np.empty(0, np.int64)
    if len(quote):
        second = points[quote + 1]
        has_two = quote + 2 < n
        third = np.where(has_two, points[np.minimum(quote + 2, n - 1)], 0)
        third = np.where(has_two & ~begins[np.minimum(quote + 2, n - 1)], third, 0)
        taken = np.zeros(len(quote), np.int64)
        for ending in ENDINGS:
            match = second == ord(ending[0])
            if len(ending) == 2:
                match &= third == ord(ending[1])
            taken[(taken == 0) & match] = len(ending)
        hit = taken > 0
        start[quote[hit] + 1] = False
        after = quote[hit] + 1 + taken[hit]
        after = after[after < n]
        start[after] = True
    return np.flatnonzero(start)


def utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of code points, and where each code point's bytes begin (with the total at the end)."""
    widths = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(widths, out=at[1:])
    return np.frombuffer(points.tobytes().decode("utf-32-le").encode("utf-8"), np.uint8), at


@dataclass
class Pieces:
    """Distinct pieces: their bytes one after the other, where each begins (with the end), and their names."""

    data: np.ndarray
    at: np.ndarray
    names: np.ndarray

    def __len__(self) -> int:
        return len(self.names)


def distinct_pieces(data: np.ndarray, low: np.ndarray, high: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, Pieces]:
    """The number of each slice ``low:high`` of ``data`` among the distinct ones, and these in order of appearance.

    Slices of one name are compared byte by byte with the first of them; if two differ, slices are told apart by their
    bytes instead.
    """
    lengths = high - low
    codes, distinct = pd.factorize(names)
    first = np.empty(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    leader = first[codes]
    same = bool((lengths == lengths[leader]).all())
    if same:
        ends = np.cumsum(lengths)
        own = np.repeat(low - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        same = bool((data[own + np.repeat(low[leader] - low, lengths)] == data[own]).all())
    if not same:
        raw = data.tobytes()
        codes, slices = pd.factorize(np.array([raw[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)], object))
        first = np.empty(len(slices), np.int64)
        first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    ends = np.cumsum(lengths[first])
    index = np.repeat(low[first] - (ends - lengths[first]), lengths[first]) + np.arange(int(ends[-1]) if len(ends) else 0)
    return codes, Pieces(data[index], np.concatenate([[0], ends]), names[first])


class Encoder:
    """Encodes batches of texts; remembers the pieces it has met."""

    def __init__(self, path: str | None = None):
        self.vocabulary = Vocabulary(tokenizer_file(path=path))
        self.classes = character_classes()
        self._powers(CHUNK * 2)
        self._forget()

    def _powers(self, n: int) -> None:
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        self.power, self.inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_BASE, inverse))

    def _forget(self) -> None:
        self.known = Pieces(np.empty(0, np.uint8), np.zeros(1, np.int64), np.empty(0, np.uint64))
        self.tokens = np.empty(0, np.int32)
        self.counts = np.empty(0, np.int64)

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin, with the total at the end)."""
        parts, counted, part, size = [], [], [], 0
        for text in texts:
            text = text or ""
            if part and size + len(text) > CHUNK:
                parts.append(self._split(part, counted))
                part, size = [], 0
            part.append(text)
            size += len(text)
        if part:
            parts.append(self._split(part, counted))
        # the remembered pieces come first, so their numbers stay
        if len(self.known) > REMEMBERED_PIECES:
            self._forget()
        before = len(self.known)
        every = [self.known, *(p for _, p in parts)]
        shift = np.cumsum([0, *[len(p.data) for p in every]])
        low = np.concatenate([p.at[:-1] + s for p, s in zip(every, shift, strict=False)])
        high = np.concatenate([p.at[1:] + s for p, s in zip(every, shift, strict=False)])
        codes, self.known = distinct_pieces(np.concatenate([p.data for p in every]), low, high, np.concatenate([p.names for p in every]))
        tokens, counts = self.vocabulary.merge_pieces(self.known.data, self.known.at[before:-1], np.diff(self.known.at)[before:])
        self.tokens, self.counts = np.concatenate([self.tokens, tokens]), np.concatenate([self.counts, counts])
        begins = np.cumsum(self.counts) - self.counts
        out, at = [], before
        sizes = []
        for (numbers, pieces), texts_pieces in zip(parts, counted, strict=True):
            own = codes[at : at + len(pieces)][numbers]
            at += len(pieces)
            counts = self.counts[own]
            ends = np.cumsum(counts)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.tokens[np.repeat(begins[own] - (ends - counts), counts) + np.arange(total)])
            sizes.append(np.diff(np.concatenate([[0], ends])[texts_pieces]))
        lengths = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        return (np.concatenate(out) if out else np.empty(0, np.int32)), np.concatenate([[0], np.cumsum(lengths)])

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text."""
        ids, at = self.encode_flat(texts)
        return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]

    def _split(self, texts: list[str], counted: list[np.ndarray]) -> tuple[np.ndarray, Pieces]:
        """The pieces of some texts: numbers among the distinct ones, and these; ``counted`` gets where texts begin."""
        lengths = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        half = (points >= 0xD800) & (points <= 0xDFFF)
        if half.any():
            points = np.where(half, np.uint32(0xFFFD), points)
        firsts = np.cumsum(lengths) - lengths
        starts = piece_starts(points, self.classes, firsts[lengths > 0]) if len(points) else np.empty(0, np.int64)
        counted.append(np.append(np.searchsorted(starts, firsts), len(starts)))
        data, at = utf8(points)
        low = at[starts]
        high = np.append(low[1:], len(data)) if len(starts) else low
        if len(data) >= len(self.power):
            self._powers(len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=prefix[1:])
        return distinct_pieces(data, low, high, (prefix[high] - prefix[low]) * self.inverse[low])


_ENCODERS: dict[str | None, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The encoder of this process for a vocabulary file; Python workers that Spark reuses keep it."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]

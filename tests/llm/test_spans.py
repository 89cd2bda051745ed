"""Shared spans against comparing all windows."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from ledgerloom.llm import spans


def brute(rows, length):
    where = defaultdict(set)
    for key, text in rows:
        for i in range(len(text or "") - length + 1):
            where[text[i : i + length]].add(key)
    out = set()
    for key, text in rows:
        at = [i for i in range(len(text or "") - length + 1) if len(where[text[i : i + length]]) > 1]
        run = None
        for i in at:
            if run and i <= run[1]:
                run[1] = i + length
            else:
                if run:
                    out.add((key, *run))
                run = [i, i + length]
        if run:
            out.add((key, *run))
    return out


def found(spark, rows, length):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS key", "'x' AS starts", "2 AS offset")
    got = [tuple(r) for r in spans.shared_spans(frame, length=length).collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed: int, n: int, length: int):
    rng = random.Random(seed)
    letters = ["ab", "abcdefgh ", "aé日🙂"][seed % 3]
    make = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [make(rng.randrange(length - 3, 3 * length)) for _ in range(6)] + ["=" * (2 * length), "ab" * length]
    rows = [(0, None), (1, ""), (2, "=" * (length - 1))]
    for k in range(3, n):
        parts = [make(rng.randrange(0, 2 * length)) if rng.random() < 0.6 else rng.choice(shared) for _ in range(rng.randrange(1, 6))]
        text = "".join(parts)
        rows.append((k, text[rng.randrange(0, 5) :]))
    return rows


@pytest.mark.parametrize(("seed", "length"), [(0, 40), (1, 40), (2, 33), (4, 200)])
def test_against_all_windows(spark, seed, length):
    rows = corpus(seed, 60, length)
    assert found(spark, rows, length) == brute(rows, length)


def test_the_test_data(spark, data):
    for directory in (data, data.replace("0.001", "0.01")):
        t = pq.read_table(f"{directory}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
        got = {tuple(r) for r in spans.shared_spans(spark.read.parquet(f"{directory}/documents.parquet")).collect()}
        assert got == brute(list(zip(t["doc_id"], t["text"], strict=True)), 200)


def test_texts_beyond_a_block(spark, monkeypatch):
    monkeypatch.setattr(spans, "BLOCK", 1 << 10)
    rng = random.Random(5)
    big = "".join(rng.choice("abcdefghij") for _ in range(5000))
    rows = [(1, big), (2, "x" * 77 + big[900:3300] + "y"), (3, big[4990:] + "z" * 300)]
    frame = spark.createDataFrame(rows, "key bigint, text string").selectExpr("key", "0 AS offset", "text")
    # the blocks alone: every window once
    seen = set()
    for points, owner, begins, shift in spans.blocks([1, 2, 3], [0, 0, 0], [r[1] for r in rows], 200):
        starts, part = spans.starts_that_fit(len(points), begins, 200)
        for s, p in zip(starts, part, strict=True):
            place = (int(owner[p]), int(s - begins[p] + shift[p]))
            assert place not in seen and points[s : s + 200].tobytes().decode("utf-32-le") == rows[place[0]][1][place[1] : place[1] + 200]
            seen.add(place)
    assert len(seen) == sum(len(t) - 199 for _, t in rows)
    assert frame.count() == 3


def test_long_text(spark):
    rng = random.Random(6)
    big = "".join(rng.choice("abcdefghij") for _ in range(600_000))
    rows = [(1, big), (2, "x" * 77 + big[262_000:262_500] + "y"), (3, big[-200:])]
    assert found(spark, rows, 200) == {(1, 262_000, 262_500), (2, 77, 577), (1, 599_800, 600_000), (3, 0, 200)}


def test_edges(spark):
    same = "".join(random.Random(7).choice("abc ") for _ in range(300))
    assert found(spark, [(1, same), (2, same)], 200) == {(1, 0, 300), (2, 0, 300)}
    assert found(spark, [(1, same + same)], 200) == set()  # within one text only
    assert found(spark, [(1, same), (1, same)], 200) == set()  # one key twice is one text
    assert found(spark, [(1, same[:199]), (2, same[:199])], 200) == set()
    assert found(spark, [(1, None), (2, "")], 200) == set()
    assert found(spark, [], 200) == set()
    with pytest.raises(ValueError):
        found(spark, [], 3)


def test_one_passage_in_a_third_of_all_texts(spark):
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    hot = make(250)
    rows = [(k, make(100) + (hot if k % 3 == 0 else make(250)) + make(50)) for k in range(600)]
    # chance neighbours of the passage may be shared too
    got = found(spark, rows, 200)
    assert got == brute(rows, 200) and {k for k, a, b in got if a <= 100 and b >= 350} == set(range(0, 600, 3))


def test_shares(spark):
    same = "".join(random.Random(9).choice("abc ") for _ in range(300))
    frame = spark.createDataFrame([(1, same + "x" * 100), (2, same), (3, None), (4, ""), (5, "short")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_chars, r.shared_chars, r.share) for r in spans.shared_shares(frame).collect()}
    assert got == {1: (400, 300, 0.75), 2: (300, 300, 1.0), 3: (None, 0, None), 4: (0, 0, None), 5: (5, 0, 0.0)}


def test_the_second_hash_decides():
    hashes, keys, positions = np.array([5, 5, 7, 7], np.uint64), np.array([1, 2, 3, 4]), np.array([0, 0, 9, spans.MARKER], np.int32)
    assert spans.shared_rows(hashes, hashes, keys, positions)[0].tolist() == [True] * 4
    assert spans.shared_rows(hashes, np.array([1, 2, 3, 3], np.uint64), keys, positions)[0].tolist() == [False, False, True, True]


def thue_morse(n: int) -> str:
    """Two such texts, one with its letters exchanged, have the same hash modulo a power of two for any odd base."""
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text


@pytest.mark.parametrize("length", [512, 1024, 2048])
def test_texts_that_no_hash_modulo_a_power_of_two_tells_apart(spark, length):
    one = thue_morse(length)
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, "x" * 10 + one + "y" * length), (2, "z" * 10 + other + "w" * length), (3, "q" * 99 + one)]
    assert found(spark, rows, length) == {(1, 10, 10 + length), (3, 99, 99 + length)}


@pytest.mark.parametrize("blind", [False, True])
def test_characters_decide(blind):
    """Also if all hashes are the same."""
    length, rng = 6, random.Random(2)
    hashing = spans.ExactHasher(12345, 64)
    if blind:
        hashing.windows = lambda prefix, length, at: np.zeros(len(at), np.uint64)
    rows = [(rng.randrange(5), "".join(rng.choice("ab") for _ in range(length - 1 + rng.randrange(1, 9))), rng.random() < 0.05) for _ in range(60)]
    points = np.frombuffer("".join(t for _, t, _ in rows).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) - length + 1 for _, t, _ in rows])
    segment, shared, is_head = spans.compared(points, sizes, np.array([k for k, _, _ in rows]), np.array([m for _, _, m in rows]), length, hashing)
    windows = [(n, t[i : i + length]) for n, (_, t, _) in enumerate(rows) for i in range(len(t) - length + 1)]
    owners, marked = defaultdict(set), defaultdict(bool)
    for n, w in windows:
        owners[w].add(rows[n][0])
        marked[w] |= rows[n][2]
    want = [len(owners[w]) > 1 or marked[w] for _, w in windows]
    assert segment.tolist() == [n for n, _ in windows] and shared.tolist() == want and 0 < sum(want) < len(want)
    assert sorted(w for (_, w), h in zip(windows, is_head, strict=True) if h) == sorted({w for (_, w), x in zip(windows, want, strict=True) if x})


def test_exact_hashes_against_whole_numbers():
    rng, prime = np.random.default_rng(3), 2**61 - 1
    a, b = (rng.integers(0, prime, 2000, dtype=np.uint64) for _ in range(2))
    a[:4], b[:4] = [0, prime - 1, prime - 1, 1], [5, prime - 1, 1, prime - 1]
    assert spans.multiply(a, b).tolist() == [int(x) * int(y) % prime for x, y in zip(a, b, strict=True)]
    base = spans.new_bases()[0]
    hashing, points = spans.ExactHasher(base, 4096), rng.integers(0, 0x110000, 4000).astype(np.uint32)
    at = np.array([0, 1, 17, 3000, 3799])
    got = hashing.windows(hashing.prefix(points), 200, at)
    assert got.tolist() == [sum((int(c) + 1) * pow(base, j, prime) for j, c in enumerate(points[i : i + 200])) % prime for i in at]


def test_texts_moved_to_their_positions(spark, monkeypatch):
    monkeypatch.setattr(spans, "MAX_BROADCAST_BYTES", -1)
    rows = corpus(4, 60, 60)
    assert found(spark, rows, 60) == brute(rows, 60)


def test_many_shards_in_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(spans, "TEXTS_PER_SHARD", 0.2)
    monkeypatch.setattr(spans, "FLUSH_POINTS", 100)
    rows = corpus(0, 60, 40)
    assert spans.shards_for(60) == 512 and found(spark, rows, 40) == brute(rows, 40)


def test_longest_levels(spark):
    rng = random.Random(11)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passages = [make(n) for n in (50, 79, 80, 160, 700, 3000)]
    rows = [(k, make(40) + p + make(30)) for p in passages for k in (passages.index(p), passages.index(p) + 10)] + [(30, None), (31, make(500))]
    want = {}
    level = 40
    while True:
        keys = {k for k, *_ in brute(rows, level)}
        want |= dict.fromkeys(keys, level)
        if not keys:
            break
        level *= 2
    got = {r.doc_id: r.longest_level for r in spans.longest_levels(spark.createDataFrame(rows, "doc_id bigint, text string"), length=40).collect()}
    assert got == want and got[5] == 2560 and got[0] == 40
    assert spans.longest_levels(spark.createDataFrame(rows[-2:], "doc_id bigint, text string"), length=40).count() == 0


def test_leftmost_minima():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 5, 500).astype(np.uint64) << np.uint64(40)
    for width in (1, 3, 151):
        got = spans.leftmost_minima(hashes, width)
        want = [i + int(np.argmin(hashes[i : i + width])) for i in range(len(hashes) - width + 1)]
        assert got.tolist() == want

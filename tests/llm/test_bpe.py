"""Token ids against the public library, over test data, odd texts and random ones."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import bpe, encode
from ledgerloom.tables import table

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(bpe.tokenizer_file())
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ODD = [
    "", " ", "  ", "\n", " \n ", "\t\t x", "a  b", "a \n b", "x　 y", "don't", "'tis 'twas", "''s", " 's", "\n's", "it'S we'll they've I'd 're'vem", "'", "'l", "'ll", "'llama",
    "<|endoftext|>", "a<|endoftext|>b", "①②Ⅷ½ ४५६", "naïve naïve", "日本語のテキスト", "🙂🙂‍👩‍👧", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "-" * 1000, "ab" * 5000, " " * 3000,
    "x" * 40_000, "é" * 9_000, "1234567890" * 300, "  a", "a\x00b\x1fc", "end ", "end \n", "​‍", "é'́s", "�",
]


def test_odd_texts(public):
    assert bpe.encoder().encode(ODD) == public(ODD)
    assert bpe.encoder().encode([None, ""]) == [[], []]
    # each alone, as neighbours must not matter
    assert [bpe.encoder().encode([t])[0] for t in ODD] == public(ODD)


def test_the_test_data(public, data):
    for directory in (data, data.replace("0.001", "0.01")):
        texts = [t or "" for t in pq.read_table(f"{directory}/documents.parquet", columns=["text"])["text"].to_pylist()]
        assert bpe.encoder().encode(texts) == public(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30) | st.text("ab '\n\tst1.é", max_size=30), max_size=8))
def test_random_texts(public, texts):
    assert bpe.encoder().encode(texts) == public(texts)


def test_the_table_of_pieces_is_renewed(public, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_PIECES", 5)
    own = bpe.Encoder()
    for texts in (ODD[:20], ["some other words entirely"], ODD):
        assert own.encode(texts) == public(texts)


def test_pieces_that_share_a_name(public, monkeypatch):
    monkeypatch.setattr(bpe, "_BASE", bpe.np.uint64(1))
    own = bpe.Encoder()
    texts = ["ab ba", "abc bca cab acb", "the eht"]
    assert own.encode(texts) == public(texts)


def test_long_rows_merge_alike(public):
    texts = ["".join(chr(97 + (k * k) % 7) for k in range(n)) for n in (127, 128, 129, 500)] + ["a" * n for n in range(120, 140)]
    assert bpe.encoder().encode(texts) == public(texts)


def test_very_long_rows(public):
    import random
    import time

    rng = random.Random(4)
    texts = ["".join(rng.choice(letters) for _ in range(60_000)) for letters in ("etaoinshrdlu", "ab", "aé日")] + ["a" * 60_001]
    assert bpe.encoder().encode(texts) == public(texts)
    # a run of a megabyte takes a time in proportion to its length
    began = time.perf_counter()
    bpe.encoder().encode(["".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))])
    assert time.perf_counter() - began < 40


def test_frames(spark, data, public):
    rows = [(1, "a b", 5), (2, None, 6), (3, "", 7), (1, "a b", 5), (4, "<|endoftext|>", 1)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    found = sorted((r.doc_id, r.ids) for r in encode.token_ids(frame).collect())
    assert found == sorted([(1, public(["a b"])[0]), (1, public(["a b"])[0]), (2, []), (3, []), (4, public(["<|endoftext|>"])[0])])
    assert sorted(tuple(r) for r in encode.token_counts(frame).collect())[-2:] == [(3, 0), (4, len(public(["<|endoftext|>"])[0]))]
    assert encode.token_ids(frame.limit(0)).count() == 0
    assert encode.token_ids(table(spark, data, "documents")).count() == table(spark, data, "documents").count()


def test_slices_of_a_batch():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["aa", None, "b" * 10, "c", ""])], names=["k", "t"])
    parts = list(encode.text_slices(batch, 3))
    assert [p.num_rows for p in parts] == [2, 1, 2] and sum((p.column(0).to_pylist() for p in parts), []) == list(range(5))

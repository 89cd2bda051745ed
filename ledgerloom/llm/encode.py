"""Whole tables of texts to token ids, and to sizes in tokens, with Arrow batches of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.bpe import encoder

#: Bytes of text that one task encodes at a time; a longer text is taken alone.
SLICE_BYTES = 24 << 20


def text_slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of (id, text) with at most ``limit`` bytes of text, or one row."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end


def token_ids(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of every text; null and empty texts give the empty list. Equal keys keep their rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in text_slices(batch):
                ids, at = own.encode_flat(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in text_slices(batch):
                _, at = own.encode_flat(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at), pa.int64())], names=[key, "n_tokens"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")

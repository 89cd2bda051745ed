"""A blocked Bloom filter made of DataFrame operations: rows of 4 KB, ten bits a key, tested by a broadcast join.

A key has four bits within one 64-bit word of one block. Building is a map-side-combined ``bit_or`` per word, then the
words of a block become one array; testing is a broadcast hash join on the block and a bit test, inside generated code.
The filter grows with its keys, so it lets the same share of absent keys through at every size. The part of it that is
broadcast at once is bounded: a larger filter is cut into ranges of blocks, the rows to test are written once by range,
and each range is tested against its own piece.

One filter may serve several sets of keys, told apart by a name. Defined results: a null key and a key of a set that the
filter doesn't know are absent; an empty set lets nothing through.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import materialize, scratch_path

#: 64-bit words of a block.
WORDS = 512
BITS_PER_KEY = 10
KEYS_PER_BLOCK = WORDS * 64 // BITS_PER_KEY
#: Bytes of the filter that are broadcast at once: 53 million keys.
MAX_BROADCAST_BYTES = 64 << 20
BLOCK_BYTES = WORDS * 8 + 64


@dataclass(frozen=True)
class Filter:
    """``table`` (block, words); set ``name`` has ``sets[name][1]`` blocks from number ``sets[name][0]`` on."""

    table: DataFrame
    sets: dict[str, tuple[int, int]]

    @property
    def blocks(self) -> int:
        return sum(count for _, count in self.sets.values())


def _places(sets: dict[str, tuple[int, int]], name: Column, key: Column) -> Column:
    """The block of a key, null for an unknown set."""
    digest = F.xxhash64(key)
    return F.coalesce(*[F.when(name == n, F.pmod(digest, F.lit(count)) + F.lit(first)) for n, (first, count) in sets.items()])


def _word_and_mask(key: Column) -> tuple[Column, Column]:
    """The word within the block and the key's four bits in it, from a hash that the block number doesn't use."""
    digest = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, F.shiftrightunsigned(digest, shift).bitwiseAND(F.lit(63)).cast("int")) for shift in (9, 15, 21, 27)]
    return digest.bitwiseAND(F.lit(WORDS - 1)).cast("int"), reduce(lambda a, b: a.bitwiseOR(b), bits)


def build(keys: DataFrame, counts: dict[str, int], name: str = "part", key: str = "key") -> Filter:
    """The filter of the non-null keys; ``counts`` says how many keys each set has (it need not be exact)."""
    sets, first = {}, 0
    for part, n in counts.items():
        sets[part] = (first, max(1, -(-n // KEYS_PER_BLOCK)))
        first += sets[part][1]
    word, mask = _word_and_mask(F.col(key))
    placed = keys.filter(F.col(key).isNotNull()).select(_places(sets, F.col(name), F.col(key)).alias("block"), word.alias("word"), mask.alias("bits")).filter("block IS NOT NULL")
    # every word exists, so that a word's place in the array is its number
    empty = keys.sparkSession.range(first * WORDS).select(F.call_function("div", "id", F.lit(WORDS)).alias("block"), F.pmod("id", F.lit(WORDS)).cast("int").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = placed.unionByName(empty).groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))
    table = words.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return Filter(materialize(table.select("block", F.col("words.bits").alias("words")), "bloom"), sets)


def test(rows: DataFrame, name: str, key: str, filters: Filter, into: str) -> DataFrame:
    """``rows`` with the boolean column ``into``: false means that the key is certainly absent."""
    spark = rows.sparkSession
    word, mask = _word_and_mask(F.col(key))
    hit = F.coalesce(F.get("_words", word).bitwiseAND(mask) == mask, F.lit(False))
    keyed = rows.withColumn("_probe", F.when(F.col(key).isNotNull(), _places(filters.sets, F.col(name), F.col(key))))
    table = filters.table.select(F.col("block").alias("_probe"), F.col("words").alias("_words"))

    def tested(part: DataFrame, piece: DataFrame) -> DataFrame:
        return part.join(F.broadcast(piece), "_probe", "left").withColumn(into, hit).select(*rows.columns, into)

    in_piece = MAX_BROADCAST_BYTES // BLOCK_BYTES
    pieces = -(-filters.blocks // in_piece)
    if pieces == 1:
        return tested(keyed, table)
    path = scratch_path(spark, "by-range")
    ranged = keyed.withColumn("_range", F.coalesce(F.call_function("div", "_probe", F.lit(in_piece)), F.lit(0)).cast("int"))
    ranged.write.option("compression", "zstd").partitionBy("_range").parquet(path)
    written = spark.read.schema(ranged.schema).parquet(path)
    parts = [tested(written.filter(F.col("_range") == p).drop("_range"), table.filter(F.col("_probe").between(p * in_piece, (p + 1) * in_piece - 1))) for p in range(pieces)]
    return reduce(DataFrame.unionByName, parts)

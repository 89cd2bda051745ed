"""Messages delivered more than once: exact identifier dictionary, sharded seen-bitmaps, one arrival per unseen bit.

An identifier is encoded exactly: its shard is a hash of it, its code a dense number within the shard, kept in a
dictionary that only grows. What has been delivered is one bit per code in fixed-width bitmaps by shard and bucket.
A batch selects, for each identifier whose bit is not set, its least arrival; then its codes and the united bits become
a new version. A version holds only its new dictionary entries and the buckets that it changed; its entry in the commit
log names the folders that make up the state, and is written last and exclusively. So a run that dies leaves nothing
behind that a reader sees, and of two runs that started from one version the second to commit fails, with its codes.
Every 16th version writes the whole state into one folder; what it replaces is removed one version later.

The state's number of shards is fixed by its first version and kept in the log; another number is refused.

Which rows are redundant needs only the identifiers that repeat. These are broadcast if their measured size is under a
limit; else a filter of fixed size leaves the rows that can have such an identifier, and only those are joined by
shuffle, where AQE splits a hot identifier.

Defined results: an identifier is compared without blanks at its ends and without case; a row without any identifier
and without coordinates is a message of its own; ties in the arrival number cannot occur for distinct rows, and equal
rows (same arrival number) are kept or dropped together; a row with nothing to tell it by is kept; an empty batch selects nothing; other columns are carried
through untouched under their own names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.commits import CommitLog
from ledgerloom.operators import bloom
from ledgerloom.session import materialize, scratch_path
from ledgerloom.tables import clean_id

#: Identifiers a shard should hold; a shard's codes are numbered by one task.
IDS_PER_SHARD = 1 << 20
#: Shards of a state that is made to last: good for a thousand million identifiers at ``IDS_PER_SHARD``.
LASTING_SHARDS = 1 << 10
#: Versions between two that hold the whole state.
COMPACT_EVERY = 16
#: Bytes of repeating identifiers that may be broadcast.
MAX_BROADCAST_BYTES = 32 << 20
COORDINATES = ("source_topic", "source_partition", "source_offset", "leader_epoch")

_DICTIONARY = "shard int, code bigint, key string"
_BITMAPS = "shard int, bucket bigint, bits binary"
_OUTCOME = "key string, arrival bigint, n bigint, shard int, code bigint, is_new boolean"


def message_key(id_columns: tuple[str, ...], coordinates: tuple[str, ...] = COORDINATES, arrival: str = "delivery_id") -> Column:
    """The identifier of a row: the first id column that holds an id, else the broker coordinates together.

    Ids and coordinates are kept apart by a prefix; a null coordinate equals only a null one.
    """
    ids = [F.concat(F.lit("i:"), clean_id(c)) for c in id_columns]
    texts = [F.col(c).cast("string") for c in coordinates]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    known = F.coalesce(*texts).isNotNull()
    own = F.concat(F.lit("r:"), F.col(arrival).cast("string"))
    return F.coalesce(*ids, F.when(known, F.concat(F.lit("c:"), F.concat_ws("|", *parts))), own)


def _bit_is_set(bits: str, position: str) -> Column:
    return F.expr(
        f"coalesce((shiftright(cast(conv(hex(substring({bits}, cast({position} div 8 as int) + 1, 1)), 16, 10) as int),"
        f" cast({position} % 8 as int)) & 1) = 1, false)"
    )


def shards_for(identifiers: int) -> int:
    """A power of two such that a shard stays near ``IDS_PER_SHARD``."""
    shards = 8
    while shards * IDS_PER_SHARD < identifiers:
        shards *= 2
    return shards


@dataclass
class SeenStore:
    """Dictionary and seen-bitmaps of one stream, below ``path`` (a folder that all executors share).

    ``shards`` counts for a new state only and must not contradict an old one; without it a new state gets 1,024.
    """

    spark: SparkSession
    path: str
    shards: int | None = None

    def __post_init__(self) -> None:
        self.log = CommitLog(self.spark, self.path)

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return self.log.numbers()

    def state(self, version: int | None = None) -> dict:
        """The entry of a version (default: the newest): version, shards, folders of the state, folders to remove."""
        kept = self.versions() if version is None else [version]
        if not kept:
            return {"version": 0, "shards": self.shards or LASTING_SHARDS, "folders": [], "replaced": []}
        found = self.log.read(kept[-1])
        if self.shards not in (None, found["shards"]):
            raise ValueError(f"{self.path} has {found['shards']} shards, not {self.shards}")
        return found

    def _read(self, folders: list[str], name: str, schema: str) -> DataFrame | None:
        return self.spark.read.schema(schema).parquet(*[f"{f}/{name}" for f in folders]) if folders else None

    def dictionary(self, state: dict | None = None) -> DataFrame | None:
        return self._read((state or self.state())["folders"], "dictionary", _DICTIONARY)

    def bitmaps(self, state: dict | None = None) -> DataFrame | None:
        """(shard, bucket, bits); a bucket may occur once per folder, its bits are those of all of them."""
        return self._read((state or self.state())["folders"], "bitmaps", _BITMAPS)

    def _encode(self, firsts: DataFrame, state: dict) -> DataFrame:
        """Codes for ``firsts`` (key, arrival, n); identifiers not yet known get the next codes of their shard."""
        keyed = firsts.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(state["shards"])).cast("int"))
        order = Window.partitionBy("shard").orderBy("key")
        known = self.dictionary(state)
        if known is None:
            return keyed.withColumn("code", F.row_number().over(order).cast("bigint")).withColumn("is_new", F.lit(True))
        joined = keyed.join(known.select("shard", "key", "code"), ["shard", "key"], "left")
        base = known.groupBy("shard").agg(F.max("code").alias("base"))
        # one row per shard on either side
        fresh = joined.filter(F.col("code").isNull()).drop("code").join(base, "shard", "left")
        fresh = fresh.withColumn("code", F.row_number().over(order) + F.coalesce("base", F.lit(0))).drop("base")
        return joined.filter(F.col("code").isNotNull()).withColumn("is_new", F.lit(False)).unionByName(fresh.withColumn("is_new", F.lit(True)))

    def apply(self, arrivals: DataFrame) -> DataFrame:
        """Take a batch of (key, arrival): (key, arrival, n, is_unseen) of each identifier in it, with its least arrival.

        ``n`` counts its arrivals. The state has its new version when this returns.
        """
        state = self.state()
        version = state["version"] + 1
        folder = self.log.new_folder()
        # partial aggregation first: of a hot identifier one row per task is shuffled
        firsts = arrivals.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("arrival").alias("arrival"), F.count("*").alias("n"))
        staging = scratch_path(self.spark, "encoded")
        self._encode(firsts, state).write.option("compression", "zstd").parquet(staging)
        encoded = self.spark.read.schema(_OUTCOME).parquet(staging)
        encoded.filter("is_new").select(*[c.split()[0] for c in _DICTIONARY.split(", ")]).write.option("compression", "zstd").parquet(f"{folder}/dictionary")

        placed = encoded.withColumns({"bucket": F.bitmap_bucket_number("code"), "position": F.bitmap_bit_position("code")})
        old = self.bitmaps(state)
        if old is None:
            placed = placed.withColumn("is_unseen", F.lit(True))
        else:
            united = old.groupBy("shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")) if len(state["folders"]) > 1 else old
            placed = placed.join(united, ["shard", "bucket"], "left").withColumn("is_unseen", ~_bit_is_set("bits", "position")).drop("bits")
        fresh = placed.filter("is_unseen").groupBy("shard", "bucket").agg(F.bitmap_construct_agg("position").alias("bits"))
        fresh.write.option("compression", "zstd").parquet(f"{folder}/bitmaps")
        folders, replaced = [*state["folders"], folder], []
        if len(folders) >= COMPACT_EVERY:
            folders, replaced = [self._compact(folders)], folders
        self.log.commit(version, {"version": version, "shards": state["shards"], "folders": folders, "replaced": replaced})
        self.log.remove(state["replaced"])
        return placed.select("key", "arrival", "n", "is_unseen")

    def _compact(self, folders: list[str]) -> str:
        whole = self.log.new_folder()
        self._read(folders, "dictionary", _DICTIONARY).repartition("shard").sortWithinPartitions("shard", "key").write.option("compression", "zstd").parquet(f"{whole}/dictionary")
        bits = self._read(folders, "bitmaps", _BITMAPS).groupBy("shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        bits.write.option("compression", "zstd").parquet(f"{whole}/bitmaps")
        return whole

    def select(self, arrivals: DataFrame) -> DataFrame:
        """(key, arrival): one arrival per message of the batch that was not seen before."""
        return self.apply(arrivals).filter("is_unseen").select("key", "arrival")


def _redundant(df: DataFrame, key: Column, arrival: str, store: SeenStore | None, carry: list[str]) -> DataFrame:
    """(carry) of the rows that are not the selected arrival of their identifier."""
    spark = df.sparkSession
    if store is None:
        store = SeenStore(spark, scratch_path(spark, "seen"), shards_for(df.count()))
    rows = df.select(key.alias("_key"), *carry)
    outcome = store.apply(rows.select(F.col("_key").alias("key"), F.col(arrival).alias("arrival")))
    repeats = outcome.filter((F.col("n") > 1) | ~F.col("is_unseen"))
    repeats = materialize(repeats.select(F.col("key").alias("_key"), F.when(F.col("is_unseen"), F.col("arrival")).alias("_kept")), "repeats")
    size = repeats.agg(F.count("*").alias("n"), F.sum(F.octet_length("_key") + 40).alias("b")).first()
    if (size["b"] or 0) <= MAX_BROADCAST_BYTES:
        joined = rows.join(F.broadcast(repeats), "_key")
    else:
        found = bloom.test(rows.withColumn("_part", F.lit("")), "_part", "_key", bloom.build(repeats.select(F.lit("").alias("part"), F.col("_key").alias("key")), {"": size["n"]}), "_possible")
        joined = found.filter("_possible").drop("_possible", "_part").join(repeats, "_key")
    return joined.filter(F.col("_kept").isNull() | (F.col(arrival) != F.col("_kept"))).select(*carry)


def redundant_rows(df: DataFrame, key: Column, arrival: str = "delivery_id", store: SeenStore | None = None) -> DataFrame:
    """The arrival numbers of the rows that repeat a message: all but the selected arrival of each message not seen before."""
    return _redundant(df, key, arrival, store, [arrival])


def unique_rows(df: DataFrame, key: Column, arrival: str = "delivery_id", store: SeenStore | None = None) -> DataFrame:
    """One row per message not seen before, with all columns of ``df``."""
    dropped = materialize(_redundant(df, key, arrival, store, [arrival]).distinct(), "redundant")
    if dropped.count() * 16 <= MAX_BROADCAST_BYTES:
        dropped = F.broadcast(dropped)
    # on the arrival number, which no hot message can skew
    return df.join(dropped, arrival, "left_anti").select(*df.columns)

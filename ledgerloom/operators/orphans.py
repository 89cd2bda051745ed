"""References to records that do not exist, as of the end of the day on which the reference arrived.

A Bloom filter over the ids of all parent tables is broadcast in pieces of bounded size; it proves most missing
references without moving them. Only the references that pass it are joined exactly, with one row per parent id: the
first day whose end sees the parent, and the day intervals in which it counts as deleted. Deletions are reduced to whole days before they are collected, so a
parent's list is bounded by the days of the data, however often one record was deleted.

Defined results: ids are compared without blanks at their ends and without case; a null, empty or blank reference is no
reference; a reference without an arrival instant is judged at the end of all time and has a null day; a parent without
an arrival instant never arrives; a deletion without an instant has no effect; empty tables give all references as
dangling, or no rows at all; other columns of the tables are never read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import bloom
from ledgerloom.session import materialize, scratch_path
from ledgerloom.tables import clean_id, day_text, utc_day

#: The end of all time, as a day number.
NEVER = 2_000_000_000


@dataclass(frozen=True)
class Reference:
    """Column ``field`` of ``child`` holds ids of ``parent``."""

    child: str
    field: str
    parent: str


def collect_references(child: DataFrame, references: Sequence[Reference], key: str, arrived: str) -> DataFrame:
    """One row per non-blank reference of one child table; the table is scanned once for all its fields."""
    cells = F.array(*[F.struct(F.lit(r.child).alias("ref_table"), F.lit(r.field).alias("ref_field"), F.lit(r.parent).alias("parent"), clean_id(r.field).alias("target")) for r in references])
    rows = child.select(F.col(key).cast("bigint").alias("ref_key"), utc_day(arrived).alias("day"), F.explode(cells).alias("cell"))
    return rows.filter(F.col("cell.target").isNotNull()).select("cell.*", "ref_key", "day")


def find_orphans(references: DataFrame, parents: dict[str, DataFrame], deletions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all references, the dangling ones), both (ref_table, ref_field, ref_key, day), of ``collect_references``.

    The references are tested in one pass and written once, apart by its outcome: what the filter rules out is proven
    there and then, and only the rest is read again to be joined.
    """
    spark = references.sparkSession
    known = materialize(presence(parents, deletions), "presence")
    counts = {r.parent: r.n for r in known.groupBy("parent").agg(F.count("*").alias("n")).collect()}
    filters = bloom.build(known, {name: counts.get(name, 0) for name in parents}, "parent", "target")
    path = scratch_path(spark, "tested")
    tested = bloom.test(references, "parent", "target", filters, "possible")
    tested.write.option("compression", "zstd").partitionBy("possible").parquet(path)
    tested = spark.read.schema(tested.schema).parquet(path)
    out = ["ref_table", "ref_field", "ref_key", "day"]
    joined = tested.filter("possible").join(known, ["parent", "target"], "left")
    end = F.coalesce("day", F.lit(NEVER))
    absent = F.col("first_end").isNull() | (F.col("first_end") > end)
    deleted = F.coalesce(F.exists("gaps", lambda g: (g["since"] <= end) & (g["until"] >= end)), F.lit(False))
    verified = joined.filter(absent | deleted).select(out)
    return tested.select(out), tested.filter(~F.col("possible")).select(out).unionByName(verified)


def presence(parents: dict[str, DataFrame], deletions: DataFrame) -> DataFrame:
    """(parent, target, first_end, gaps) of the parents that arrived; ``gaps`` is null without deletions.

    Day numbers stand for the ends of days: an instant before the end of day d has a day number of d or less. A record
    is gone at the end of day d if it was deleted on d or before and was not restored on d or before.
    """
    keys = ["parent", "target"]
    each = [df.select(F.lit(name).alias("parent"), clean_id("id").alias("target"), utc_day("loaded_at").alias("day")) for name, df in parents.items()]
    arrived = reduce(DataFrame.unionByName, each).filter(F.col("target").isNotNull() & F.col("day").isNotNull())
    first = arrived.groupBy(*keys).agg(F.min("day").alias("first_end"))
    back = F.coalesce(utc_day("restored_at") - 1, F.lit(NEVER))
    gone = deletions.select(F.col("table_name").alias("parent"), clean_id("record_id").alias("target"), utc_day("deleted_at").alias("since"), back.alias("until"))
    gone = gone.filter(F.col("target").isNotNull() & F.col("since").isNotNull() & (F.col("until") >= F.col("since")))
    by_day = gone.groupBy(*keys, "since").agg(F.max("until").alias("until"))
    return first.join(by_day.groupBy(*keys).agg(F.collect_list(F.struct("since", "until")).alias("gaps")), keys, "left")


def count_by_day(references: DataFrame, dangling: DataFrame) -> DataFrame:
    """References and dangling ones per table, field and day; aggregated before anything is joined."""
    keys = ["ref_table", "ref_field", "day"]
    every = references.groupBy(keys).agg(F.count("*").alias("n_references"), F.lit(0).cast("bigint").alias("n_dangling"))
    bad = dangling.groupBy(keys).agg(F.lit(0).cast("bigint").alias("n_references"), F.count("*").alias("n_dangling"))
    both = every.unionByName(bad).groupBy(keys).agg(F.sum("n_references").alias("n_references"), F.sum("n_dangling").alias("n_dangling"))
    return both.select("ref_table", "ref_field", day_text(F.col("day")).alias("ref_day"), "n_references", "n_dangling")

"""A keyed table in versions: inserts, updates and deletes as batches over Parquet, committed one after the other.

Every version is a folder of its own and an entry in a commit log, so readers see whole versions, and of two writers that
started from one version the second fails and may start again. An append-only table refuses changes of what it holds.

Defined results: of several changes of a key in one batch the greatest by the order counts; a null key is refused; an empty
batch makes a version like the one before; the columns are those of the first version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.commits import CommitLog
from ledgerloom.operators.changes import forbidden_changes
from ledgerloom.operators.snapshot import newest_by
from ledgerloom.session import materialize


class Forbidden(ValueError):
    """A change that the table doesn't take."""


class VersionedTable:
    """The table in ``path`` with the unique column ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, append_only: bool = False):
        self.spark, self.key, self.append_only, self.log = spark, key, append_only, CommitLog(spark, path)

    def version(self) -> int:
        """The newest version, 0 before the first."""
        return max(self.log.numbers(), default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows as of a version (default: the newest), null before the first."""
        number = self.version() if version is None else version
        return self.spark.read.parquet(self.log.read(number)["folder"]) if number else None

    def upsert(self, changes: DataFrame, order: Sequence[str], deleted: Column | None = None) -> int:
        """Inserts new keys and replaces known ones; rows for which ``deleted`` holds take their key out. Gives the version."""
        before = self.version()
        old = self.read(before) if before else None
        columns = old.columns if old is not None else [c for c in changes.columns if c != "_deleted"]
        rows = changes.withColumn("_deleted", F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False)))
        # partial aggregation: of a key with many changes one row per task is shuffled
        newest = materialize(newest_by(rows, self.key, order, [*columns, "_deleted"]), "changes")
        if newest.filter(F.col(self.key).isNull()).limit(1).count():
            raise Forbidden(f"a change has no {self.key}")
        kept = newest.filter(~F.col("_deleted")).select(columns)
        if old is not None:
            if self.append_only:
                self._refuse(old, newest, columns)
            kept = old.join(newest.select(self.key), self.key, "left_anti").select(columns).unionByName(kept)
        folder = self.log.new_folder()
        kept.write.option("compression", "zstd").parquet(folder)
        self.log.commit(before + 1, {"folder": folder})
        return before + 1

    def _refuse(self, old: DataFrame, newest: DataFrame, columns: list[str]) -> None:
        touched = old.join(newest.select(self.key), self.key, "left_semi")
        after = newest.filter(~F.col("_deleted")).select(columns)
        found = forbidden_changes(touched, after, self.key, [c for c in columns if c != self.key])
        counts = {r.change: r.n for r in found.groupBy("change").agg(F.count("*").alias("n")).collect()}
        if counts:
            raise Forbidden(f"append-only: {counts}")

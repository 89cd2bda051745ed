"""A log of commits below a shared folder: what is not in the log was never written, as far as readers are concerned.

A writer puts its data into a folder of its own and then commits a number with a small JSON entry. The entry is written
under another name and renamed without overwriting, so of several writers of one number exactly one succeeds, and an
entry is either whole or absent. HDFS renames atomically; on a local disk the check and the rename are two steps of one
call; an object store needs a committer that refuses to overwrite.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


class AlreadyCommitted(RuntimeError):
    """Another writer has committed this number."""


@dataclass
class CommitLog:
    """Numbered entries in ``path``; numbers are given by the writers."""

    spark: SparkSession
    path: str

    def _path(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits/{name}" if name else f"{self.path}/commits")

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Committed numbers in order."""
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path())]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def read(self, number: int) -> dict:
        stream = self._fs().open(self._path(f"{number:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def new_folder(self, label: str = "data") -> str:
        """A folder for an attempt's data, never used before."""
        return f"{self.path}/{label}/{uuid.uuid4().hex}"

    def commit(self, number: int, entry: dict) -> None:
        """Makes ``entry`` the one of ``number``; raises ``AlreadyCommitted`` if it has one."""
        jvm, fs = self.spark.sparkContext._jvm, self._fs()
        staged, final = self._path(f"_{number:020d}-{uuid.uuid4().hex}"), self._path(f"{number:020d}.json")
        stream = fs.create(staged, False)
        try:
            stream.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
        finally:
            stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        no_options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(fs.makeQualified(staged), fs.makeQualified(final), no_options)
        except Exception as e:
            fs.delete(staged, False)
            if "FileAlreadyExistsException" in str(e):
                raise AlreadyCommitted(f"{number} of {self.path} was committed by another run") from None
            raise

    def remove(self, folders: list[str]) -> None:
        """Deletes folders that no entry needs any more."""
        for folder in folders:
            self._fs().delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)

"""Tables that readers see whole, and jobs that go on after a failure."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"  # names the version that readers see


class _Folder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._store = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _finished(self, name: str) -> bool:
        return self._store.exists(self._at(f"{name}/_SUCCESS"))


class Versions(_Folder):
    """A Parquet table of which every write is a version of its own, in a folder beside the others.

    A file names the current version.  It is replaced by renaming, once the new version is complete, so
    readers see the old rows or the new ones, and a failed write leaves the old ones.  The version
    before the current one stays for readers that are under way; older ones are deleted.
    """

    def current(self) -> str | None:
        pointer = self._at(POINTER)
        if not self._store.exists(pointer):
            return None
        stream = self._store.open(pointer)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        """The current version, or None before the first write."""
        name = self.current()
        return None if name is None else self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, df: DataFrame) -> DataFrame:
        """Write a version, make it the current one and read it."""
        before = self.current()
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        self._swap(name)
        for old in self._store.listStatus(self._at("")):
            found = old.getPath().getName()
            if found.startswith("v-") and found not in (before, name):
                self._store.delete(old.getPath(), True)
        return self.read()

    def _swap(self, name: str) -> None:
        fresh, jvm = self._at(f".{name}"), self.spark._jvm
        stream = self._store.create(fresh, True)
        stream.write(bytearray(name.encode()))
        stream.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._store.getUri(), self._conf).rename(
            self._store.makeQualified(fresh), self._store.makeQualified(self._at(POINTER)), how)


class Journal(_Folder):
    """Finished stages of one run of a job, kept until the job is done.

    A run that failed is started again under its name and takes up the stages that had finished, with
    the rows they had then.  ``finish`` ends the run: its stages go, and the name may be used again.
    """

    def __init__(self, spark: SparkSession, path: str, *run: str):
        safe = ("".join(c if c.isalnum() or c in "-_" else f"%{ord(c):x}" for c in part) or "%" for part in run)
        super().__init__(spark, f"{path.rstrip('/')}/_journal/{'/'.join(safe)}")

    def keep(self, stage: str, rows: Callable[[], DataFrame]) -> DataFrame:
        """The stage's rows: as they were written, or worked out and written now."""
        if not self._finished(stage):
            rows().write.mode("overwrite").parquet(f"{self.path}/{stage}")
        return self.spark.read.parquet(f"{self.path}/{stage}")

    def finish(self) -> None:
        self._store.delete(self._at(""), True)

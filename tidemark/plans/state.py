"""Versioned state tables.

Each version is a folder of Parquet files, written whole; its _SUCCESS file, which the writer's commit leaves last, makes it
current. A version that is being read is never written. Paths go through Hadoop's file systems, so any store will do that
Spark can read and write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.reconcile import STATE, empty_state


class StateStore:
    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), max(1, keep)
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, tail: str):  # noqa: ANN202
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{tail}" if tail else self.path)

    def versions(self) -> list[int]:
        """Numbers of the complete versions, in order."""
        if not self._fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(""))]
        numbers = (int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())
        return sorted(n for n in numbers if self._fs.exists(self._path(f"v{n:012d}/_SUCCESS")))

    def current(self) -> int | None:
        return (self.versions() or [None])[-1]

    def read(self, version: int | None = None) -> DataFrame:
        """A version's rows: the current one's, or none where there is no version yet."""
        version = self.current() if version is None else version
        return empty_state(self.spark) if version is None else self.spark.read.schema(STATE).parquet(f"{self.path}/v{version:012d}")

    def write(self, state: DataFrame, version: int | None = None) -> int:
        """Write the next version (or this one, unless it is there already) and drop those beyond ``keep``."""
        have = self.versions()
        version = (have[-1] + 1 if have else 0) if version is None else version
        if version in have:
            return version
        if have and version < have[-1]:
            raise ValueError(f"version {version} is older than the current one, {have[-1]}")
        state.write.mode("overwrite").parquet(f"{self.path}/v{version:012d}")
        for old in [*have, version][: -self.keep]:
            self._fs.delete(self._path(f"v{old:012d}"), True)
        return version

    def start_from(self, version: int) -> None:
        """Make a version the first: its number is kept, and older versions go."""
        self._fs.mkdirs(self._path(f"first/{version:012d}"))
        for old in self.versions():
            if old < version:
                self._fs.delete(self._path(f"v{old:012d}"), True)

    def first(self) -> int:
        """The version of the last initial load, 0 where none was made."""
        path = self._path("first")
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(path)), default=0) if self._fs.exists(path) else 0

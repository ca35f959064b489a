"""A registry of immutable snapshots of a table, by version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SnapshotStore:
    """Snapshots of one table under a folder, one Parquet partition a version; safe to read while others are added.

    A snapshot is live until it is released; tombstones older than the oldest live one can be pruned.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Complete live snapshots, oldest first."""
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(p)]
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(n.partition("=")[2]) for n, q in names if n.startswith("version=") and fs.exists(jvm(q, "_SUCCESS")))

    def save(self, df: DataFrame, version: int | None = None) -> int:
        """Write a snapshot; versions only go up."""
        last = self.versions()
        version = version if version is not None else (last[-1] + 1 if last else 1)
        if last and version <= last[-1]:
            raise ValueError(f"version {version} isn't above {last[-1]}")
        df.write.mode("overwrite").parquet(f"{self.path}/version={version}")
        return version

    def load(self, version: int) -> DataFrame:
        """A snapshot with its version as a column."""
        if version not in self.versions():
            raise KeyError(version)
        return self.spark.read.parquet(f"{self.path}/version={version}").withColumn("version", F.lit(version).cast("long"))

    def as_of(self, version: int) -> DataFrame | None:
        """The newest snapshot that isn't above a version."""
        held = [v for v in self.versions() if v <= version]
        return self.load(held[-1]) if held else None

    def oldest(self) -> int | None:
        held = self.versions()
        return held[0] if held else None

    def release(self, version: int) -> None:
        fs, p = self._fs(f"{self.path}/version={version}")
        fs.delete(p, True)

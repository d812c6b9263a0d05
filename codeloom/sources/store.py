"""Versioned tables: writers fill a new folder and then add a pointer row, readers resolve the pointer once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

_POINTER = "version string, seq long, batch string, built_at timestamp, folders map<string,string>"


class Store:
    """Tables of an index below one folder; commit() makes all tables of a version visible together.

    Versions are numbered and the greatest number is read, so clocks don't matter. One writer at a time is assumed; should two take the same
    number, the later one counts. A version may refer to tables of the one before, which aren't written again.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, folder: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")

    def _files(self):
        return self._path("pointer").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _pointers(self) -> DataFrame:
        return self.spark.read.schema(_POINTER).json(f"{self.root}/pointer")

    def last(self) -> Row | None:
        """version, seq, batch, built_at, folders of the latest commit; none in an empty store."""
        if not self._files().exists(self._path("pointer")):
            return None
        return self._pointers().orderBy(F.desc("seq"), F.desc("built_at"), "version").first()

    def has(self, batch: str) -> bool:
        """Whether a batch of that name was committed."""
        return self._files().exists(self._path("pointer")) and not self._pointers().where(F.col("batch") == batch).isEmpty()

    def commit(self, tables: dict[str, DataFrame], same: tuple[str, ...] = (), batch: str | None = None) -> str:
        """Writes tables as the next version; those in `same` stay what they are in the one before."""
        last, version = self.last(), uuid.uuid4().hex
        folders = {name: last.folders[name] for name in same}
        for name, df in tables.items():
            folders[name] = f"v={version}/{name}"
            df.write.parquet(f"{self.root}/{folders[name]}")
        row = self.spark.range(1).select(
            F.lit(version).alias("version"), F.lit((last.seq if last else 0) + 1).cast("long").alias("seq"), F.lit(batch).cast("string").alias("batch"),
            F.current_timestamp().alias("built_at"), F.create_map(*[F.lit(x) for kv in folders.items() for x in kv]).alias("folders"))
        row.coalesce(1).write.mode("append").json(f"{self.root}/pointer")
        return version

    def version(self) -> str:
        return self.last().version

    def read(self, name: str, version: str | None = None) -> DataFrame:
        row = self.last() if version is None else self._pointers().where(F.col("version") == version).first()
        return self.spark.read.parquet(f"{self.root}/{row.folders[name]}")

    def prune(self, keep: int = 2) -> list[str]:
        """Deletes the tables that none of the last `keep` versions refers to; returns their folders."""
        rows = self._pointers().orderBy(F.desc("seq"), F.desc("built_at"), "version").collect()
        used = {f for r in rows[:keep] for f in r.folders.values()}
        gone = sorted({f for r in rows[keep:] for f in r.folders.values()} - used)
        for folder in gone:
            self._files().delete(self._path(folder), True)
        return gone

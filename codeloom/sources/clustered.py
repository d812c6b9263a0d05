"""Tables stored in key order, so that a question about few keys reads few files.

Rows are dealt by ranges of their keys and sorted; beside them lies a list of the files with the least and greatest
key of each. A reader takes from that list the files that may hold what is asked for, and opens no other.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The greatest character, which ends the range of a prefix.
_LAST = "\U0010ffff"


def write(df: DataFrame, path: str, by: list[str], files: int | None = None) -> None:
    """Stores a table by ranges of the columns `by`, the first of which is the key (a string); further ones split keys with many rows.

    Rows with a null key are stored and no question finds them. An empty table is stored as such.
    """
    dealt = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    ranges = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(by[0]).alias("lo"), F.max(by[0]).alias("hi"), F.count("*").alias("n"))
    ranges.coalesce(1).write.parquet(f"{path}/ranges")


def files_of(spark: SparkSession, path: str, keys: Iterable[str] = (), prefixes: Iterable[str] = ()) -> list[str]:
    """The files that may hold one of the keys or a key with one of the prefixes: as many as the answer needs, whatever the table's size."""
    ranges = spark.read.parquet(f"{path}/ranges")
    return [r.file for r in ranges.where(_any((F.col("lo") <= k) & (F.col("hi") >= k) for k in keys) | _any(
        (F.col("lo") <= p + _LAST) & (F.col("hi") >= p) for p in prefixes)).select("file").sort("file").collect()]


def read(spark: SparkSession, path: str, key: str, keys: Iterable[str] = (), prefixes: Iterable[str] = ()) -> DataFrame:
    """The stored rows whose key is one of `keys` or begins with one of `prefixes`. Keys are a question's, so they are few."""
    keys, prefixes = list(keys), list(prefixes)
    rows = spark.read.parquet(f"{path}/rows")
    found = files_of(spark, path, keys, prefixes)
    if not found:
        return rows.where("false")
    c = F.col(key)
    return spark.read.schema(rows.schema).parquet(*found).where((c.isin(keys) if keys else F.lit(False)) | _any(c.startswith(p) for p in prefixes))


def _any(conditions: Iterable[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out

"""Partitions by the number of rows, so that a task's memory doesn't grow with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a partition up to which Spark's own number of shuffle partitions is kept.
LEAST = 2000


def spread(df: DataFrame, keys: list[str], rows: int, each: int) -> DataFrame:
    """The rows dealt out by keys, about `each` of `rows` to a partition at most; groupings by these keys go on where they lie.

    Spark sizes partitions by the bytes that are shuffled. Where few bytes become many rows in the same task, the rows that they become must count.
    """
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(-(-rows // each), min(own, -(-rows // LEAST)), 1)
    # where a join before has Spark's own number already, an equal one would be left out, and partitions merged by their bytes
    return df.repartition(n + (n == own), *keys)

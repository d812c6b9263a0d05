"""Tables, checkpoints and Arrow batches for the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch: texts may be long, and two Python workers share an executor.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keeps the memory of Python workers bounded, however long the texts are, and ships this package to them.

    The two Arrow settings stay set in the session: the tables are lazy, and their batches are cut when they are read.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    _ship(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local session without one gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-codeloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeloom-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes materialised tables that nothing lazy still reads."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if path.getName().startswith("codeloom-"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Ids broadcast at most, 8 bytes each; larger sets of ids are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    """Materialised ids, marked for broadcast if they are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


#: Rows of one key from which on it is joined apart from the others.
HOT_ROWS = 100_000


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """`left` joined with `right`, a materialised table that has one row per key and in `rows` the number of its rows on the left.

    Keys with more than a thousandth of all rows are a thousand at most: they are broadcast, so their rows stay where
    they are; all others are joined by a shuffle in which no key is hot.
    """
    total, most = (x or 0 for x in right.agg(F.sum("rows"), F.max("rows")).first())
    hot = F.col("rows") > max(total / 1000, HOT_ROWS)
    if most <= HOT_ROWS:
        return left.join(right.drop("rows"), key)
    apart = right.where(hot).drop("rows")
    return left.join(F.broadcast(apart), key).unionByName(
        left.join(F.broadcast(apart.select(key)), key, "left_anti").join(right.where(~hot).drop("rows"), key)
    )


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application, as they may have no copy of it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="spark-codeloom-"), "codeloom_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)

"""Sharding by extendible hashing.

A directory is indexed by hash-prefix bits. Only a bucket over the byte limit splits on another bit, so a
shard is the shortest prefix whose documents fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeloom.llm.io import materialise

LIMIT_BYTES = 32 << 20
#: The limit of the registered query: small, so that a few megabytes of documents split too.
QUERY_LIMIT = 256 << 10
#: Parts into which the equal rows of an overflowing bucket are dealt to be numbered.
OVERFLOW_PARTS = 1024
BITS = 32
#: Directory entries broadcast at most; a larger directory is joined by a shuffle.
BROADCAST_ENTRIES = 500_000
_AHEAD = 3


def _bits(doc_id: str = "doc_id") -> Column:
    """32 hash bits of a document id, as a long; null has those of the word null."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long")


def _prefix(bits: Column, depth) -> Column:
    return F.substring(F.lpad(F.bin(bits), BITS, "0"), F.lit(1), depth)


def directory(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """(bin_depth, bin, depth): buckets of `bin_depth` bits and the depth of the shard that each belongs to.

    Bytes are summed for bins a few bits deeper than the even split; the depth of a bin is the least at which
    its prefix fits. Bins that still don't fit are split further with their own documents alone. depth is 33
    where 32 bits don't separate the documents: such a bucket has overflow pages.
    """
    rows = materialise(docs.select(_bits().alias("bits"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n")))
    total = rows.agg(F.sum("n")).first()[0] or 0
    done = None
    low, depth = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + _AHEAD)
    while True:
        bins = materialise(rows.groupBy(F.shiftright("bits", BITS - depth).alias("bin")).agg(F.sum("n").alias("n")))
        up = bins.select("bin", "n", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("d")).withColumn(
            "p", F.expr(f"shiftright(bin, {depth} - d)")
        )
        fits = up.groupBy("d", "p").agg(F.sum("n").alias("n")).where(F.col("n") <= limit).select("d", "p")
        found = up.join(fits, ["d", "p"]).groupBy("bin").agg(F.min("d").alias("depth"))
        found = materialise(bins.select("bin").join(found, "bin", "left").select(F.lit(depth).alias("bin_depth"), "bin", "depth"))
        settled = found.where("depth is not null")
        over = found.where("depth is null")
        if depth == BITS:
            settled = settled.unionByName(over.withColumn("depth", F.lit(BITS + 1)))
        done = settled if done is None else done.unionByName(settled)
        if depth == BITS or over.isEmpty():
            return materialise(done)
        at = depth
        rows = materialise(
            rows.withColumn("bin", F.shiftright("bits", BITS - at)).join(over.select("bin"), "bin", "left_semi").select("bits", "n")
        )
        low, depth = at + 1, min(BITS, at + 8)


def _assigned(docs: DataFrame, limit: int) -> DataFrame:
    """The rows of `docs` as _row, with _s: (shard_id, depth, n_bytes)."""
    found = directory(docs, limit)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _bits().alias("bits"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    depths = sorted(x[0] for x in found.select("bin_depth").distinct().collect())
    parts = None
    for d in depths:
        entries = found.where(F.col("bin_depth") == d).select("bin", "depth")
        small = entries.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
        part = rows.withColumn("bin", F.shiftright("bits", BITS - d)).join(F.broadcast(entries) if small else entries, "bin")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = rows.withColumn("bin", F.lit(0).cast("long")).withColumn("depth", F.lit(0)).where("false")
    normal = parts.where(F.col("depth") <= BITS).select(
        "_row", F.struct(_prefix(F.col("bits"), F.col("depth")).alias("shard_id"), "depth", "n_bytes").alias("_s")
    )
    if found.where(F.col("depth") > BITS).isEmpty():
        return normal
    # equal rows are dealt into parts, so no task numbers all of them; rows of a part differ in nothing that pages depend on
    over = materialise(parts.where(F.col("depth") > BITS).select(
        "_row", "bits", "n_bytes", F.xxhash64("_row.doc_id", "_row.text").alias("h"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(OVERFLOW_PARTS)).alias("part"),
    ))
    sizes = over.groupBy("bits", "h", "part").agg(F.count("*").alias("n"), F.max("n_bytes").alias("each"))
    w = W.partitionBy("bits")
    before = F.coalesce(F.sum(F.col("n") * F.col("each")).over(w.orderBy("h", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("bits", "h", "part", before.alias("before"), F.greatest(F.lit(limit) - F.max("each").over(w), F.lit(1)).alias("step"))
    nth = F.row_number().over(W.partitionBy("bits", "h", "part").orderBy("n_bytes")) - 1
    pages = over.withColumn("nth", nth).join(starts, ["bits", "h", "part"]).withColumn(
        "page", F.floor((F.col("before") + F.col("nth") * F.col("n_bytes")) / F.col("step"))
    )
    shard = F.concat_ws("-p", _prefix(F.col("bits"), F.lit(BITS)), F.col("page"))
    return normal.unionByName(pages.select("_row", F.struct(shard.alias("shard_id"), F.lit(BITS).alias("depth"), "n_bytes").alias("_s")))


def shard_map(docs: DataFrame, *, limit: int = LIMIT_BYTES) -> DataFrame:
    """One row per row of `docs`: doc_id, shard_id (the prefix bits; empty for a single shard), depth, n_bytes.

    n_bytes are UTF-8 bytes of the text (null: 0). A document over the limit is a shard of its own. Rows
    that share all 32 bits (repeated rows) and exceed the limit together go to overflow pages -p0, -p1 and so on; they
    are filled in order of a hash of doc_id and text, whatever the partitions, so a page has the same documents in
    every run. A null doc_id hashes as the word null. An empty table gives no rows.
    """
    return _assigned(docs.select("doc_id", "text"), limit).select("_row.doc_id", "_s.*")


def shard(docs: DataFrame, *, limit: int = LIMIT_BYTES) -> DataFrame:
    """The rows of `docs` with their shard_id, as in `shard_map`; an incoming column of that name, in any case, is replaced."""
    kept = [c for c in docs.columns if c.lower() != "shard_id"]
    return _assigned(docs.select(*[F.col(f"`{c}`") for c in kept]), limit).select("_row.*", "_s.shard_id")


def write_shards(docs: DataFrame, path: str, *, limit: int = LIMIT_BYTES) -> None:
    """Writes one folder of Parquet per shard; a shard is at most `limit` bytes, or one document. An empty table gives an empty folder."""
    shard(docs, limit=limit).repartition("shard_id").write.partitionBy("shard_id").parquet(path)


#: The same shards in DuckDB, without overflow pages (doc_ids are distinct there).
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS bits
  FROM documents
), up AS (
  SELECT doc_id, n_bytes, bits, r.depth, bits >> ({BITS} - r.depth) AS p
  FROM d, (SELECT CAST(range AS INTEGER) AS depth FROM range(0, {BITS} + 1)) r
), fits AS (
  SELECT depth, p FROM up GROUP BY depth, p HAVING sum(n_bytes) <= {QUERY_LIMIT}
), pick AS (
  SELECT up.doc_id, up.n_bytes, up.bits, min(up.depth) AS depth FROM up JOIN fits USING (depth, p) GROUP BY ALL
)
SELECT doc_id, substr(lpad(bin(bits), {BITS}, '0'), 1, depth) AS shard_id, depth, n_bytes FROM pick
"""

"""Mixing sources to target weights.

Temperature mixing raises the sources' token shares to an exponent that is bisected until the weights meet a
target entropy or a repetition limit. The weights are realised as block permutations: each source runs
through whole random permutations of its documents, cut into blocks, and stops in the last one where its
share of the token budget is reached.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeloom.llm.io import materialise

#: Sources whose counts the driver takes; with more, each step of the bisection is an aggregate.
LOCAL_SOURCES = 100_000
BLOCK_TOKENS = 1_000_000
_U_BITS, _STEP_BITS, _STEPS = 60, 12, 50


def _bisect(meets: Callable[[float], bool]) -> float:
    """The least exponent in [0, 1] that meets a condition which holds from some exponent on; 1 if none does."""
    if meets(0.0):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(_STEPS):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if meets(mid) else (mid, hi)
    return hi


def _moments(totals: DataFrame) -> Callable[[float], tuple[float, float, float]]:
    """For an exponent: the log of the sum of shares ** exponent, the entropy of the weights, and the log of max tokens / weight."""
    t = totals.where("tokens > 0").select(F.log(F.col("tokens").cast("double")).alias("l"))
    few = t.limit(LOCAL_SOURCES + 1).collect()
    if len(few) <= LOCAL_SOURCES:
        logs = np.sort(np.array([x[0] for x in few]))

        def local(a: float) -> tuple[float, float, float]:
            if not len(logs):
                return 0.0, 0.0, 0.0
            z = a * logs
            top = z.max()
            log_sum = top + math.log(np.exp(z - top).sum())
            w = np.exp(z - log_sum)
            return log_sum, float(-(w * (z - log_sum)).sum()), float((logs - (z - log_sum)).max())
        return local
    top = t.agg(F.max("l")).first()[0]

    def spread(a: float) -> tuple[float, float, float]:
        e = F.exp(a * (F.col("l") - top))
        s, sz, gap = t.agg(F.sum(e), F.sum(e * a * F.col("l")), F.max((1 - a) * F.col("l"))).first()
        log_sum = a * top + math.log(s)
        return log_sum, log_sum - sz / s, gap + log_sum
    return spread


def source_plan(
    docs: DataFrame, *, entropy: float | None = None, repeats: float | None = 2.0, budget_tokens: float | None = None,
    block_tokens: int = BLOCK_TOKENS, seed: int = 7,
) -> DataFrame:
    """One row per source: key, tokens, weight, epochs, full, cut, block_bits.

    With `entropy` (nats) the exponent is the least whose weights have at most that entropy; else it is the
    least under which no source runs more than `repeats` times. Without a budget, the least budget is taken
    under which each source runs at least once, so no document is dropped. full is the number of whole
    permutations; of one more permutation the documents up to position `cut` (-1: none) are used.
    """
    rows = materialise(docs.select(
        _key(docs).alias("key"), _tokens().alias("tokens"),
        _position(F.lit(-1), seed).alias("u"),
    ))
    totals = materialise(rows.groupBy("key").agg(F.sum("tokens").alias("tokens")))
    moments = _moments(totals)
    least, most, total = totals.where("tokens > 0").agg(
        F.log(F.min("tokens").cast("double")), F.log(F.max("tokens").cast("double")), F.sum("tokens").cast("double")
    ).first()
    if least is None:
        least = most = total = 0.0

    def budget(a: float) -> float:
        return budget_tokens if budget_tokens is not None else math.exp(moments(a)[2])

    def runs(a: float) -> float:
        # the smallest source runs most often, as weight / tokens falls with the tokens
        return budget(a) * math.exp((a - 1) * least - moments(a)[0])

    if entropy is not None:
        exponent = _bisect(lambda a: moments(a)[1] <= entropy + 1e-12)
    elif repeats is not None:
        exponent = _bisect(lambda a: runs(a) <= repeats * (1 + 1e-12))
    else:
        exponent = 1.0
    log_sum, tokens_in_all = moments(exponent)[0], budget(exponent)
    weight = F.when(F.col("tokens") > 0, F.exp(exponent * F.log(F.col("tokens").cast("double")) - log_sum)).otherwise(F.lit(0.0))
    epochs = F.when(F.col("tokens") > 0, F.col("weight") * tokens_in_all / F.col("tokens")).otherwise(F.lit(1.0))
    plan = totals.withColumn("weight", weight).withColumn("epochs", epochs)
    # a source within a billionth of a whole number of runs makes that number
    plan = plan.withColumn("full", F.floor(F.col("epochs") * (1 + 1e-9))).withColumn(
        "need", F.floor(F.greatest(F.col("epochs") - F.col("full"), F.lit(0.0)) * F.col("tokens"))
    ).withColumn("block_bits", F.least(F.lit(30), F.ceil(F.log2(F.greatest(F.col("tokens") / block_tokens, F.lit(1.0))))).cast("int"))
    plan = materialise(plan)
    cuts = _cuts(rows, plan.where("need > 0"), block_tokens)
    return plan.join(cuts, "key", "left").select("key", "tokens", "weight", "epochs", "full", F.coalesce("cut", F.lit(-1)).alias("cut"), "block_bits")


def _cuts(rows: DataFrame, plan: DataFrame, block_tokens: int) -> DataFrame:
    """For each source the last position whose documents, with all before them, hold at most `need` tokens.

    Positions are refined by 12 bits a step: the block in which the need is reached is split again until it is
    small, so a window never sees more than 4096 blocks of a source, or the documents of one small block.
    """
    at = materialise(plan.select("key", "need", F.lit(0).cast("long").alias("prefix"), F.col("tokens").alias("size")))
    bits = 0
    while bits + _STEP_BITS <= _U_BITS and not at.where(F.col("size") > block_tokens).isEmpty():
        shift = _U_BITS - bits
        inside = _of(rows, at, "need", "prefix", "size").where(F.shiftright("u", shift) == F.col("prefix"))
        sums = inside.groupBy("key", "need", F.shiftright("u", shift - _STEP_BITS).alias("prefix")).agg(F.sum("tokens").alias("size"))
        run = sums.withColumn("upto", F.sum("size").over(W.partitionBy("key").orderBy("prefix")))
        # sources whose block holds exactly the need end in the next, empty of it
        at = materialise(
            run.where(F.col("upto") > F.col("need")).groupBy("key").agg(F.min(F.struct("prefix", "size", "upto", "need")).alias("x"))
            .select("key", (F.col("x.need") - (F.col("x.upto") - F.col("x.size"))).alias("need"), "x.prefix", "x.size")
        )
        bits += _STEP_BITS
    inside = _of(rows, at, "need", "prefix").where(F.shiftright("u", _U_BITS - bits) == F.col("prefix"))
    same = inside.groupBy("key", "need", "prefix", "u").agg(F.sum("tokens").alias("tokens"))
    run = same.withColumn("upto", F.sum("tokens").over(W.partitionBy("key").orderBy("u")))
    last = run.where(F.col("upto") <= F.col("need")).groupBy("key").agg(F.max("u").alias("u"))
    return at.join(last, "key", "left").select("key", F.coalesce("u", F.shiftleft("prefix", _U_BITS - bits) - 1).alias("cut"))


def _of(rows: DataFrame, plan: DataFrame, *columns: str) -> DataFrame:
    """Rows with columns of their source's plan, which is broadcast while it has at most LOCAL_SOURCES sources."""
    plan = plan.select("key", *columns)
    return rows.join(F.broadcast(plan) if plan.limit(LOCAL_SOURCES + 1).count() <= LOCAL_SOURCES else plan, "key")


def _key(docs: DataFrame):
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))


def _tokens():
    return F.coalesce(F.regexp_count("text", F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def _position(epoch, seed: int):
    """A document's place in a permutation: 60 random bits; epoch -1 is the one that may be cut."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch, F.col("doc_id"), F.col("text")), 64 - _U_BITS)


def _placed(docs: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """The rows of `docs` as _row, once for each run of their source, with _p: (epoch, block, position, weight, due).

    due is the part of its source's tokens at which a block begins: blocks of all sources in its order keep the weights
    at every point.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", _key(docs).alias("key"))
    rows = _of(rows, plan, "full", "cut", "block_bits", "weight", "epochs")
    last = F.when(_position(F.lit(-1), seed) <= F.col("cut"), F.array(F.col("full"))).otherwise(F.array().cast("array<long>"))
    whole = F.when(F.col("full") > 0, F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).otherwise(F.array().cast("array<long>"))
    rows = rows.select("*", F.explode(F.concat(whole, last)).alias("epoch"))
    u = _position(F.when(F.col("epoch") == F.col("full"), F.lit(-1)).otherwise(F.col("epoch").cast("int")), seed)
    rows = rows.withColumn("position", u)
    rows = rows.withColumn("block", F.expr(f"shiftright(position, {_U_BITS} - block_bits)"))
    due = (F.col("epoch") + F.col("block") / F.pow(F.lit(2.0), F.col("block_bits"))) / F.col("epochs")
    return rows.select("_row", "key", F.struct("epoch", "block", "position", "weight", due.alias("due")).alias("_p"))


def mixture(docs: DataFrame, *, seed: int = 7, **options) -> DataFrame:
    """The mixed order: doc_id, source, n_tokens, epoch, block, position, weight, due, a row for each use of a document.

    Reading by epoch, block and position gives each source's permutations; reading blocks by due mixes the sources. A null source is a source of its
    own; null and empty texts have no tokens and are used in every whole run; repeated rows fall on one
    position and are used together; sources without tokens run once; an empty table gives an empty result.
    """
    plan = source_plan(docs, seed=seed, **options)
    d = _placed(docs.select("doc_id", "text", "source"), plan, seed).select("_row.*", "_p.*")
    return d.select("doc_id", "source", _tokens().alias("n_tokens"), "epoch", "block", "position", "weight", "due")


def mix(docs: DataFrame, *, seed: int = 7, **options) -> DataFrame:
    """The mixed documents with the columns of `docs`, in mixed order: a row appears once for each use.

    Rows are sorted by the share of its source at which their block begins, then source and position, so any stretch of the
    output has the weights to within a block a source. Written as Parquet, the files are in this order by name and the rows
    by place; as Spark deals files out by size, a reader gets the order back from `file_order`. Nulls, empty texts, repeated
    rows and empty tables are as in `mixture`.
    """
    placed = _placed(docs, source_plan(docs, seed=seed, **options), seed)
    return placed.orderBy("_p.due", "key", "_p.epoch", "_p.position").select("_row.*")


def file_order(docs: DataFrame, name: str = "mix_rank") -> DataFrame:
    """`docs`, as read from files that were written in an order, with the place of each row in it, from 0 on.

    Spark numbers the files of a write by partition, so (number, file, place in the file) is the order in which they were
    written. The rows before each file are counted by file; the list of files is broadcast while there are at
    most LOCAL_SOURCES. A column of that name, in any case, is replaced. A table without files (one that no
    write has put in order) gets null places.
    """
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()])
    if not docs.inputFiles():
        return kept.withColumn(name, F.lit(None).cast("long"))
    placed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")
    )
    number = F.regexp_extract("_file", r"part-(\d+)[^/]*$", 1)
    files = placed.groupBy("_file").agg(F.count("*").alias("n")).withColumn("number", F.when(number != "", number.cast("long")))
    before = F.coalesce(F.sum("n").over(W.orderBy("number", "_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = materialise(files.select("_file", before.alias("_before")))
    few = files.count() <= LOCAL_SOURCES
    return placed.join(F.broadcast(files) if few else files, "_file").select("_row.*", (F.col("_before") + F.col("_at")).alias(name))

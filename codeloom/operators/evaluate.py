"""Retrieval folds, run scores, paired comparisons, intervals and matchings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fold_scores(gold: DataFrame, candidates: DataFrame, item: str) -> DataFrame:
    """case_id, seed, n_gold, hits, recall, precision: one fold for each gold item left out as the seed.

    gold(case_id, item) with at least two items a case; candidates(case_id, seed, item) without the seed itself.
    """
    c = candidates.where(F.col("seed") != F.col(item)).select("case_id", "seed", F.col(item).alias("item"), F.lit(0).alias("gold"))
    g = gold.select("case_id", F.lit(None).cast(candidates.schema["seed"].dataType).alias("seed"), F.col(item).alias("item"), F.lit(1).alias("gold"))
    # every step is by case, so rows dealt out by case stay where they are
    d = c.unionByName(g).where("case_id IS NOT NULL").groupBy("case_id", "seed", "item").agg(F.max("gold").alias("gold"))
    d = d.withColumn("hit", F.max("gold").over(W.partitionBy("case_id", "item")))
    seed = F.when(F.col("gold") == 1, F.col("item")).otherwise(F.col("seed"))
    s = d.select("case_id", seed.alias("seed"), "gold", "hit").groupBy("case_id", "seed").agg(
        F.max("gold").alias("gold"), F.count_if((F.col("gold") == 0) & (F.col("hit") == 1)).alias("hits"),
        F.count_if(F.col("gold") == 0).alias("n_candidates"))
    f = s.withColumn("n_gold", F.sum("gold").over(W.partitionBy("case_id")) - 1).where("gold = 1 AND n_gold >= 1")
    return f.select(
        "case_id", "seed", "n_gold", "hits", (F.col("hits") / F.col("n_gold")).alias("recall"),
        F.coalesce(F.try_divide("hits", "n_candidates"), F.lit(0.0)).alias("precision"),
    )


def macro_means(folds: DataFrame) -> DataFrame:
    """Means over folds; null without folds."""
    return folds.agg(F.count("*").alias("folds"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision"))


def mode_metrics(runs: DataFrame) -> DataFrame:
    """Per mode: runs, means of precision, recall and f1."""
    return runs.groupBy("mode").agg(F.count("*").alias("runs"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def stable_cases(runs: DataFrame) -> DataFrame:
    """Per mode: cases, cases that every run hits in full, and cases that any run hits."""
    c = runs.groupBy("mode", "case_id").agg(F.bool_and(F.col("recall") >= 1).alias("every"), F.bool_or(F.col("recall") > 0).alias("some"))
    return c.groupBy("mode").agg(F.count("*").alias("cases"), F.count_if("every").alias("stable_case_hits"), F.count_if("some").alias("cases_with_any_hit"))


def paired_deltas(runs: DataFrame, baseline: str, candidate: str, value: str = "f1") -> DataFrame:
    """pairs, mean_delta, wins, ties, losses of two modes over (case_id, repetition)."""
    of = lambda m, n: runs.where(F.col("mode") == m).select("case_id", "repetition", F.col(value).alias(n))
    d = of(baseline, "a").join(of(candidate, "b"), ["case_id", "repetition"]).select((F.col("b") - F.col("a")).alias("d"))
    return d.agg(
        F.count("*").alias("pairs"), F.avg("d").alias("mean_delta"), F.count_if(F.col("d") > 0).alias("wins"),
        F.count_if(F.col("d") == 0).alias("ties"), F.count_if(F.col("d") < 0).alias("losses"),
    )


def pearson(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """n, r: null with under two rows or without variance, where corr would raise."""
    d = df.select(x.cast("double").alias("x"), y.cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    m = d.agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return m.select("n", F.when(F.col("n") >= 2, F.try_divide("c", F.col("sx") * F.col("sy"))).alias("r"))


def bootstrap_ci(cases: DataFrame, samples: int = 1000, low: float = 0.025, high: float = 0.975, seed: int = 1) -> DataFrame:
    """samples, lo, hi of the mean of `value` over resampled cases (case_no from 0 on, value); all draws come from one integer hash.

    Draw i of sample s takes case (a * (s * n + i) + seed) mod p mod n; the percentile is the nearest rank round((samples - 1) * q).
    Draws are counted by case in the join, so nothing but sums travels.
    """
    spark = cases.sparkSession
    n = cases.count()
    if not n:
        return cases.select(F.lit(0).cast("long").alias("samples"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")).limit(0)
    draws = spark.range(samples * n).select(F.floor(F.col("id") / n).alias("s"), F.expr(f"((id * 48271 + {seed}) % 2147483647) % {n}").alias("case_no"))
    means = draws.groupBy("s", "case_no").agg(F.count("*").alias("k")).join(cases, "case_no").groupBy("s").agg((F.sum(F.col("k") * F.col("value")) / n).alias("m"))
    ranked = means.withColumn("r", F.row_number().over(W.orderBy("m", "s")) - 1)
    at = lambda q: F.max(F.when(F.col("r") == round((samples - 1) * q), F.col("m")))
    return ranked.agg(F.count("*").alias("samples"), at(low).alias("lo"), at(high).alias("hi"))


def match_sizes(pairs: DataFrame) -> DataFrame:
    """run, matched: the size of a maximum matching of predictions and golds; one run's findings are few and bounded by its review."""

    def sizes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def matched(found) -> int:
            to: dict = {}
            for x in found:
                to.setdefault(x["pred"], []).append(x["gold"])
            owner: dict = {}

            def place(start) -> bool:
                # an augmenting path from a free prediction, by a stack of (prediction, golds to try)
                seen, path, stack = set(), [], [(start, iter(to[start]))]
                while stack:
                    p, golds = stack[-1]
                    for g in golds:
                        if g in seen:
                            continue
                        seen.add(g)
                        path.append((g, p))
                        if g not in owner:
                            owner.update(path)
                            return True
                        stack.append((owner[g], iter(to[owner[g]])))
                        break
                    else:
                        stack.pop()
                        if path and stack:
                            path.pop()
                return False

            return sum(place(p) for p in sorted(to))

        for pdf in batches:
            yield pd.DataFrame({"run": pdf["run"], "matched": [matched(x) for x in pdf["found"]]})

    found = pairs.groupBy("run").agg(F.sort_array(F.collect_set(F.struct("pred", "gold"))).alias("found"))
    return found.mapInPandas(sizes, "run string, matched long")


def scores(matched: DataFrame) -> DataFrame:
    """precision, recall and f1 of runs with n_pred and n_gold, 0 where a part is empty."""
    p, r = F.coalesce(F.try_divide("matched", "n_pred"), F.lit(0.0)), F.coalesce(F.try_divide("matched", "n_gold"), F.lit(0.0))
    return matched.select("*", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def lexical_hits(lines: DataFrame, words: list[str], limit: int = 20) -> DataFrame:
    """The first lines (file, line_no) that contain any word, in either case; the limit is the report's size."""
    low = F.lower("text")
    any_ = F.lit(False)
    for w in words:
        any_ = any_ | F.contains(low, F.lit(w.lower()))
    return lines.where(any_).select("file", "line_no").orderBy("file", "line_no").limit(limit)


def last_results(events: DataFrame) -> DataFrame:
    """run, text: the last result event of a transcript, else the last text of the assistant. events(run, ord, kind, text)."""
    pick = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("text")), F.when(F.col("kind") == k, F.col("ord")))
    return events.groupBy("run").agg(F.coalesce(pick("result"), pick("assistant")).alias("text"))

"""Reports: runs by mode, routes by risk, tables of coverage, histories of commits, communities and symbols in brief."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.names import cap_signature

#: From this risk on a case counts as one of high risk (a fixed value).
HIGH_RISK = 60
#: Members shown beside a symbol's community (a fixed value).
CO_MEMBERS = 50


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least 1; 0 for an empty or missing text. Halves round to the even number."""
    n = F.char_length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(n / 4).cast("int"))).cast("long")


def adoption(runs: DataFrame, prefix: str, tools: list[str]) -> DataFrame:
    """Per mode: runs, mean_tool_calls, and the shares of runs that call any tool with the prefix, and each tool. runs: mode, tool_calls."""
    calls = F.coalesce("tool_calls", F.array().cast("array<string>"))
    share = lambda c: F.avg(c.cast("double"))
    return runs.groupBy("mode").agg(
        F.count("*").alias("runs"), F.avg(F.size(calls)).alias("mean_tool_calls"), share(F.exists(calls, lambda t: t.startswith(prefix))).alias("adoption_rate"),
        *[share(F.array_contains(calls, prefix + t)).alias(f"{t}_rate") for t in tools],
    )


def mode_report(runs: DataFrame, measures: list[str]) -> DataFrame:
    """Per mode: runs, successful_runs, provider_failures, total_cost_usd, mean_cost_usd and the means of the measures; a missing value counts as 0."""
    ok, cost = F.coalesce("success", F.lit(False)), F.coalesce("cost_usd", F.lit(0.0))
    return runs.groupBy("mode").agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("successful_runs"), F.count_if(~ok).alias("provider_failures"),
        F.sum(cost).alias("total_cost_usd"), F.avg(cost).alias("mean_cost_usd"), *[F.avg(F.coalesce(m, F.lit(0))).alias(f"mean_{m}") for m in measures],
    )


def preflight(contexts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per mode: cases, max and mean characters, mean files, and over all cases the share of symbols that exist. contexts: case_id, mode, characters, files; symbols: case_id, qname, found."""
    rate = symbols.agg(F.count("*").alias("symbol_count"), F.coalesce(F.avg(F.col("found").cast("double")), F.lit(0.0)).alias("symbol_found_rate"))
    m = contexts.groupBy("mode").agg(
        F.countDistinct("case_id").alias("cases"), F.max("characters").alias("max_characters"), F.avg("characters").alias("mean_characters"), F.avg("files").alias("mean_files"))
    return m.crossJoin(F.broadcast(rate))


def coverage_gaps(runs: DataFrame, cases: DataFrame, modes: list[str]) -> DataFrame:
    """case_id, least, most of the cases whose required modes lack runs or have unequal numbers of them."""
    wanted = cases.select("case_id").distinct().crossJoin(F.broadcast(cases.sparkSession.createDataFrame([(m,) for m in modes], "mode string")))
    n = runs.where("f1 IS NOT NULL").groupBy("case_id", "mode").agg(F.count("*").alias("n"))
    c = wanted.join(n, ["case_id", "mode"], "left").na.fill(0, ["n"]).groupBy("case_id").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    return c.where("least = 0 OR least <> most")


def route_deltas(runs: DataFrame, risks: DataFrame, baseline: str, modes: list[str]) -> DataFrame:
    """case_id, max_risk, repetitions and per mode the mean f1 above that of the baseline. risks: case_id, risk."""
    mean = lambda m: F.coalesce(F.avg(F.when(F.col("mode") == m, F.col("f1"))), F.lit(0.0))
    d = runs.groupBy("case_id").agg(F.count_if(F.col("mode") == baseline).alias("repetitions"), *[(mean(m) - mean(baseline)).alias(f"{m}_delta") for m in modes])
    return d.join(risks.groupBy("case_id").agg(F.max("risk").alias("max_risk")), "case_id")


def risk_groups(deltas: DataFrame, modes: list[str]) -> DataFrame:
    """Of cases of high and of low risk: n, the mean delta of each mode, and how many cases the first mode makes better. Both groups are listed, empty or not."""
    names = deltas.sparkSession.createDataFrame([("high_risk",), ("low_risk",)], "risk_group string")
    g = deltas.groupBy(F.when(F.col("max_risk") >= HIGH_RISK, "high_risk").otherwise("low_risk").alias("risk_group")).agg(
        F.count("*").alias("n"), *[F.avg(f"{m}_delta").alias(f"mean_{m}_delta") for m in modes], F.count_if(F.col(f"{modes[0]}_delta") > 0).alias("positive"))
    return names.join(g, "risk_group", "left").na.fill(0)


def status_counts(items: DataFrame, statuses: list[str]) -> DataFrame:
    """status, n: all statuses in their order of names, those without items too."""
    every = items.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    return every.join(items.groupBy("status").agg(F.count("*").alias("n")), "status", "left").na.fill(0)


def findings_met(predictions: DataFrame, golds: DataFrame) -> DataFrame:
    """run, pred, gold: which prediction may stand for which gold finding of its run's case.

    The file is the gold's or one of its alternates; where the gold has lines the prediction's line is among them; where it has keywords
    any is in the lower-cased title and description. predictions: run, case_id, pred, file, line, title, description; golds: case_id,
    gold, file, alternates, line_start, line_end, keywords. Joined by case and file, so no case meets another.
    """
    places = golds.select("case_id", "gold", "line_start", "line_end", "keywords", F.explode(F.array_distinct(F.concat(F.array("file"), F.coalesce("alternates", F.array().cast("array<string>"))))).alias("file"))
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("description", F.lit(""))))
    p = predictions.select("run", "case_id", "pred", "file", "line", text.alias("text"))
    placed = F.col("line_start").isNull() | F.coalesce(F.col("line").between(F.col("line_start"), F.col("line_end")), F.lit(False))
    worded = (F.coalesce(F.size("keywords"), F.lit(0)) <= 0) | F.exists("keywords", lambda k: F.contains(F.col("text"), k))
    return p.join(places, ["case_id", "file"]).where(placed & worded).select("run", "pred", "gold").distinct()


def read_history(lines: DataFrame) -> DataFrame:
    """commit, parents, date, subject, files, ord of a log: lines(repo, ord, line) where `@@@commit|parents|date|subject` heads the names of files.

    Lines before the first header and empty ones are passed over; ord is the header's.
    """
    head = F.col("line").startswith("@@@")
    w = W.partitionBy("repo").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    x = lines.withColumn("_c", F.last(F.when(head, F.col("ord")), True).over(w)).where("_c IS NOT NULL AND trim(line) <> ''")
    g = x.groupBy("repo", F.col("_c").alias("ord")).agg(
        F.max(F.when(head, F.col("line"))).alias("h"), F.sort_array(F.collect_list(F.when(~head, F.struct("ord", F.trim("line").alias("f"))))).alias("fs"))
    p = F.split(F.expr("substr(h, 4)"), r"\|", 4)
    return g.select("repo", "ord", p[0].alias("commit"), F.filter(F.split(p[1], " "), lambda v: v != "").alias("parents"), p[2].alias("date"), p[3].alias("subject"), F.col("fs.f").alias("files"))


def commit_candidates(history: DataFrame, production: str, tests: str, suffix: str) -> DataFrame:
    """repo, commit, primary, place: commits with one parent, a production file and a test file; the first of each primary file go before the rest."""
    of = lambda prefix: F.filter("files", lambda f: f.startswith(prefix) & f.endswith(suffix))
    ok = history.where((F.size("parents") == 1) & (F.size(of(production)) > 0) & (F.size(of(tests)) > 0)).withColumn("primary", of(production)[0])
    late = (F.row_number().over(W.partitionBy("repo", "primary").orderBy("ord")) > 1).cast("int")
    return ok.withColumn("_l", late).withColumn("place", F.row_number().over(W.partitionBy("repo").orderBy("_l", "ord")).cast("long")).select("repo", "commit", "primary", "place")


def quota(rows: DataFrame, quotas: DataFrame) -> DataFrame:
    """group, item, place, short: the items with most golds up to the quota of their group; short is how many the group lacks. rows: group, item, n_gold; quotas: group, wanted."""
    w = W.partitionBy("group").orderBy(F.desc("n_gold"), "item")
    n = rows.groupBy("group").agg(F.count("*").alias("n"))
    r = rows.withColumn("place", F.row_number().over(w).cast("long")).join(quotas, "group").where("place <= wanted").join(n, "group")
    return r.select("group", "item", "place", F.greatest(F.col("wanted") - F.col("n"), F.lit(0)).cast("long").alias("short"))


def nearest_hunks(asked: DataFrame, hunks: DataFrame) -> DataFrame:
    """file, line, start, problem: the hunk that starts nearest to each asked line; `ambiguous` on a tie, `no hunks` without any.

    The nearest are the last start at or before and the first at or after, found by one ordered pass over a file's starts and questions.
    """
    h = hunks.select("file", F.col("start").alias("line"), F.lit(1).alias("is_hunk")).distinct()
    q = asked.select("file", "line", F.lit(0).alias("is_hunk")).distinct()
    start = F.when(F.col("is_hunk") == 1, F.col("line"))
    w = W.partitionBy("file").orderBy("line")
    x = h.unionByName(q).select("*", F.last(start, True).over(w).alias("lo"), F.first(start, True).over(w.rangeBetween(0, W.unboundedFollowing)).alias("hi")).where("is_hunk = 0")
    below, above = F.col("line") - F.col("lo"), F.col("hi") - F.col("line")
    tie = (F.col("lo") != F.col("hi")) & (below == above)
    near = F.when(F.col("hi").isNull() | (below < above), F.col("lo")).when(F.col("lo").isNull() | (above < below) | (F.col("lo") == F.col("hi")), F.col("hi"))
    return x.select("file", "line", near.alias("start"), F.when(F.col("lo").isNull() & F.col("hi").isNull(), "no hunks").when(tie, "ambiguous").alias("problem"))


def snippets(nodes: DataFrame, texts: DataFrame, max_lines: int) -> DataFrame:
    """qname, file, start_line, end_line, source, truncated: numbered lines of each symbol, at most so many (the snippet's size). texts: file, text."""
    first = F.greatest(F.col("start_line"), F.lit(1))
    last = F.least(F.col("end_line"), first + max_lines - 1)
    lines = F.slice(F.split("text", "\r\n|\r|\n"), first, F.greatest(last - first + 1, F.lit(0)))
    source = F.array_join(F.transform(lines, lambda t, i: F.concat((first + i).cast("string"), F.lit(": "), t)), "\n")
    return nodes.join(texts, "file").select("qname", "file", first.alias("start_line"), last.alias("end_line"), source.alias("source"), (F.col("end_line") > last).cast("int").alias("truncated"))


def briefs(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """qname, kind, file, line, signature of asked names; a name that no node has keeps its place with empty fields and line 0. Signatures are cut to 160 characters."""
    n = nodes.select("qname", "kind", "file", F.col("start_line").alias("line"), cap_signature(F.col("signature")).alias("signature"))
    return asked.select("qname").join(n, "qname", "left").na.fill("", ["kind", "file", "signature"]).na.fill(0, ["line"])


def community_of(asked: DataFrame, nodes: DataFrame, members: DataFrame, labels: DataFrame, cap: int = CO_MEMBERS) -> DataFrame:
    """symbol, found, reason, community, label, node_count, members, overflow_count, one row a symbol.

    Members are the first `cap` by name; overflow_count tells how many more there are. reason says why a symbol isn't found.
    """
    w = W.partitionBy("community").orderBy("qname")
    shown = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= cap).groupBy("community").agg(F.sort_array(F.collect_list("qname")).alias("members"))
    known = nodes.select(F.col("qname").alias("symbol"), F.lit(True).alias("known")).distinct()
    at = members.withColumnRenamed("qname", "symbol").join(labels.select("community", "label", "node_count"), "community").join(shown, "community")
    a = asked.select(F.col("qname").alias("symbol")).distinct().join(known, "symbol", "left").join(at, "symbol", "left")
    found = F.col("known").isNotNull() & F.col("community").isNotNull()
    reason = F.when(F.col("known").isNull(), "symbol not found").when(F.col("community").isNull(), "not in any community")
    return a.select("symbol", found.cast("int").alias("found"), reason.alias("reason"), "community", "label", "node_count", "members",
                    F.greatest(F.col("node_count") - cap, F.lit(0)).cast("long").alias("overflow_count"))

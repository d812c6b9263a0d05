"""Benchmark cases and scored runs read with their rules: good rows, and the others with the reason beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The modes that a case is run in.
MODES = ("diff_only", "graph_agent", "hybrid_agent")


def _kind(v: Column) -> Column:
    """STRING, BIGINT, VOID, ARRAY<...>, OBJECT<...> and so on; the empty text where the member is missing."""
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def _member(v: Column, name: str, type_: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", type_)


def _is_text(v: Column) -> Column:
    return (_kind(v) == "STRING") & (F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")) != "")


def _all(v: Column, rule) -> Column:
    """Whether v is a list whose items all meet the rule."""
    return F.when(_kind(v).startswith("ARRAY"), F.forall(F.try_variant_get(v, "$", "array<variant>"), rule)).otherwise(False)


def _bad_range(r: Column) -> Column:
    """Whether a variant isn't a list of two lines, the first not after the second, both from 1 on."""
    at = F.try_variant_get(r, "$", "array<bigint>")
    return ~F.coalesce(_all(r, lambda x: _kind(x) == "BIGINT") & (F.size(at) == 2) & (at[0] >= 1) & (at[0] <= at[1]), F.lit(False))


def case_reason(record: Column, position: Column) -> Column:
    """Why a record is no benchmark case, by the first rule that it breaks; null for good ones."""
    ranges, symbols, golds, findings = (_member(record, k) for k in ("changed_ranges", "changed_symbols", "gold_files", "gold_findings"))
    id_ = F.concat(F.lit("case "), F.coalesce(_member(record, "id", "string"), F.lit("None")))
    lists = F.map_values(_member(record, "changed_ranges", "map<string,variant>"))
    texts = lambda v: v.isNull() | _all(v, _is_text)
    filled = lambda v: F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")) > 0, F.lit(False))
    has = lambda text: F.concat(id_, F.lit(text))
    # fixed values: the texts of the reasons
    return (
        F.when(~_kind(record).startswith("OBJECT"), F.concat(F.lit("case "), position.cast("string"), F.lit(" must be an object")))
        .when(ranges.isNotNull() & ~_kind(ranges).startswith("OBJECT"), has(" changed_ranges must be an object"))
        .when(F.exists(lists, lambda v: ~_kind(v).startswith("ARRAY")), has(" has invalid changed_ranges"))
        .when(F.exists(lists, lambda v: F.exists(F.try_variant_get(v, "$", "array<variant>"), _bad_range)), has(" has invalid line range"))
        .when(~_is_text(_member(record, "id")), F.concat(F.lit("case "), position.cast("string"), F.lit(" requires a non-empty id")))
        .when(~texts(symbols) | ~(_all(golds, _is_text) & filled(golds)), has(" has invalid symbols or gold_files"))
        .when(~filled(symbols) & ~F.coalesce(F.size(lists) > 0, F.lit(False)), has(" requires changed_symbols or changed_ranges"))
        .when(findings.isNotNull() & ~_all(findings, lambda x: _kind(x).startswith("OBJECT")), has(" has invalid gold_findings"))
    )


def checked_cases(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good cases (case_id, symbols, ranges, gold_files, repo, base_commit, prompt) and bad records (position, reason, record) of records(position, record text).

    Text that is no JSON counts as no object. Nothing is dropped: every record is in one of the two.
    """
    r = records.select("position", "record", F.try_parse_json("record").alias("v")).withColumn("reason", case_reason(F.col("v"), F.col("position")))
    v = F.col("v")
    slashes = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    option = lambda k: F.when(_is_text(_member(v, k)), _member(v, k, "string")).alias(k)
    ranges = F.transform_keys(_member(v, "changed_ranges", "map<string,array<array<bigint>>>"), lambda k, _: slashes(k))
    good = r.where("reason IS NULL").select(
        _member(v, "id", "string").alias("case_id"), F.coalesce(_member(v, "changed_symbols", "array<string>"), F.array().cast("array<string>")).alias("symbols"),
        F.coalesce(ranges, F.create_map().cast("map<string,array<array<bigint>>>")).alias("ranges"),
        F.transform(_member(v, "gold_files", "array<string>"), slashes).alias("gold_files"), option("repo"), option("base_commit"), option("prompt"))
    return good, r.where("reason IS NOT NULL").select("position", "reason", "record")


def scored_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """case, mode, run, f1 of <path>/<case>/<mode>/run-*.json by their result.f1, and the runs without such a number (case, mode, run)."""
    t = spark.read.text(f"{path}/*/*/run-*.json", wholetext=True).select(F.split("_metadata.file_path", "/").alias("p"), F.try_parse_json("value").alias("v"))
    at = lambda i: F.url_decode(F.element_at("p", i))
    f1 = F.when(_kind(_member(F.col("v"), "result.f1")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), _member(F.col("v"), "result.f1", "double"))
    runs = t.select(at(-3).alias("case"), at(-2).alias("mode"), at(-1).alias("run"), f1.alias("f1"))
    return runs.where("f1 IS NOT NULL"), runs.where("f1 IS NULL").drop("f1")


def run_coverage(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """case, repetitions, reason of cases(case): how often each was run in every mode, or which modes lack runs or differ in number."""
    n = runs.groupBy("case").agg(*[F.count_if(F.col("mode") == m).alias(m) for m in MODES])
    n = cases.select("case").distinct().join(n, "case", "left").na.fill(0, list(MODES))
    missing = F.array_join(F.filter(F.array(*[F.when(F.col(m) == 0, m) for m in MODES]), lambda x: x.isNotNull()), ", ")
    counts = F.concat_ws(", ", *[F.concat(F.lit(f"{m}="), F.col(m).cast("string")) for m in MODES])
    name = F.concat(F.lit("case "), F.col("case").cast("string"))
    # fixed values: the texts of the reasons
    reason = F.when(missing != "", F.concat(name, F.lit(" has no scored transcripts for: "), missing)).when(
        (F.col(MODES[0]) != F.col(MODES[1])) | (F.col(MODES[0]) != F.col(MODES[2])), F.concat(name, F.lit(" has incomplete repetitions: "), counts))
    return n.select("case", F.when(reason.isNull(), F.col(MODES[0])).alias("repetitions"), reason.alias("reason"))

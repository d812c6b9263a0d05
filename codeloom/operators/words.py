"""Names in texts at word boundaries, by joins of words, and golds told apart by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What belongs to a word; texts are cut to runs of such characters and runs of others.
WORD = r"[\p{L}\p{N}_]"
#: Parts into which a frequent word's texts are dealt.
SALTS = 16


def text_runs(text: Column) -> Column:
    """The text as runs of word characters and runs of others, in turn."""
    return F.regexp_extract_all(text, F.lit(rf"{WORD}+|[^\p{{L}}\p{{N}}_]+"), F.lit(0))


def _meets(runs: Column, name: Column) -> Column:
    """Whether the runs hold the name's: whole runs, and a word next to an end of the name that is none itself."""
    n, size = F.size(name), F.size(runs)
    inner = lambda run: ~run.rlike(WORD)
    at = lambda i: (F.slice(runs, i, n) == name) & (~inner(name[0]) | (i > 1)) & (~inner(F.element_at(name, -1)) | (i + n <= size))
    return F.when(size >= n, F.exists(F.sequence(F.lit(1), size - n + 1), at)).otherwise(False)


def mentions(texts: DataFrame, names: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """id, name: the names(name) that each of texts(id, text) holds with a word boundary at both ends, each pair once.

    Distinct words of the texts meet the longest word of each name; a name of one word is met by that, others are then looked up in the runs of the text, so no
    text is compared with all names. Texts of one word are dealt into SALTS parts, to which its few names are copied.
    With asked(id, name) only those pairs are looked at, joined by text and word. Case counts; rows of one id are one text each
    and their names are united. Null and empty texts and names, and names without a word, meet nothing.
    """
    n = names.select("name").where("name <> ''").distinct().withColumn("runs", text_runs(F.col("name")))
    words = F.filter("runs", lambda r: r.rlike(WORD))
    n = n.where(F.size(words) > 0).withColumn("word", F.array_max(F.transform(words, lambda r: F.struct(F.length(r).alias("n"), r.alias("w"))))["w"])
    t = texts.select("id", "text").where("id IS NOT NULL AND text <> ''").withColumn("key", F.xxhash64("id", "text"))
    held = t.select("id", "key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"{WORD}+"), F.lit(0)))).alias("word"))
    if asked is None:
        salted = n.select("name", "runs", "word", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = held.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["word", "salt"])
    else:
        met = held.join(asked.select("id", "name").distinct().join(n, "name"), ["id", "word"])
    one = met.where(F.size("runs") == 1).select("id", "name")
    longer = met.where(F.size("runs") > 1).select("id", "key", "name", "runs").join(t.select("id", "key", "text").distinct(), ["id", "key"])
    # the runs are bound to a variable, else every place would cut the text again
    found = longer.where(F.col("text").contains(F.col("name")) & F.exists(F.array(text_runs(F.col("text"))), lambda r: _meets(r, F.col("runs")))).select("id", "name")
    return one.unionByName(found).distinct()


def gold_kinds(golds: DataFrame, names: DataFrame, texts: DataFrame) -> DataFrame:
    """case, file, kind of golds(case, file): direct if the file's text names any of the case's names(case, name), else cochange.

    texts are (file, text); files without a text are cochange. A row per distinct gold.
    """
    g = golds.select("case", "file").distinct()
    asked = g.join(names.select("case", "name").distinct(), "case")
    hits = mentions(texts.select(F.col("file").alias("id"), "text"), names, asked.select(F.col("file").alias("id"), "name")).withColumnRenamed("id", "file")
    direct = asked.join(hits, ["file", "name"], "left_semi").select("case", "file").distinct().withColumn("direct", F.lit(1))
    return g.join(direct, ["case", "file"], "left").select("case", "file", F.when(F.col("direct") == 1, "direct").otherwise("cochange").alias("kind"))

"""Line-first quality rules, all in DataFrame functions.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines are removed, and a
document that loses too much of its text is rejected. Document counts of the usual heuristics come along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
#: Largest share of its word characters, in percent, that a kept document may lose with its failing lines.
MAX_LOSS = 60
#: A line with more symbols than this percentage of its word characters is mark-up or a table.
MAX_SYMBOLS = 8
#: A line with more exclamation and question marks than this percentage of its word characters is shouting.
MAX_SHOUTS = 6
#: A line of at least this many words with no punctuation at all is a word list.
LIST_WORDS = 25
#: Words and phrases of navigation bars and page furniture; a line fails if little else is in it.
NAVIGATION = r"(?i)^\W*(?:(?:home|about(?: us)?|contact(?: us)?|log ?in|sign (?:in|up)|menu|search|next|previous|share|tweet|read more|back to top|skip to content)\b[\s\W]*)+$"
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "accept cookies", "accept all cookies",
    "uses cookies", "enable javascript", "subscribe to our", "click here to", "licensed under", "released under the",
    "copyright (c)", "copyright ©", "copyright 19", "copyright 20", "lorem ipsum",
)
_SPACES = r"[ \t-\r]+"
_SYMBOLS = r"[#*$%&|<>]+"


def _size(text: Column, without: str) -> Column:
    return F.char_length(F.regexp_replace(text, without, ""))


def _judged(text: Column) -> Column:
    """The lines of a text, blank ones too, with their characters that are not white space and whether a rule fails them."""
    measured = F.transform(F.split(text, "\n"), lambda x: F.struct(
        x.alias("line"), F.lower(x).alias("low"), _size(x, _SPACES).alias("size"),
        (F.char_length(x) - _size(x, _SYMBOLS)).alias("symbols"),
        (F.char_length(x) - F.char_length(F.replace(F.replace(x, F.lit("!"), F.lit("")), F.lit("?"), F.lit("")))).alias("shouts"),
    ))
    return F.transform(measured, lambda x: F.struct(x.getField("line").alias("line"), x.getField("size").alias("size"), _line_fails(x).alias("fails")))


def _line_fails(x: Column) -> Column:
    """The line rules, over a measured line; `size` counts characters that are not white space."""
    line, low, size = x.getField("line"), x.getField("low"), x.getField("size")
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | F.contains(low, F.lit(phrase))
    return (
        (x.getField("symbols") * 100 > size * MAX_SYMBOLS)
        | (x.getField("shouts") * 100 > size * MAX_SHOUTS)
        | ((size > LIST_WORDS) & ~line.rlike(r"[.,;:!?…。、]") & line.rlike(rf"(?:\S+\s+){{{LIST_WORDS - 1}}}\S"))
        | line.rlike(NAVIGATION)
        | boilerplate
    )


def quality_features(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, clean.

    Words are runs without ASCII white space; null texts have none. n_repeat_words counts the words inside
    5-word windows that the text has twice or more. lost_chars are the word characters of failing lines, clean is the
    text without them (the text itself where no line fails; null texts are empty).
    """
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", t.alias("text"))
    d = d.select(
        "doc_id", "text",
        F.filter(F.split("text", _SPACES), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"),
        _judged(F.col("text")).alias("judged"),
    )
    fails, line = (lambda x: x.getField("fails")), (lambda x: x.getField("line"))
    d = d.select(
        "doc_id",
        F.size("words").alias("n"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        F.aggregate("words", F.lit(0), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        (F.char_length("text") - _size(F.col("text"), _SYMBOLS)).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.aggregate(F.filter("judged", fails), F.lit(0), lambda a, x: a + x.getField("size")).alias("lost_chars"),
        F.array_join(F.transform(F.filter("judged", lambda x: ~fails(x)), line), "\n").alias("clean"),
    )
    counts = ["doc_id", "n", "word_chars", "n_symbols", "n_dup_lines", "lost_chars", "clean"]
    at = lambda i, k: F.get("h", i + F.lit(k))
    d = d.select(*counts, F.when(
        F.col("n") >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.col("n") - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])),
    ).alias("runs"))
    d = d.select(*counts, F.when(
        F.size(F.array_distinct("runs")) < F.size("runs"),
        F.sort_array(F.transform("runs", lambda k, i: F.struct(k.alias("k"), i.alias("i")))),
    ).alias("runs"))
    same = lambda x, i: x.getField("k") == F.get("runs", i).getField("k")
    d = d.select(*counts, F.sort_array(F.transform(
        F.filter("runs", lambda x, i: F.coalesce(same(x, i - 1), F.lit(False)) | F.coalesce(same(x, i + 1), F.lit(False))),
        lambda x: x.getField("i"),
    )).alias("at"))
    covered = F.transform("at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("at", i + 1) - x, F.lit(WINDOW))))
    long = lambda c: F.col(c).cast("long").alias(c)
    out = F.struct(
        "doc_id", F.col("n").cast("long").alias("n_words"), long("word_chars"), long("n_symbols"), long("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        long("lost_chars"), "clean",
    )
    # a generator of one row: filters on the features stay above it, where they would else repeat the features' work
    return d.select(F.explode(F.array(out)).alias("x")).select("x.*")


def quality_verdicts(docs: DataFrame, *, max_loss: int = MAX_LOSS) -> DataFrame:
    """The features, then clean_chars (code points of the cleaned text), base_failed and kept.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated windows. kept: not base_failed,
    and the failing lines hold at most `max_loss` percent of the word characters. Null and empty texts fail;
    repeated rows and null doc_ids each keep their row; an empty table gives an empty result. Other columns
    are not read.
    """
    d = quality_features(docs)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    kept = ~failed & (100 * F.col("lost_chars") <= max_loss * F.col("word_chars"))
    return d.withColumns({"clean_chars": F.char_length("clean").cast("long"), "base_failed": failed, "kept": kept})


def keep_quality(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that pass, with their texts cleaned of failing lines and all other columns as they came.

    No row is judged by doc_id, so null and repeated ids are fine: each row passes or goes by its own text.
    Null and empty texts go; an empty table gives none.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text")
    passed = quality_verdicts(keyed, **options).where("kept")
    return passed.select(*[F.col("clean").alias("text") if c == "text" else F.col(f"doc_id.`{c}`") for c in docs.columns])

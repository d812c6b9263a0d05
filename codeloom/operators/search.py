"""Search over symbols: BM25 with prefixes and phrases, globs and infix matches."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.names import glob_match, normal_tokens, short
from codeloom.operators.flows import saved

K1, B = 1.2, 0.75
#: Kinds of symbols that searches return, and the searched columns.
KINDS = ("function", "method", "class")
FIELDS = ("qname", "file", "signature", "decorators", "end_line")


def terms(query: str) -> list[list[str]]:
    """The query's words; each is a phrase of tokens whose last one is a prefix.

    Of a word only letters, digits and underscores count, so `a-b` is `ab`, and underscores part its tokens. Words without a
    letter or digit vanish. Words that are operators of other search languages are words like all others.
    """
    out = []
    for word in query.split():
        kept = "".join(c for c in word if c.isalnum() or c == "_")
        plain = "".join(c for c in unicodedata.normalize("NFD", kept.lower()) if not unicodedata.combining(c))
        tokens = [t for t in plain.split("_") if t]
        if tokens:
            out.append(tokens)
    return out


def searchable(nodes: DataFrame) -> DataFrame:
    """Functions, methods and classes, with their decorators as one text."""
    return nodes.where(F.col("kind").isin(*KINDS)).withColumn("decorators", F.concat_ws(" ", "decorators"))


def postings(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """id, field, pos, token: every token of every searched column."""
    fields = F.array(*[normal_tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])
    return docs.select(F.col(id_col).alias("id"), F.posexplode(fields).alias("field", "tokens")).select("id", "field", F.posexplode("tokens").alias("pos", "token"))


def bm25(docs: DataFrame, query: str, id_col: str, columns: list[str], limit: int | None = None) -> DataFrame:
    """id, score (lower is better): documents that hold every phrase of the query.

    tf counts a phrase's places in all columns, |D| all tokens; idf is floored at 1e-6. The counts are over all documents,
    which are read and tokenised once: each gives its length and its count of every phrase, and only sums are shuffled.
    """
    wanted = terms(query)
    if not wanted:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where("false")
    names = [f"t{i}" for i in range(len(columns))]
    d = docs.select(F.col(id_col).alias("id"), *[normal_tokens(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(n) for c, n in zip(columns, names, strict=True)])

    def places(tokens: str, phrase: list[str]) -> Column:
        def there(x: Column, i: Column) -> Column:
            ok = F.lit(True)
            for k, t in enumerate(phrase):
                at = F.coalesce(F.get(tokens, i + k), F.lit(""))
                ok = ok & (at.startswith(t) if k == len(phrase) - 1 else at == t)
            return ok
        return F.size(F.filter(tokens, there))

    total = lambda parts: sum(parts[1:], parts[0])
    tf = [f"tf{k}" for k in range(len(wanted))]
    d = saved(d.select("id", total([F.size(n) for n in names]).alias("len"), *[total([places(n, p) for n in names]).alias(c) for c, p in zip(tf, wanted, strict=True)]))
    stats = d.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *[F.count_if(F.col(c) > 0).alias(f"df_{c}") for c in tf])
    parts, every = [], F.lit(True)
    for c in tf:
        raw = F.ln((F.col("n") - F.col(f"df_{c}") + 0.5) / (F.col(f"df_{c}") + 0.5))
        norm = F.col(c) + K1 * (1 - B + B * F.col("len") / F.col("avgdl"))
        parts.append(F.when(raw <= 0, F.lit(1e-6)).otherwise(raw) * F.col(c) * (K1 + 1) / norm)
        every = every & (F.col(c) > 0)
    out = d.where(every).crossJoin(F.broadcast(stats)).select("id", (-total(parts)).alias("score"))
    return out if limit is None else out.orderBy("score", "id").limit(limit)


_SHOWN = ("qname", "kind", "file", "start_line", "end_line", "signature")


def glob_search(nodes: DataFrame, pattern: str) -> DataFrame:
    """Functions, methods and classes whose short name matches a glob: id and what is shown of a symbol."""
    return searchable(nodes).where(glob_match(short(F.col("qname")), [pattern])).select("id", *_SHOWN)


def infix_search(nodes: DataFrame, text: str) -> DataFrame:
    """Functions, methods and classes that contain a text in name, file, signature, decorators or last line, in either case."""
    n = searchable(nodes)
    joined = F.concat_ws(" ", "qname", "file", F.coalesce("signature", F.lit("")), "decorators", F.col("end_line").cast("string"))
    return n.where(F.contains(F.lower(joined), F.lit(text.lower()))).select("id", *_SHOWN)


def search(nodes: DataFrame, query: str, limit: int = 30) -> DataFrame:
    """qname, kind, file, start_line, end_line, signature, score: globs match short names; words are ranked by BM25; without a hit, infix matches count.

    Globs and infix matches have no score and come by id. The statistics are over the symbols that can be found.
    """
    none = F.lit(None).cast("double").alias("score")
    if "*" in query or "?" in query:
        return glob_search(nodes, query).orderBy("id").limit(limit).select(*_SHOWN, none)
    if not terms(query):
        return nodes.select(*_SHOWN, none).where("false")
    ranked = bm25(searchable(nodes), query, "qname", list(FIELDS), limit)
    if ranked.isEmpty():
        return infix_search(nodes, query).orderBy("id").limit(limit).select(*_SHOWN, none)
    # at most `limit` rows
    return nodes.join(F.broadcast(ranked.withColumnRenamed("id", "qname")), "qname").select(*_SHOWN, "score").orderBy("score", "qname")

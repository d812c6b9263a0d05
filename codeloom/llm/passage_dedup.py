"""Repeated passages by line and paragraph hashing, and by hashing of units cut by their own content inside of lines.

A passage is repeated word for word where runs of RUN_WORDS words (grams) occur earlier. Every gram is named by the
least hash among its pieces of UNIT_WORDS words, its anchor (winnowing: ties go to the last one), and neighbouring
grams with one anchor are one unit. So equal grams always have equal anchors, wherever they stand, and units inside a
repeated passage are equal throughout; only at its edges do equal grams lie in unequal units. Units are normalised
(A-Z lower-cased, white space single), their digests are grouped over all documents, the earliest occurrence is kept,
and all others are removed by offset. Whole lines and paragraphs of LINE_WORDS words or more are units too, by
themselves. Where units that differ share an anchor, their grams are grouped one by one, which gives the passage's
true edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import textnp
from codeloom.llm.io import discard, materialise, prepare

#: Words of the pieces that anchors are chosen from; words of a gram, the least run that is removed.
UNIT_WORDS, RUN_WORDS = 10, 20
#: Least words of a line or paragraph that is removed whole where it occurs earlier as a line or paragraph. A shorter line
#: goes only as part of a repeated paragraph: headings, list marks and closing braces recur in texts that share nothing.
LINE_WORDS = 5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class _Words:
    """The words of a slice of documents, with digests of any run of them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends, self.first = textnp.word_spans(data, offsets)
        self.n = len(self.starts)
        self.total = np.zeros(self.n + 1, np.uint64)
        np.cumsum(textnp.word_hashes(data, self.starts, self.ends) * _powers(_BASE, self.n), out=self.total[1:])
        self.inverse = _powers(_INVERSE, self.n + 1)

    def digest(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return textnp.mix64((self.total[end] - self.total[at]) * self.inverse[at] + (end - at).astype(np.uint64))


def unit_spans(words: _Words, unit_words: int, run_words: int):
    """Anchor's digest, unit's digest, row, first and last word (over the slice) of every unit."""
    pieces, window = words.n - unit_words + 1, run_words - unit_words + 1
    row_end = np.repeat(words.first[1:], np.diff(words.first))
    grams = np.flatnonzero(np.arange(words.n) + run_words <= row_end)
    if not len(grams):
        return *(np.zeros(0, np.uint64) for _ in range(2)), *(np.zeros(0, np.int64) for _ in range(3))
    at = np.arange(pieces)
    hashes = words.digest(at, at + unit_words)
    least, anchor = hashes[grams], grams.copy()
    for k in range(1, window):
        h = hashes[grams + k]
        lower = h <= least
        least = np.where(lower, h, least)
        anchor[lower] = grams[lower] + k
    row = np.searchsorted(words.first, grams, "right") - 1
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]
    head = np.flatnonzero(new)
    begin, end = grams[head], grams[np.r_[head[1:], len(grams)] - 1] + run_words
    return least[head], words.digest(begin, end), row[head], begin, end


def line_spans(words: _Words, line_words: int):
    """Digest, row, first and last word (over the slice) of every whole line, and of every paragraph of several lines."""
    row_start = np.zeros(words.n + 1, bool)
    row_start[words.first] = True
    breaks = np.r_[0, np.cumsum(words.data == 10)]
    gap = np.r_[0, breaks[words.starts[1:]] - breaks[words.ends[:-1]]] if words.n else np.zeros(0, np.int64)
    found = []
    for least in (1, 2):
        begin = np.flatnonzero(row_start[:-1] | (gap >= least))
        end = np.r_[begin[1:], words.n][: len(begin)]
        found.append((begin, end))
    (begin, end), (p0, p1) = found
    lines = np.searchsorted(begin, p1) - np.searchsorted(begin, p0)
    begin, end = np.r_[begin, p0[lines > 1]], np.r_[end, p1[lines > 1]]
    ok = end - begin >= line_words
    begin, end = begin[ok], end[ok]
    return textnp.mix64(~words.digest(begin, end)), np.searchsorted(words.first, begin, "right") - 1, begin, end


def _units(unit_words: int, run_words: int, line_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textnp.column_bytes(batch.column("text"))
            for i, j in textnp.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                words = _Words(part, at)
                found, lines = unit_spans(words, unit_words, run_words), line_spans(words, line_words)
                anchor, digest, row, begin, end = (np.r_[a, b] for a, b in zip(found, (lines[0], *lines), strict=True))
                yield _placed(words, part, at, batch.slice(i, j - i), row, begin, end, anchor=anchor, digest=digest)
    return run


def _placed(words: _Words, part, at, rows: pa.RecordBatch, row, begin, end, **digests) -> pa.RecordBatch:
    """Digests with the document, words and code points of their runs."""
    points = textnp.code_points_before(part)
    base, w = points[at[row]], words.first[row]
    places = (begin - w, end - w, points[words.starts[begin]] - base, points[words.ends[end - 1]] - base)
    return pa.RecordBatch.from_arrays(
        [*(pa.array(x.view(np.int64)) for x in digests.values()), *(rows.column(k).take(pa.array(row)) for k in ("doc_id", "text_hash")),
         *(pa.array(x.astype(np.int32)) for x in places)],
        [*digests, "doc_id", "text_hash", "w0", "w1", "start", "end"],
    )


def _grams(run_words: int):
    """Every gram of the listed units of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textnp.column_bytes(batch.column("text"))
            for i, j in textnp.slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                words = _Words(part, at)
                listed = batch.column("spans").slice(i, j - i)
                row = listed.value_parent_indices().to_numpy()
                spans = listed.flatten()
                w0, w1 = (spans.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                n = w1 - w0 - run_words + 1
                row, within = np.repeat(row, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = words.first[row] + np.repeat(w0, n) + within
                ok = begin + run_words <= words.first[row + 1]
                row, begin = row[ok], begin[ok]
                yield _placed(
                    words, part, at, batch.slice(i, j - i), row, begin, begin + run_words,
                    digest=words.digest(begin, begin + run_words),
                )
    return run


def repeated_passages(docs: DataFrame, *, unit_words: int = UNIT_WORDS, run_words: int = RUN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """The runs to remove: doc_id, start, end (code points of the original text, end exclusive), n_words, first_doc_id, text_hash.

    A word is in a run if it is in a gram of `run_words` words that occurs earlier, by doc_id, text_hash and then place, in
    this or another document, without overlap of the two, or in a line or paragraph of `line_words` words or more that occurs
    earlier as a line or paragraph, whatever stands around it; overlapping or adjacent grams are one run. first_doc_id is
    the least document that has one of its units (at its edges, grams) first. A document is a doc_id with a text (text_hash
    is xxhash64 of it), so rows of one id or of no id that differ in text are documents of their own, and rows that repeat
    both are one occurrence. Null and empty texts have no units. A null doc_id ranks first. An empty table gives an empty
    result. Only doc_id and text are read.
    """
    if not 0 < unit_words <= run_words:
        raise ValueError("unit_words must be from 1 to run_words")
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = "doc_id long, text_hash long, w0 int, w1 int, start int, end int"
    units = docs.mapInArrow(_units(unit_words, run_words, line_words), f"anchor long, digest long, {found}")
    place = F.struct("doc_id", "text_hash", "w0")
    by_unit = units.groupBy("anchor", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # per anchor: its digests that repeat with their first places, and whether units differ; a row that repeats counts too, and goes below as it isn't apart
    by_unit = materialise(by_unit.select("anchor", "digest", "first", (F.col("n") > 1).alias("again")))
    forked = by_unit.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.lit(True).alias("forked"))
    wanted = materialise(by_unit.join(forked, "anchor", "left").where("again OR forked").select("digest", "first", "forked"))
    discard(spark, by_unit)
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash")))
    # units of equal digest are shorter than a gram only if they are whole lines or paragraphs
    apart = other | (F.col("w0") >= F.col("first.w0") + F.least(F.lit(run_words), F.col("w1") - F.col("w0")))
    of = F.col("first.doc_id").alias("of")
    at = ("doc_id", "text_hash", "w0", "w1", "start", "end")
    placed = materialise(units.drop("anchor").join(wanted, "digest").select(
        *at, of, apart.alias("apart"), "forked"
    ).where("apart OR forked").distinct())
    discard(spark, wanted)
    listed = placed.where(~F.col("apart") & (F.col("w1") - F.col("w0") >= run_words)).groupBy(F.col("doc_id").alias("id"), "text_hash").agg(
        F.collect_list(F.struct("w0", "w1")).alias("spans")
    )
    same_doc = F.col("doc_id").eqNullSafe(F.col("id")) & (docs.text_hash == listed.text_hash)
    grams = materialise(
        docs.join(listed, same_doc).select("doc_id", docs.text_hash, "text", "spans").mapInArrow(_grams(run_words), f"digest long, {found}")
    )
    common = grams.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    edges = grams.join(common, "digest").where(apart).select(*at, of)
    later = placed.where("apart").select(*at, "of").union(edges).select(
        "doc_id", "text_hash", F.struct("w0", "w1", "start", "end", "of").alias("u")
    )
    listed = later.distinct().groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("u")).alias("units"))
    empty = F.array().cast("array<struct<w0:int,w1:int,start:int,end:int,of:bigint>>")
    joined = F.aggregate("units", empty, lambda runs, u: F.when(
        (F.size(runs) > 0) & (u.w0 <= F.element_at(runs, -1).w1),
        F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(
            F.element_at(runs, -1).w0.alias("w0"), F.greatest(F.element_at(runs, -1).w1, u.w1).alias("w1"),
            F.element_at(runs, -1).start.alias("start"), F.greatest(F.element_at(runs, -1).end, u.end).alias("end"),
            F.least(F.element_at(runs, -1).of, u.of).alias("of"),
        ))),
    ).otherwise(F.concat(runs, F.array(u))))
    run = F.col("r")
    return listed.select("doc_id", "text_hash", F.explode(joined).alias("r")).select(
        "doc_id", run.start.cast("long").alias("start"), run.end.cast("long").alias("end"),
        (run.w1 - run.w0).cast("long").alias("n_words"), run.of.alias("first_doc_id"), "text_hash",
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            at, parts = 0, []
            for r in runs or []:
                parts.append(text[at : r["start"]])
                at = r["end"]
            texts.append(None if text is None else "".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), batch.column(2)], ["doc_id", "text", "removed"]
        )


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the text without its repeated runs, and the removed runs with their original offsets (null if none).

    One row per row of `docs`: rows that repeat a doc_id and text keep the same words. Null and empty texts stay as they
    are; a null doc_id is cleaned by its text; an empty table gives none.
    """
    runs = repeated_passages(docs, **options).groupBy(F.col("doc_id").alias("id"), "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "first_doc_id"))).alias("removed")
    )
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("text_hash"))
    return docs.select("doc_id", "text").join(runs, same, "left").select("doc_id", "text", "removed").mapInArrow(
        _cut, "doc_id long, text string, removed array<struct<start:bigint,end:bigint,first_doc_id:bigint>>"
    )

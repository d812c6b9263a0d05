"""Ranked lexical search by bit-sliced Bloom signatures.

Documents are laid out in blocks of similar numbers of terms. A block keeps, for each bit of its signatures, one bitmap
over its documents (a slice), so the documents that may hold a term are the AND of a few slices. Terms that occur
2, 4, 8 or 16 times are entered once more for each such level. A level that a document seems to have bounds how often it
has the term, so the sum of the slices of an item's terms, weighted with what each level adds to a score, is at least
its score. All documents whose sum reaches the tenth best score found so far are scored from their texts.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codeloom.llm import textnp
from codeloom.llm.io import materialise, prepare

TOP = 10
#: A level bounds the occurrences of a term up to the next level; the last has no bound.
LEVELS = (1, 2, 4, 8, 16)
HASHES, BITS_AN_ENTRY = 4, 8
#: Documents and text of a block, bits of its signatures; text of the queries of one pass; items that are summed at once.
BLOCK_DOCS, BLOCK_TEXT, BLOCK_BITS, QUERY_BYTES, ITEMS_AT_ONCE = 1024, 2 << 20, 1 << 23, 8 << 20, 256
_SEED = np.uint64(0x9E3779B97F4A7C15)
#: What terms are made of, in UTF-8 bytes: ASCII letters and digits and all that isn't ASCII.
_TERM = np.ones(256, bool)
_TERM[:128] = [chr(c).isalnum() for c in range(128)]


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every term of every row, and the row of each. A-Z count as a-z."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | edge[:-1]))
    ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1
    return textnp.word_hashes(data, starts, ends), np.searchsorted(offsets, starts, "right") - 1


def _counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of each row, ordered by row: hashes, rows, occurrences; and the number of terms of each row."""
    data, offsets = textnp.column_bytes(column)
    parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    totals = np.zeros(len(offsets) - 1, np.int64)
    for i, j in textnp.slices(offsets):
        # texts of a slice are taken together, a long one in parts
        cuts = list(_cuts(data[offsets[i] : offsets[j]])) if j == i + 1 else [(0, int(offsets[j] - offsets[i]))]
        some = []
        for a, b in cuts:
            base = offsets[i] + a
            h, row = _terms(data[base : base + b - a], np.clip(offsets[i : j + 1] - base, 0, b - a))
            totals[i:j] += np.bincount(row, minlength=j - i)
            some.append(_sum_up(h, row + i, np.ones(len(h), np.int64)))
        parts.append(some[0] if len(some) == 1 else _sum_up(*(np.concatenate(x) for x in zip(*some, strict=True))))
    return (*(np.concatenate(x) for x in zip(*parts, strict=True)), totals)


def _cuts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of a long text that end between terms."""
    gaps = np.flatnonzero(~_TERM[data]) + 1 if len(data) > 4 * textnp.SLICE_BYTES else np.zeros(0, np.int64)
    a = 0
    while len(data) - a > 4 * textnp.SLICE_BYTES and len(gaps):
        k = int(np.searchsorted(gaps, a + 4 * textnp.SLICE_BYTES, "right"))
        b = int(gaps[k - 1]) if k and gaps[k - 1] > a else int(gaps[k]) if k < len(gaps) else len(data)
        yield a, b
        a = b
    if a < len(data) or not len(data):
        yield a, len(data)


def _sum_up(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    h, row, n = h[order], row[order], n[order]
    if not len(h):
        return h, row, n
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
    return h[new], row[new], np.add.reduceat(n, new)


def _places(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The bits of terms at a level: one column each of HASHES."""
    a = textnp.mix64(h + np.uint64((level * int(_SEED)) & 0xFFFFFFFFFFFFFFFF))
    b = textnp.mix64(a ^ _SEED) | np.uint64(1)
    return np.stack([(a + np.uint64(k) * b) & np.uint64(bits - 1) for k in range(HASHES)], 1).astype(np.int64)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as blocks: ids, lengths in terms, texts and the slices of their signatures."""
    waiting: dict[int, list] = {}

    def block(bits: int) -> pa.RecordBatch:
        rows, _ = waiting.pop(bits)
        ids, lengths, texts, hashes, counts = zip(*rows, strict=True)
        width = -(-len(rows) // 8)
        flat = np.zeros(bits * width, np.uint8)
        h, n = np.concatenate(hashes), np.concatenate(counts)
        doc = np.repeat(np.arange(len(rows)), [len(x) for x in hashes])
        for level in LEVELS:
            on = n >= level
            at = _places(h[on], level, bits) * width + (doc[on] >> 3)[:, None]
            np.bitwise_or.at(flat, at.ravel(), np.repeat((1 << (doc[on] & 7)).astype(np.uint8), HASHES))
        return pa.RecordBatch.from_arrays(
            [pa.array([list(ids)], pa.list_(pa.int64())), pa.array([list(lengths)], pa.list_(pa.int64())),
             pa.array([list(texts)], pa.list_(pa.string())), pa.array([bits], pa.int64()), pa.array([flat.tobytes()], pa.binary())],
            ["ids", "lengths", "texts", "bits", "slices"],
        )

    for batch in batches:
        h, row, n, totals = _counted(batch.column(1))
        first = np.searchsorted(row, np.arange(batch.num_rows + 1))
        entries = sum(np.bincount(row[n >= level], minlength=batch.num_rows) for level in LEVELS)
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        for r in np.flatnonzero(totals).tolist():
            bits = 1 << max(8, int(BITS_AN_ENTRY * entries[r] - 1).bit_length())
            rows, size = waiting.setdefault(bits, ([], [0]))
            text = texts[r].as_py()
            rows.append((ids[r], int(totals[r]), text, h[first[r] : first[r + 1]], n[first[r] : first[r + 1]]))
            size[0] += len(text)
            if len(rows) >= max(8, min(BLOCK_DOCS, BLOCK_BITS // bits)) or size[0] >= BLOCK_TEXT:
                yield block(bits)
    for bits in list(waiting):
        yield block(bits)


def signature_index(docs: DataFrame) -> DataFrame:
    """The index of all documents with a term, one row per block, in the shared folder; it knows of no query."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return materialise(rows.mapInArrow(_index, "ids array<long>, lengths array<long>, texts array<string>, bits long, slices binary"))


class Queries:
    """Items as terms with weights (repeats included), a row for each; and where the terms of a vocabulary are asked for."""

    def __init__(self, texts: list[str]) -> None:
        h, self.item, self.repeats, _ = _counted(pa.array(texts, pa.string()))
        self.vocabulary, self.term = np.unique(h, return_inverse=True)
        self.n_items, self.weights = len(texts), np.zeros(0, np.int64)
        self.by_term = np.argsort(self.term, kind="stable")
        self.asked = np.searchsorted(self.term[self.by_term], np.arange(len(self.vocabulary) + 1))

    def weigh(self, n_docs: int, frequency: dict[int, int]) -> None:
        w = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency.get(k, 0) + 1))) for k in range(len(self.vocabulary))]
        self.weights = np.array(w, np.int64)[self.term] * self.repeats if len(w) else np.zeros(0, np.int64)

    def slice_sums(self, first: int, last: int, seems: np.ndarray) -> np.ndarray:
        """The sum of the weights of the terms that each document (a column) seems to have, for items first to last."""
        out = np.zeros((last - first, seems.shape[1]))
        lo, hi = np.searchsorted(self.item, [first, last])
        use = lo + np.flatnonzero(seems.any(1)[self.term[lo:hi]])
        if not len(use):
            return out.astype(np.int64)
        # the k-th terms of all items that have as many are added at once; weights are whole and their sums far under 2 ** 53
        item = self.item[use] - first
        new = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
        size = np.diff(np.r_[new, len(use)])
        order = np.argsort(-size, kind="stable")
        new, size = new[order], size[order]
        total = np.zeros((len(new), seems.shape[1]))
        for k in range(int(size[0])):
            n = int(np.searchsorted(-size, -k, "left"))
            at = use[new[:n] + k]
            total[:n] += seems[self.term[at]] * self.weights[at, None].astype(np.float64)
        out[item[new]] = total
        return out.astype(np.int64)

    def scores(self, first: int, last: int, term: np.ndarray, doc: np.ndarray, share: np.ndarray, n: int) -> np.ndarray:
        """The scores of n documents for items first to last, from the share that each term of each document adds."""
        times = self.asked[term + 1] - self.asked[term]
        at = np.repeat(self.asked[term] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        row = self.by_term[at]
        on = (self.item[row] >= first) & (self.item[row] < last)
        row, entry = row[on], np.repeat(np.arange(len(term)), times)[on]
        out = np.zeros((last - first, n), np.int64)
        np.add.at(out, (self.item[row] - first, doc[entry]), self.weights[row] * share[entry])
        return out


def _statistics(docs: DataFrame, vocabulary: np.ndarray) -> tuple[int, int, dict[int, int]]:
    """Documents with a term, terms in all, and the documents that hold each term of the vocabulary (by its place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, total = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            h, _, _, totals = _counted(batch.column(0))
            n, total = n + int((totals > 0).sum()), total + int(totals.sum())
            if len(vocabulary):
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                held += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        on = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, on]), pa.array(np.r_[n, total, held[on]])], ["term", "n"])

    counts = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = dict(counts.collect())
    return found.pop(-2, 0) or 0, found.pop(-1, 0) or 0, found


def _m(lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    if len(lengths) and 75 * int(lengths.max()) * n_docs >= 1 << 63:
        return np.array([25 + (75 * n * n_docs) // n_terms for n in lengths.tolist()], np.int64)
    return 25 + (75 * lengths * n_docs) // n_terms


def _share(tf: np.ndarray | int, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _bounds(queries: Queries, bits: int, slices: np.ndarray, m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(presence of the terms, what it adds to a score) by level, a column a document."""
    out, seems, below = [], None, np.zeros(len(m), np.int64)
    for k, level in enumerate(LEVELS):
        at = _places(queries.vocabulary, level, bits)
        here = slices[at[:, 0]]
        for x in range(1, HASHES):
            here = here & slices[at[:, x]]
        seems = here if seems is None else seems & here
        most = _share(LEVELS[k + 1] - 1, m) if k + 1 < len(LEVELS) else np.full(len(m), 1_000_000, np.int64)
        out.append((np.unpackbits(seems, axis=1, bitorder="little")[:, : len(m)], most - below))
        below = most
    return out


def _search(queries: Queries, n_docs: int, n_terms: int, top: int):
    """The best documents of each task for each item: every one that isn't shown to be below the best found is scored."""

    def exact(texts: pa.Array, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms of the vocabulary in the texts: (term, text, what it adds to a score before weights)."""
        h, row, n, _ = _counted(texts)
        at = np.minimum(np.searchsorted(queries.vocabulary, h), len(queries.vocabulary) - 1)
        on = queries.vocabulary[at] == h
        return at[on], row[on], _share(n[on], m[row[on]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # heaps of (score, falling id); a null id comes after all others
        best: list[list[tuple[int, float]]] = [[] for _ in range(queries.n_items)]
        least = np.ones(queries.n_items, np.int64)

        def score(docs: np.ndarray, wanted: np.ndarray, first: int, texts: pa.Array, ids: list, m: np.ndarray) -> None:
            """Scores documents for the items (from `first` on) that want them."""
            last = first + len(wanted)
            sums = queries.scores(first, last, *exact(texts.take(pa.array(docs)), m[docs]), len(docs))
            for i, d in zip(*np.nonzero(wanted[:, docs] & (sums >= least[first:last, None])), strict=True):
                doc = ids[docs[d]]
                entry, heap = (int(sums[i, d]), -math.inf if doc is None else -doc), best[first + i]
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == top:
                    least[first + i] = heap[0][0]

        for batch in batches:
            for r in range(batch.num_rows):
                bits, ids = batch.column(3)[r].as_py(), batch.column(0)[r].as_py()
                m = _m(np.array(batch.column(1)[r].as_py(), np.int64), n_docs, n_terms)
                slices = np.frombuffer(batch.column(4)[r].as_buffer(), np.uint8).reshape(bits, -1)
                levels = _bounds(queries, bits, slices, m)
                texts = batch.column(2)[r].values
                for first in range(0, queries.n_items, ITEMS_AT_ONCE):
                    last = min(first + ITEMS_AT_ONCE, queries.n_items)
                    bound = sum(queries.slice_sums(first, last, seems) * adds for seems, adds in levels)
                    wanted = bound >= least[first:last, None]
                    if not wanted.any():
                        continue
                    # the highest bounds first: they raise what the others must reach
                    k = min(top, bound.shape[1])
                    lead = np.unique(np.argpartition(-bound, k - 1, axis=1)[wanted.any(1), :k])
                    score(lead, wanted, first, texts, ids, m)
                    wanted[:, lead] = False
                    wanted &= bound >= least[first:last, None]
                    rest = np.flatnonzero(wanted.any(0))
                    if len(rest):
                        score(rest, wanted, first, texts, ids, m)
        rows = [(i, None if key == -math.inf else -key, s) for i, heap in enumerate(best) for s, key in heap]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["item", "doc_id", "score"])

    return run


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[list[int | None], list[str]]]:
    """The distinct items with a text in blocks of bounded bytes, one on the driver at a time."""
    ids, texts, size = [], [], 0
    for x in benchmark.select("item_id", "text").where("text is not null").distinct().toLocalIterator():
        ids.append(x[0])
        texts.append(x[1])
        size += len(x[1].encode())
        if size >= limit:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def ranked(docs: DataFrame, benchmark: DataFrame, *, top: int = TOP, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The `top` best documents of each item with a score above 0: item_id, rank (from 1), doc_id, score.

    Equal scores are ranked by rising doc_id, a null doc_id last. Repeated rows of `docs` are ranked each; of items that repeat an
    id and a text one is asked, and an id with several texts has a ranking for each. Null texts, and texts and
    items without terms, have no score; an empty table gives no rows. Very long texts are read in parts. Items
    are the stated queries: they are read in blocks of bounded bytes, each against the whole index. Other columns
    are not read. Counts and scores are exact; terms are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    prepare(spark)
    schema, out, index = "item_id long, rank int, doc_id long, score long", None, None
    for ids, texts in _blocks(benchmark, query_bytes):
        queries = Queries(texts)
        n_docs, n_terms, frequency = _statistics(docs, queries.vocabulary)
        if not n_terms or not len(queries.vocabulary):
            continue
        queries.weigh(n_docs, frequency)
        index = signature_index(docs) if index is None else index
        found = index.mapInArrow(_search(queries, n_docs, n_terms, top), "item long, doc_id long, score long")
        order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), "item long, item_id long"))
        part = (
            found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(names, "item")
            .select("item_id", "rank", "doc_id", "score")
        )
        part = materialise(part)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


#: The contract in SQL: terms, weights and scores over all documents, ranked.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM documents),
i AS (
  SELECT item_id, t, count(*) AS q FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM benchmark) GROUP BY item_id, t),
lengths AS (SELECT r, count(*) AS n FROM d GROUP BY r),
a AS (SELECT count(*) AS nd, sum(n)::BIGINT AS l FROM lengths),
tf AS (SELECT r, doc_id, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM i) GROUP BY r, doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, a GROUP BY t),
s AS (
  SELECT i.item_id, tf.r, tf.doc_id, sum(i.q * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * lengths.n * a.nd) // a.l))))::BIGINT AS score
  FROM i JOIN tf USING (t) JOIN w USING (t) JOIN lengths USING (r), a GROUP BY i.item_id, tf.r, tf.doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 10
"""

"""Benchmark decontamination by the q-gram lemma.

Two strings of length w within e edits share at least w - q + 1 - q * e of their q-grams, all of them on
diagonals that differ by at most e. Shared q-grams are therefore counted per window of a benchmark item and
per diagonal band; bands overlap by half, so no run of e diagonals is cut. Bands that reach the bound are
verified by banded alignment, and only windows within the edit budget count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import textnp
from codeloom.llm.io import materialise, prepare, small

Q, WINDOW, EDIT_PERCENT = 12, 64, 6
#: Benchmark text of one pass over the documents; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20
#: Entries of the index that are held at a time; length of the q-grams that are counted again before a window is aligned.
PAIRS, Q_SHORT = 2_000_000, 4
_FILTER_BITS = 22
_SEED = np.uint64(0x9E3779B97F4A7C15)

#: What is compared: letters, digits and all that isn't ASCII, in lower case.
_KEEP = np.ones(256, bool)
_KEEP[:128] = [chr(c).isalnum() for c in range(128)]


def _normalised(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes and offsets, then the compared bytes and their offsets. Lower-casing keeps code points one to one."""
    data, offsets = textnp.column_bytes(pc.utf8_lower(column))
    keep = _KEEP[data]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    return data, offsets, data[keep], before[offsets]


def _grams(x: np.ndarray) -> np.ndarray:
    """A hash of the 12 bytes from each position on; too short, none."""
    if len(x) < Q:
        return np.zeros(0, np.uint64)
    y = x.astype(np.uint64)
    y = y[:-1] | (y[1:] << np.uint64(8))
    y = y[:-2] | (y[2:] << np.uint64(16))
    low, high = (y[:-4] | (y[4:] << np.uint64(32))), y[8:]
    h = (low[: len(high)] ^ (high * _SEED)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Benchmark:
    """Windows of benchmark items and an index of their q-grams, small enough for a task.

    Windows of equal content are one window, which knows all items that have it: a passage that very many items share is
    compared once and found for each of them.
    """

    def __init__(self, items: list[int], texts: list[str]) -> None:
        _, _, data, offsets = _normalised(pa.array(texts, pa.string()))
        self.items, self.data, self.windows = items, data, []
        #: The items of each window, by their places.
        self.members: list[list[int]] = []
        known: dict[bytes, int] = {}
        for k, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            size = min(WINDOW, hi - lo)
            if size < Q:
                continue
            for s in [*range(lo, hi - size, WINDOW // 2), hi - size]:
                content = data[s : s + size].tobytes()
                if content in known:
                    mine = self.members[known[content]]
                    if mine[-1] != k:
                        mine.append(k)
                    continue
                known[content] = len(self.windows)
                self.members.append([k])
                budget = size * EDIT_PERCENT // 100
                while budget and size - Q + 1 - Q * budget < 1:
                    budget -= 1
                self.windows.append((k, s, size, budget, size - Q + 1 - Q * budget))
        self.table = np.array(self.windows, np.int64).reshape(-1, 5)
        counts = self.table[:, 2] - Q + 1
        owner = np.repeat(np.arange(len(counts)), counts)
        where = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        grams = _grams(data)[self.table[owner, 1] + where] if len(owner) else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        self.grams, self.where, self.owner = grams[order], where[order], owner[order]
        self.least = min((w[4] for w in self.windows), default=1)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[self.grams >> np.uint64(64 - _FILTER_BITS)] = True


def _short(x: np.ndarray) -> np.ndarray:
    """The Q_SHORT bytes from each position on, as numbers."""
    y = x.astype(np.uint32)
    return y[:-3] | y[1:-2] << 8 | y[2:-1] << 16 | y[3:] << 24 if len(y) >= Q_SHORT else y[:0]


def banded_distance(pattern: np.ndarray, text: np.ndarray, budget: int, band: int) -> tuple[int, int, int]:
    """The least edits that turn `pattern` into a substring of `text` whose diagonals stay within `band`, and its bounds.

    Row i of the dynamic programme covers text positions i - band to i + band; (budget + 1, 0, 0) if over budget.
    """
    m, n, over = len(pattern), len(text), budget + 1
    prev = {j: (0, j) for j in range(0, min(n, band) + 1)}
    for i in range(1, m + 1):
        row: dict[int, tuple[int, int]] = {}
        for j in range(max(0, i - budget), min(n, i + band) + 1):
            best = (over, 0)
            if j and (p := prev.get(j - 1)):
                best = min(best, (p[0] + (pattern[i - 1] != text[j - 1]), p[1]))
            if p := prev.get(j):
                best = min(best, (p[0] + 1, p[1]))
            if j and (p := row.get(j - 1)):
                best = min(best, (p[0] + 1, p[1]))
            if best[0] <= budget:
                row[j] = best
        if not row:
            return over, 0, 0
        prev = row
    end, (cost, start) = min(prev.items(), key=lambda x: (x[1][0], x[0]))
    return cost, start, end


def _matches(bench: Benchmark, norm: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int, int, int, int]]:
    """(row, window, start, end, edits) over normalised positions of a slice of documents."""
    found: set[tuple[int, int, int, int, int]] = set()
    h = _grams(norm)
    hit = np.flatnonzero(bench.filter[h >> np.uint64(64 - _FILTER_BITS)])
    if not len(hit):
        return found
    row = np.searchsorted(offsets, hit, "right") - 1
    ok = hit + Q <= offsets[row + 1]
    hit, row = hit[ok], row[ok]
    # a region holds `least` shared q-grams within a window's length and its edits
    span, t = WINDOW + WINDOW * EDIT_PERCENT // 100, bench.least
    if t > 1:
        left = np.searchsorted(hit, hit - span)
        right = np.searchsorted(hit, hit + span, "right")
        dense = right - left >= t
        hit, row = hit[dense], row[dense]
    lo = np.searchsorted(bench.grams, h[hit], "left")
    n = np.searchsorted(bench.grams, h[hit], "right") - lo
    # so many pairs of a q-gram and a window at a time; parts overlap by a window's length, so each window is whole in one
    done, i = np.r_[0, np.cumsum(n)], 0
    while i < len(hit):
        j = max(i + 1, int(np.searchsorted(done, done[i] + PAIRS, "right")) - 1)
        k = int(np.searchsorted(hit, hit[i] - span))
        if done[j] > done[k]:
            found.update(_verified(bench, norm, offsets, hit[k:j], row[k:j], lo[k:j], n[k:j]))
        i = j
    return found


def _verified(
    bench: Benchmark, norm: np.ndarray, offsets: np.ndarray, hit: np.ndarray, row: np.ndarray, lo: np.ndarray, n: np.ndarray
) -> Iterator[tuple[int, int, int, int, int]]:
    """The matches whose shared q-grams are at `hit`; n entries of the index from lo on have each."""
    at, row = np.repeat(hit, n), np.repeat(row, n)
    idx = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    window = bench.owner[idx]
    diagonal = at - bench.where[idx]
    width = np.maximum(bench.table[window, 3], 1)
    need = bench.table[window, 4]
    # bands [k * width, (k + 2) * width): each diagonal lies in two
    k = (diagonal + (1 << 40)) // width
    key_w, key_k = np.concatenate([window, window]), np.concatenate([k, k - 1])
    order = np.lexsort((key_k, key_w))
    key_w, key_k = key_w[order], key_k[order]
    rows, needs = np.tile(row, 2)[order], np.tile(need, 2)[order]
    new = np.flatnonzero(np.r_[True, (key_w[1:] != key_w[:-1]) | (key_k[1:] != key_k[:-1])])
    counts = np.diff(np.r_[new, len(key_w)])
    dense = counts >= needs[new]
    seen, aligned = set(), {}
    for i in new[dense].tolist():
        w, r = int(key_w[i]), int(rows[i])
        _, s, size, budget, _ = bench.windows[w]
        first = int(key_k[i]) * max(budget, 1) - (1 << 40)
        if (w, r, first) in seen or (w, r, first - max(budget, 1)) in seen:
            continue
        lo_p = max(int(offsets[r]), first - budget)
        hi_p = min(int(offsets[r + 1]), first + size + 3 * max(budget, 1))
        text = norm[lo_p:hi_p].tobytes()
        if (w, text) not in aligned:
            # the lemma again, for short q-grams: it drops windows of which the document has a part
            pattern = bench.data[s : s + size]
            if np.isin(_short(pattern), _short(norm[lo_p:hi_p])).sum() < size - Q_SHORT + 1 - Q_SHORT * budget:
                aligned[w, text] = budget + 1, 0, 0
        if (w, text) not in aligned:
            aligned[w, text] = banded_distance(pattern, norm[lo_p:hi_p], budget, 4 * max(budget, 1) + budget)
        cost, a, b = aligned[w, text]
        if cost <= budget:
            seen.add((w, r, first))
            yield r, w, lo_p + a, lo_p + b, cost


def _search(items: list[int], texts: list[str], each_item: bool):
    """Rows for every item of a window that is found or, if one is enough to know, for its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(items, texts)
        for batch in batches:
            data, raw, norm, offsets = _normalised(batch.column(1))
            for i, j in textnp.slices(offsets):
                found = sorted(_matches(bench, norm[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                if not found:
                    continue
                merged: dict[tuple[int, int], list] = {}
                points: dict[int, np.ndarray] = {}
                for r, w, a, b, cost in found:
                    r += i
                    if r not in points:
                        part = data[raw[r] : raw[r + 1]]
                        points[r] = textnp.code_points_before(part)[np.flatnonzero(_KEEP[part])]
                    base = int(offsets[r] - offsets[i])
                    start, end = int(points[r][a - base]), int(points[r][b - 1 - base]) + 1
                    for item in bench.members[w] if each_item else bench.members[w][:1]:
                        m = merged.setdefault((r, item), [0, start, end, cost])
                        m[:] = [m[0] + 1, min(m[1], start), max(m[2], end), min(m[3], cost)]
                ids = batch.column(0)
                keys = list(merged)
                cols = list(zip(*merged.values(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([r for r, _ in keys])), pa.array([bench.items[k] for _, k in keys], pa.int64()),
                     *(pa.array(c, pa.int64()) for c in cols)],
                    ["doc_id", "item_id", "n_windows", "start", "end", "edits"],
                )
    return run


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[tuple[list[int], list[str]]]:
    """The distinct rows of the benchmark in blocks of bounded bytes, one on the driver at a time."""
    rows = benchmark.select("item_id", "text").where("item_id is not null and text is not null and text <> ''").distinct()
    items, texts, size = [], [], 0
    for x in rows.toLocalIterator():
        items.append(x[0])
        texts.append(x[1])
        size += len(x[1].encode())
        if size >= limit:
            yield items, texts
            items, texts, size = [], [], 0
    if items:
        yield items, texts


def contaminated(docs: DataFrame, benchmark: DataFrame, *, block_bytes: int = BLOCK_BYTES, each_item: bool = True) -> DataFrame:
    """One row per document and benchmark item with a matching window: doc_id, item_id, n_windows, start, end, edits.

    Items are cut into windows of 64 compared characters (bytes of letters and digits, lower case; a shorter
    item is one window) that overlap by half. A window matches where the document has it within 6 % of
    edits. start and end (code points, end exclusive) bound the matching windows, edits is the least of
    them. Items under 12 compared bytes are too short to be evidence and match nothing, as null and empty
    texts do. Windows that items share are compared once and found for every item that has them, so the rows
    depend on neither the blocks nor the order of the benchmark; with `each_item` false one of them is enough.
    Repeated documents and items each get their rows, one per row of `docs` and distinct item row; a
    null doc_id is carried along; ties between equal edits take the first place. Very long texts are read in slices.
    An empty table on either side gives no rows. The benchmark is the stated query set: it is searched in blocks of
    bounded size, each against all documents, one block on the driver at a time. Other columns are not read.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    schema = "doc_id long, item_id long, n_windows long, start long, end long, edits long"
    blocks = _blocks(benchmark, block_bytes)
    block, out = next(blocks, None), None
    while block is not None:
        part, block = docs.mapInArrow(_search(*block, each_item), schema), next(blocks, None)
        # with more than one block each is searched before the next is read
        part = part if block is None and out is None else materialise(part)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs` without a match, all columns as they came, whatever their names.

    Rows are judged by doc_id and text, so of rows that share an id only those that match go. Null and empty texts,
    short items and empty tables match nothing.
    """
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.xxhash64("doc_id", "text").alias("_key"), "text")
    found = contaminated(keyed.select(F.col("_key").alias("doc_id"), "text"), benchmark, each_item=False, **options)
    found = materialise(found.select(F.col("doc_id").alias("_key")).distinct())
    return keyed.join(small(found), "_key", "left_anti").select("_row.*")

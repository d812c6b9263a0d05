"""A byte-level convolutional quality classifier, trained in numpy.

Learned filters of five bytes slide over overlapping chunks that cover the whole document; each filter is
max-pooled per chunk, the chunks' maxima are averaged, and a logistic layer makes one probability of them.
A filter is a table of weights by place and byte, so a convolution is a sum of table rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import textnp
from codeloom.llm.io import prepare

FILTERS, WIDTH, CHUNK, STRIDE = 16, 5, 512, 448
#: Bound of the training sample: documents of each label, and characters of each (a run from a hashed place).
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 2000
EPOCHS, BATCH = 14, 64
THRESHOLD = 0.3
_PIECE = 1 << 15


def chunk_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of the overlapping chunks; every row has at least one, which may be empty."""
    lens = np.diff(offsets)
    n = np.maximum(1, -(-(lens - (CHUNK - STRIDE)) // STRIDE))
    row = np.repeat(np.arange(len(lens)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[:-1][row] + nth * STRIDE
    return row, start, np.minimum(CHUNK, offsets[1:][row] - start)


class ByteCnn:
    def __init__(self, seed: int = 10) -> None:
        rng = np.random.default_rng(seed)
        self.tables = (rng.normal(size=(WIDTH, 256, FILTERS)) * 0.3).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.w = (rng.normal(size=FILTERS) * 0.1).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def train(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> None:
        """Adam on the log loss; the gradient of a max-pooled filter reaches the place of its maximum alone."""
        rng = np.random.default_rng(seed)
        params = [self.tables, self.bias, self.w, self.c]
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        offsets = np.cumsum([0] + [len(t) for t in texts])
        data = np.frombuffer(b"".join(texts) + bytes(CHUNK + WIDTH), np.uint8)
        row, start, size = chunk_rows(data, offsets)
        first = np.searchsorted(row, np.arange(len(texts) + 1))
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for b in range(0, len(order), BATCH):
                docs = order[b : b + BATCH]
                chunks = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
                owner = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
                places = start[chunks][:, None] + np.arange(CHUNK - WIDTH + 1)
                ok = np.arange(CHUNK - WIDTH + 1) < np.maximum(1, size[chunks] - WIDTH + 1)[:, None]
                conv = np.zeros((*places.shape, FILTERS), np.float32)
                for j in range(WIDTH):
                    conv += self.tables[j][self._byte(data, places + j, start[chunks] + size[chunks])]
                conv[~ok] = -1e9
                arg = conv.argmax(1)
                top = np.take_along_axis(conv, arg[:, None, :], 1)[:, 0, :] + self.bias
                pool = np.maximum(top, 0)
                share = np.bincount(owner, minlength=len(docs)).astype(np.float32)
                feat = np.zeros((len(docs), FILTERS), np.float32)
                np.add.at(feat, owner, pool)
                feat /= share[:, None]
                err = (1 / (1 + np.exp(-(feat @ self.w + self.c))) - labels[docs]).astype(np.float32) / len(docs)
                d_pool = (err[:, None] * self.w / share[:, None])[owner] * (top > 0)
                g_tables = np.zeros_like(self.tables)
                at = places[np.arange(len(chunks))[:, None], arg]
                for j in range(WIDTH):
                    byte = self._byte(data, at + j, (start[chunks] + size[chunks])[:, None])
                    np.add.at(g_tables[j], (byte, np.arange(FILTERS)[None, :]), d_pool)
                grads = [g_tables + 1e-5 * self.tables, d_pool.sum(0), feat.T @ err, err.sum(keepdims=True)]
                step += 1
                rate = 0.02 * (1 - 0.9 * epoch / epochs)
                for k, (p, g) in enumerate(zip(params, grads, strict=True)):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    p -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    @staticmethod
    def _byte(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The bytes at places of a chunk; zero past its end."""
        if end.ndim < at.ndim:
            end = end[:, None]
        return np.where(at < end, data[at], 0)


def features(model: ByteCnn, pairs: list[np.ndarray], data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean over each row's chunks of the max-pooled filters."""
    row, start, size = chunk_rows(data, offsets)
    out = np.zeros((len(offsets) - 1, FILTERS), np.float64)
    per = max(1, _PIECE // CHUNK)
    padded = np.concatenate([data, np.zeros(CHUNK + WIDTH, np.uint8)])
    for i in range(0, len(row), per):
        s, k = start[i : i + per], np.maximum(size[i : i + per], 1)
        positions = np.maximum(k - WIDTH + 1, 1)
        first = np.cumsum(positions) - positions
        at = np.repeat(s - first, positions) + np.arange(int(positions.sum()))
        x = padded[at[:, None] + np.arange(WIDTH)].astype(np.int64)
        short = np.flatnonzero(size[i : i + per] < WIDTH)
        for c in short:
            x[first[c], max(int(size[i + c]), 0) :] = 0
        conv = pairs[0].take(x[:, 0] << 8 | x[:, 1], axis=0)
        conv += pairs[1].take(x[:, 2] << 8 | x[:, 3], axis=0)
        conv += model.tables[4].take(x[:, 4], axis=0)
        top = np.maximum(np.maximum.reduceat(conv, first, axis=0) + model.bias, 0)
        np.add.at(out, row[i : i + per], top)
    return out / np.bincount(row, minlength=len(out))[:, None]


def pair_tables(model: ByteCnn) -> list[np.ndarray]:
    """Sums of two neighbouring places' tables by byte pair: three look-ups a place, not five."""
    return [(model.tables[j][:, None, :] + model.tables[j + 1][None, :, :]).reshape(-1, FILTERS) for j in (0, 2)]


def _scores(model: ByteCnn, shift: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pair_tables(model)
        for batch in batches:
            data, offsets = textnp.column_bytes(batch.column(1))
            logits = np.zeros(len(offsets) - 1)
            for i, j in textnp.slices(offsets):
                f = features(model, pairs, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                logits[i:j] = f @ model.w + model.c[0] + shift
            score = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )
    return run


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[list[bytes], np.ndarray, float]:
    """Texts and labels of a hashed sample of at most about `per_label` rows a label, and the log odds that the sample lost."""
    usable = labels.where("doc_id is not null and quality in (0, 1) and crc32(cast(doc_id as string)) % 5 <> 0").select("doc_id", "quality")
    counts = {q: n for q, n in usable.groupBy("quality").count().collect()}
    if not counts:
        return [], np.zeros(0), 0.0
    u = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(31)), 11) / float(1 << 53)
    rate = {q: min(1.0, per_label / counts[q]) for q in counts}
    picked = usable.where(u < F.when(F.col("quality") == 1, F.lit(rate.get(1, 0.0))).otherwise(F.lit(rate.get(0, 0.0)))).distinct()
    place = F.pmod(F.xxhash64("doc_id", F.lit(37)), F.greatest(F.char_length("text") - chars, F.lit(1))) + 1
    # about 2 * per_label rows of two numbers: bounded by the rates; rows that repeat one of them enter once
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(
        "doc_id", "quality", F.substring(F.coalesce("text", F.lit("")), F.coalesce(place, F.lit(1)).cast("int"), F.lit(chars)).alias("t")
    ).distinct().collect()
    rows.sort(key=lambda x: (x[0], x[1], x[2]))
    y = np.array([x[1] for x in rows], np.float32)
    lost = math.log(rate.get(0, 1.0) / rate.get(1, 1.0)) if len(counts) == 2 else 0.0
    return [x[2].encode() for x in rows], y, lost


def score_quality(docs: DataFrame, labels: DataFrame, *, epochs: int = EPOCHS) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    held_out marks crc32(doc_id) mod 5 = 0; those rows, null doc_ids and labels other than 0 and 1 teach nothing. The sample is
    balanced by label and its odds are put right in the score. Null texts are scored as empty ones. With
    one label only, or none, every score is that label, or 0.5. Repeated rows each get a row; an empty
    table gives none. Other columns are never read.
    """
    prepare(docs.sparkSession)
    texts, y, lost = training_sample(docs, labels)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out")
    if len(set(y.tolist())) < 2:
        score = float(y[0]) if len(y) else 0.5
        return docs.select("doc_id", held, F.lit(score).alias("score"), F.lit(int(score >= THRESHOLD)).alias("predicted"))
    model = ByteCnn()
    model.train(texts, y, epochs)
    return docs.select("doc_id", "text", held).mapInArrow(
        _scores(model, lost), "doc_id long, held_out boolean, score double, predicted int"
    )

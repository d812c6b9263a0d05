"""Language identification with a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample. It reads chunks of 128
bytes in both directions, labels every position, and a document's probabilities are the means over all its
positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import textnp
from codeloom.llm.io import BROADCAST_IDS, materialise, prepare

HIDDEN, CHUNK, BLOCK = 8, 128, 2048
#: Bound of the training sample: documents of each language, characters of each, and documents in all.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_ROWS = 400, 1000, 200_000
STEPS, TRAIN_BATCH, TRAIN_LENGTH = 350, 192, 48


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGru:
    """Both directions' input tables and recurrent weights (feature-major), and the output layer."""

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["e" + d] = (rng.normal(size=(3 * hidden, 256)) * 0.3).astype(np.float32)
            self.p["u" + d] = (rng.normal(size=(3 * hidden, hidden)) / hidden**0.5).astype(np.float32)
        self.p["w"] = (rng.normal(size=(n_labels, 2 * hidden)) * 0.3).astype(np.float32)
        self.p["c"] = np.zeros((n_labels, 1), np.float32)

    def _run(self, d: str, x: np.ndarray, keep: list | None) -> list[np.ndarray]:
        h_size, e, u = self.hidden, self.p["e" + d], self.p["u" + d]
        h, out = np.zeros((h_size, x.shape[1]), np.float32), []
        for t in range(len(x)):
            a, g = e.take(x[t], axis=1), u @ h
            gates = _sigmoid(a[: 2 * h_size] + g[: 2 * h_size])
            z, r = gates[:h_size], gates[h_size:]
            c = np.tanh(a[2 * h_size :] + r * g[2 * h_size :])
            if keep is not None:
                keep.append((h, g[2 * h_size :], z, r, c))
            h = c + z * (h - c)
            out.append(h)
        return out

    def _back(self, d: str, x: np.ndarray, kept: list, dh_out: list[np.ndarray], grads: dict) -> None:
        h_size, u = self.hidden, self.p["u" + d]
        ge, gu = np.zeros_like(self.p["e" + d]), np.zeros_like(u)
        dh = np.zeros_like(dh_out[0])
        all_a = []
        for t in range(len(x) - 1, -1, -1):
            h, gc, z, r, c = kept[t]
            dh = dh + dh_out[t]
            da_c = dh * (1 - z) * (1 - c * c)
            da_z = dh * (h - c) * z * (1 - z)
            da_r = da_c * gc * r * (1 - r)
            da = np.concatenate([da_z, da_r, da_c])
            dg = np.concatenate([da_z, da_r, da_c * r])
            gu += dg @ h.T
            dh = dh * z + u.T @ dg
            all_a.append(da)
        flat = np.concatenate(all_a[::-1], axis=1)
        bytes_ = x.reshape(-1)
        for k in range(3 * h_size):
            ge[k] = np.bincount(bytes_, weights=flat[k], minlength=256)
        grads["e" + d], grads["u" + d] = ge, gu

    def loss_and_gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """x: bytes (time x batch), y: labels (batch); every position is labelled."""
        kf, kb, grads = [], [], {}
        hf, hb = self._run("f", x, kf), self._run("b", x[::-1], kb)[::-1]
        n, loss, df, db = x.size, 0.0, [], []
        gw, gc = np.zeros_like(self.p["w"]), np.zeros_like(self.p["c"])
        for t in range(len(x)):
            both = np.concatenate([hf[t], hb[t]])
            z = self.p["w"] @ both + self.p["c"]
            z = np.exp(z - z.max(0))
            prob = z / z.sum(0)
            loss -= float(np.log(prob[y, np.arange(len(y))] + 1e-9).sum())
            prob[y, np.arange(len(y))] -= 1
            prob /= n
            gw += prob @ both.T
            gc += prob.sum(1, keepdims=True)
            back = self.p["w"].T @ prob
            df.append(back[: self.hidden])
            db.append(back[self.hidden :])
        self._back("f", x, kf, df, grads)
        self._back("b", x[::-1], kb, db[::-1], grads)
        grads["w"], grads["c"] = gw, gc
        return loss / n, grads

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        texts = [x + b" " * (TRAIN_LENGTH - len(x)) for x in texts]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        by_label = [np.flatnonzero(labels == k) for k in np.unique(labels)]
        for step in range(1, steps + 1):
            which = np.array([rng.choice(by_label[i % len(by_label)]) for i in range(TRAIN_BATCH)])
            starts = [int(rng.integers(0, len(texts[i]) - TRAIN_LENGTH + 1)) for i in which]
            x = np.stack([np.frombuffer(texts[i], np.uint8, TRAIN_LENGTH, s) for i, s in zip(which, starts, strict=True)], axis=1)
            _, grads = self.loss_and_gradients(x, labels[which])
            rate = 0.02 * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v2[k] += 0.01 * (g * g - v2[k])
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def _fast_pass(e: np.ndarray, u: np.ndarray, hidden: int, x: np.ndarray, mask: np.ndarray | None, emit) -> None:
    """One direction over a block, with gates as tanh of pre-halved sums and all arrays reused."""
    n = x.shape[1]
    h, a, g = np.zeros((hidden, n), np.float32), np.empty((3 * hidden, n), np.float32), np.empty((3 * hidden, n), np.float32)
    gates, z, r, c, gc = a[: 2 * hidden], a[:hidden], a[hidden : 2 * hidden], a[2 * hidden :], g[2 * hidden :]
    for t in range(len(x)):
        np.take(e, x[t], axis=1, out=a, mode="clip")
        np.matmul(u, h, out=g)
        gates += g[: 2 * hidden]
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        gc *= r
        c += gc
        np.tanh(c, out=c)
        h -= c
        h *= z
        h += c
        if mask is not None:
            h *= mask[t]
        emit(t, h)


def pooled(p: dict[str, np.ndarray], hidden: int, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean label probabilities over all positions of each row (rows x labels; zeros for empty rows)."""
    lens = np.diff(offsets)
    chunks = -(-lens // CHUNK)
    row = np.repeat(np.arange(len(lens)), chunks)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    start = offsets[:-1][row] + nth * CHUNK
    size = np.minimum(CHUNK, offsets[1:][row] - start)
    half = np.ones((3 * hidden, 1), np.float32)
    half[: 2 * hidden] = 0.5
    e = {d: np.ascontiguousarray(p["e" + d] * half) for d in "fb"}
    u = {d: np.ascontiguousarray(p["u" + d] * half) for d in "fb"}
    wf, wb = np.ascontiguousarray(p["w"][:, :hidden]), np.ascontiguousarray(p["w"][:, hidden:])
    sums = np.zeros((len(lens), len(p["w"])))
    padded = np.concatenate([data, np.zeros(CHUNK, np.uint8)])
    for i in range(0, len(row), BLOCK):
        s, k = start[i : i + BLOCK], size[i : i + BLOCK]
        x = padded[s[None, :] + np.arange(CHUNK)[:, None]]
        inside = (np.arange(CHUNK)[:, None] < k[None, :]).astype(np.float32)
        forward = np.empty((CHUNK, len(p["w"]), len(s)), np.float32)
        total = np.zeros((len(p["w"]), len(s)), np.float32)

        def ahead(t: int, h: np.ndarray, out=forward) -> None:
            np.matmul(wf, h, out=out[t])

        def back(t: int, h: np.ndarray, out=forward, total=total, inside=inside) -> None:
            z = out[CHUNK - 1 - t]
            z += wb @ h
            z += p["c"]
            np.exp(z, out=z)
            z *= inside[CHUNK - 1 - t] / z.sum(0)
            np.add(total, z, out=total)

        _fast_pass(e["f"], u["f"], hidden, x, None, ahead)
        _fast_pass(e["b"], u["b"], hidden, x[::-1], inside[::-1], back)
        np.add.at(sums, row[i : i + BLOCK], total.T)
    return sums / np.maximum(lens, 1)[:, None]


def _scores(p: dict[str, np.ndarray], hidden: int, labels: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(labels, dtype=object)
        for batch in batches:
            data, offsets = textnp.column_bytes(batch.column(1))
            lettered = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            probs = np.zeros((len(offsets) - 1, len(labels)))
            for i, j in textnp.slices(offsets):
                probs[i:j] = pooled(p, hidden, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            best = probs.argmax(1)
            score = np.where(lettered, np.clip(probs.max(1), 0, 1), 0.0)
            lang = np.where(lettered, names[best], "und")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(3), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"]
            )
    return run


def training_sample(docs: DataFrame, per_label: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, bytes]]:
    """A hashed sample of about `per_label` documents of each language, `chars` characters of each from a hashed place.

    Only rows with a language whose crc32(doc_id) mod 4 is not 2 are taken. With so many languages that the sample would
    pass SAMPLE_ROWS rows, each has its even part of them. Repeated rows enter once.
    """
    known = docs.where("lang is not null and text is not null and text <> '' and crc32(cast(doc_id as string)) % 4 <> 2")
    counts = materialise(known.groupBy("lang").agg(F.count("*").alias("n")))
    n_labels = counts.count()
    if not n_labels:
        return []
    per_label = max(1, min(per_label, SAMPLE_ROWS // n_labels))
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(17)), 11) / float(1 << 53)
    place = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.greatest(F.char_length("text") - chars, F.lit(1))) + 1
    rows = known.select("lang", F.substring("text", place.cast("int"), F.lit(chars)).alias("t"), u.alias("u"))
    rates = counts.select("lang", (per_label / F.col("n")).alias("rate"))
    rows = rows.join(F.broadcast(rates) if n_labels <= BROADCAST_IDS else rates, "lang").where("u < rate").select("lang", "t", "u").distinct()
    taken: dict[str, list] = {}
    for lang, t, u_ in sorted((tuple(x) for x in rows.collect()), key=lambda x: (x[0], x[2], x[1])):
        taken.setdefault(lang, []).append((lang, t.encode()))
    return [x for lang in sorted(taken) for x in taken[lang][: 2 * per_label]]


def identify_languages(docs: DataFrame, *, hidden: int = HIDDEN, steps: int = STEPS) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score.

    held_out marks crc32(doc_id) mod 4 = 2; those documents, and null doc_ids, teach nothing. lang_pred is und with
    score 0 if the text is null or has no letter, or if there is nothing to learn from. Repeated rows each
    get a row; an empty table gives none. Of other columns only lang is read, for training alone.
    """
    prepare(docs.sparkSession)
    sample = training_sample(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    if not sample:
        return docs.select("doc_id", held, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    labels = sorted({x for x, _ in sample})
    net = ByteGru(len(labels), hidden)
    net.train([t for _, t in sample], np.array([labels.index(x) for x, _ in sample]), steps)
    return docs.select("doc_id", "text", F.col("text").rlike(r"\p{L}").alias("lettered"), held).mapInArrow(
        _scores(net.p, hidden, labels), "doc_id long, held_out boolean, lang_pred string, score double"
    )

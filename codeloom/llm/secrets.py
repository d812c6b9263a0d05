"""Secret scans: fixed patterns, and character Markov models for what has no pattern.

Two bigram models, one of random strings and one of ordinary identifiers, are trained from labelled samples;
long tokens whose log-likelihood ratio favours the random model are reported besides the patterns' matches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import textnp
from codeloom.llm.io import prepare

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
#: Tokens of the models: at least MIN_TOKEN of these characters, with two of lower case, upper case and digits.
ALPHABET = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_TOKEN, MARGIN = 20, 1.5
#: Bound of the training sample: about so many documents, characters of each from a hashed place, generated strings of each label.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_STRINGS = 500, 5000, 2000

#: Ordinary words of a text: letters that are no part of a longer token.
_WORD = re.compile(rb"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,30}(?![A-Za-z0-9+/_=-])")
_CODE = np.full(256, len(ALPHABET), np.int64)
_CODE[list(ALPHABET)] = np.arange(len(ALPHABET))
_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_IS_TOKEN = _CODE < len(ALPHABET)
_MARK = np.zeros(256, bool)
_MARK[list(b":=")] = True


class Markov:
    """Smoothed log-probabilities of a character after another, per model; scores are means per character."""

    def __init__(self, random: list[bytes], ordinary: list[bytes]) -> None:
        n = len(ALPHABET)
        tables = []
        for sample in (random, ordinary):
            counts = np.full((n + 1, n + 1), 0.1)
            for s in sample:
                codes = np.concatenate([[n], _CODE[np.frombuffer(s, np.uint8)]])
                np.add.at(counts, (codes[:-1], codes[1:]), 1)
            tables.append(np.log(counts / counts.sum(1, keepdims=True)))
        self.ratio = tables[0] - tables[1]

    def score(self, token: bytes) -> float:
        codes = np.concatenate([[len(ALPHABET)], _CODE[np.frombuffer(token, np.uint8)]])
        return float(self.ratio[codes[:-1], codes[1:]].mean())


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of `mask` of at least `least` within rows."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets] = True
    before = np.r_[False, mask[:-1]]
    after = np.r_[mask[1:], False]
    starts = np.flatnonzero(mask & (~before | edge[:-1]))
    ends = np.flatnonzero(mask & (~after | edge[1:])) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def base_spans(text: bytes, hex_runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches, in bytes."""
    found = [(a, b, 2) for a, b in hex_runs]
    found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


def scan_slice(data: np.ndarray, offsets: np.ndarray, model: Markov) -> dict[int, tuple[list, list]]:
    """Row -> (base spans, added spans) in code points, of the rows that have any."""
    rows: dict[int, dict[str, list]] = {}
    at = lambda p: np.searchsorted(offsets, p, "right") - 1
    a, b = _runs(_IS_HEX[data], offsets, MIN_HEX)
    for r, x, y in zip(at(a), a, b, strict=True):
        rows.setdefault(int(r), {"hex": [], "token": []})["hex"].append((int(x - offsets[r]), int(y - offsets[r])))
    a, b = _runs(_IS_TOKEN[data], offsets, MIN_TOKEN)
    for r, x, y in zip(at(a), a, b, strict=True):
        rows.setdefault(int(r), {"hex": [], "token": []})["token"].append((int(x - offsets[r]), int(y - offsets[r])))
    for r in np.unique(at(np.flatnonzero(_MARK[data]))):
        rows.setdefault(int(r), {"hex": [], "token": []})
    raw = data.tobytes()
    p = raw.find(b"AKIA")
    while p >= 0:
        rows.setdefault(int(at(p)), {"hex": [], "token": []})
        p = raw.find(b"AKIA", p + 4)
    out = {}
    for r, x in rows.items():
        text = raw[offsets[r] : offsets[r + 1]]
        base = base_spans(text, x["hex"])
        added = []
        for s, e in x["token"]:
            token = text[s:e].strip(b"=-_/+")
            s = text.find(token, s) if token else s
            e = s + len(token)
            mixed = len({"a" if c >= 97 else "A" if c >= 65 else "0" for c in token if chr(c).isalnum()}) > 1
            if len(token) < MIN_TOKEN or not mixed or any(s < q and p < e for p, q, _ in base):
                continue
            if model.score(token) > MARGIN:
                added.append((s, e, 3))
        if base or added:
            points = textnp.code_points_before(data[offsets[r] : offsets[r + 1]])
            move = lambda spans, points=points: [(int(points[p]), int(points[q]), k) for p, q, k in spans]
            out[r] = (move(base), move(added))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def _scan(model: Markov):
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textnp.column_bytes(batch.column(1))
            n = len(offsets) - 1
            counts = np.zeros((4, n), np.int64)
            digest, spans = [nothing] * n, [""] * n
            for i, j in textnp.slices(offsets):
                for r, (base, added) in scan_slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], model).items():
                    for *_, k in base + added:
                        counts[k, i + r] += 1
                    digest[i + r] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    spans[i + r] = _joined(base + added)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[k]) for k in range(3)), pa.array(digest), pa.array(spans), pa.array(counts[3])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"],
            )
    return run


def training_samples(docs: DataFrame, n_docs: int = SAMPLE_DOCS) -> tuple[list[bytes], list[bytes]]:
    """Random strings and ordinary identifiers, from a hashed sample of about `n_docs` documents.

    Labels come from the patterns: what they match is random, all other words are ordinary, alone and joined into
    identifiers of several words. Seeded random strings of common alphabets stand for secrets that a sample lacks.
    """
    known = docs.where("text is not null and text <> ''")
    rate = min(1.0, n_docs / max(1, known.count()))
    u = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(5)), 11) / float(1 << 53)
    place = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(1))) + 1
    rows = known.where(u < rate).select(F.substring("text", F.coalesce(place, F.lit(1)).cast("int"), F.lit(SAMPLE_CHARS)).alias("t"), u.alias("u")).distinct().collect()
    texts = [x.t for x in sorted(rows, key=lambda x: (x.u, x.t))]
    rng = np.random.default_rng(4)
    random, words = [], []
    for t in texts:
        raw = t.encode()
        taken = [(m.start(), m.end(), m[2]) for m in ASSIGN.finditer(raw) if len(m[2]) >= MIN_ASSIGN]
        taken += [(m.start(), m.end(), m[0]) for m in ACCESS.finditer(raw) if len(m[0]) >= MIN_ACCESS]
        taken += [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[0-9a-f]{32,}", raw)]
        random += [x for *_, x in taken]
        for m in _WORD.finditer(raw):
            if len(words) < 50 * SAMPLE_STRINGS and not any(a <= m.start() < b for a, b, _ in taken):
                words.append(m[0])
    words = words or [b"the", b"value", b"index", b"name", b"of"]
    ordinary = list(words)
    for _ in range(SAMPLE_STRINGS):
        some = [words[i] for i in rng.integers(0, len(words), int(rng.integers(2, 6)))]
        style = int(rng.integers(0, 5))
        joined = [b"_".join(some), b"-".join(some), b"".join(w.capitalize() for w in some), b"/".join(some), b"_".join(some).upper()][style]
        ordinary.append(joined + (str(int(rng.integers(0, 2030))).encode() if rng.random() < 0.3 else b""))
    for letters in (ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], b"0123456789abcdef", ALPHABET[:26] + ALPHABET[52:62]):
        for _ in range(SAMPLE_STRINGS // 5):
            pick = rng.integers(0, len(letters), int(rng.integers(20, 48)))
            random.append(bytes(np.frombuffer(letters, np.uint8)[pick]))
    return random, ordinary


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    Base spans are the leftmost non-overlapping matches of each pattern that are long enough; base_sha256
    digests them. spans adds the tokens that the Markov models take for random and that touch no base span.
    Spans are kind:start:end in code points. Null texts count as empty; repeated rows and null doc_ids keep
    their rows; an empty table gives none. Other columns are not read.
    """
    prepare(docs.sparkSession)
    model = Markov(*training_samples(docs))
    return docs.select("doc_id", "text").mapInArrow(
        _scan(model), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"
    )

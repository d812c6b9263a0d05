"""Token counts by a finite-state compilation of a subword vocabulary.

Merging the best pair first (leftmost among equals) is local: a piece list is what a text merges to exactly if each
piece merges to itself and each adjacent pair to that pair. So the last piece of every prefix is the one piece that
ends there and is compatible with the last piece of the prefix before it, and a prefix needs no more memory than the
last pieces at those places where an unfinished piece may have begun. That is a deterministic transducer: its states
are those memories, and each transition is annotated with the change of the number of pieces. Transitions are built
when a text first needs them, and kept for all later tasks of the Python worker.

Texts are laid out as chunks that step through the transducer together. A chunk that holds a reset (a place that no
piece spans) maps every state to one; others get maps over the states that occur, and all maps are composed by a
parallel prefix scan, which gives each chunk the state it really begins in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.io import prepare

SPACE = "▁"
TOKEN_LIMIT = 4096
#: Symbols of a chunk; symbols that are taken at once; transitions after which the transducer is built anew.
CHUNK, SEGMENT, TRANSITIONS = 256, 1 << 20, 4_000_000
_EMPTY = np.int64(-1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def load_vocabulary(path: str) -> dict[str, float]:
    """The pieces of a model file that merges can give, with their scores; read once, on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return {model.id_to_piece(i): model.get_score(i) for i in own}


class _Transitions:
    """(state, class) -> (next state, change of the count): an open-addressing table that whole arrays look up."""

    def __init__(self) -> None:
        self.size, self.bits = 0, 16
        self._clear()

    def _clear(self) -> None:
        n = 1 << self.bits
        self.keys, self.next, self.change = np.full(n, _EMPTY), np.zeros(n, np.int32), np.zeros(n, np.int16)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free one where it would go."""
        slot = ((keys.view(np.uint64) * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)
        at = self.keys[slot]
        lost = np.flatnonzero((at != keys) & (at != _EMPTY))
        while len(lost):
            slot[lost] = (slot[lost] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[lost]]
            lost = lost[(at != keys[lost]) & (at != _EMPTY)]
        return slot

    def add(self, key: int, to: int, change: int) -> None:
        if 2 * self.size >= len(self.keys):
            keep = np.flatnonzero(self.keys != _EMPTY)
            old = self.keys[keep], self.next[keep], self.change[keep]
            self.bits += 1
            self._clear()
            for row in zip(*(x.tolist() for x in old), strict=True):
                self._put(*row)
        self._put(key, to, change)
        self.size += 1

    def _put(self, key: int, to: int, change: int) -> None:
        mask = (1 << self.bits) - 1
        slot = ((key * int(_MIX)) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
        while self.keys[slot] != _EMPTY:
            slot = (slot + 1) & mask
        self.keys[slot], self.next[slot], self.change[slot] = key, to, change


class Transducer:
    """The transducer of a vocabulary with byte fallback: a character without a piece counts as its UTF-8 bytes."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        chars = sorted(set("".join(scores)) | {SPACE})
        self.chars, self.known = chars, len(chars)
        self.classes = np.full(0x110000, self.known + 3, np.int32)
        for below, size in ((0x10000, 3), (0x800, 2), (0x80, 1)):
            self.classes[:below] = self.known + size - 1
        self.classes[[ord(c) for c in chars]] = np.arange(self.known)
        self.classes[ord(" ")] = self.classes[ord(SPACE)]
        self.space, self.n_classes = int(self.classes[ord(SPACE)]), self.known + 4
        self.prefixes = {p[:k] for p in scores for k in range(len(p))} | {""}
        self.inside = {p[k : k + 2] for p in scores for k in range(len(p) - 1)}
        self.before = {b[0] for b in self.inside}
        self.pair: dict[tuple[str, str], bool] = {}
        self.own: dict[str, bool] = {}
        self.reset()

    def reset(self) -> None:
        """Forgets all states but the start, which is state 0."""
        self.table = _Transitions()
        self.states: list[tuple[str, tuple]] = []
        self.ids: dict[tuple[str, tuple], int] = {}
        self._state(("", ((0, "", 0),)))

    def _state(self, key: tuple[str, tuple]) -> int:
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
        return self.ids[key]

    def merge(self, text: str) -> list[str]:
        """The pieces that a short text merges to: the best pair first, leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _reachable(self, piece: str) -> bool:
        if piece not in self.own:
            self.own[piece] = self.merge(piece) == [piece]
        return self.own[piece]

    def _compatible(self, last: str, piece: str) -> bool:
        if not last or last[-1] + piece[0] not in self.inside:
            return True
        if (last, piece) not in self.pair:
            self.pair[last, piece] = self.merge(last + piece) == [last, piece]
        return self.pair[last, piece]

    def _build(self, state: int, cls: int) -> tuple[int, int]:
        """The transition of a state: (next state, change of the count).

        A state is the longest unfinished piece's text, and for the places where that or a shorter one may have begun:
        how many characters ago, the last piece before (empty if no piece spans the place), and the count there less the count now.
        """
        if cls >= self.known:
            return 0, cls - self.known + 1
        ch = self.chars[cls]
        text, places = self.states[state]
        for k, last, count in places:
            piece = text[len(text) - k :] + ch
            if (not k or piece in self.scores) and (not k or self._reachable(piece)) and self._compatible(last, piece):
                break
        change = count + (1 if piece in self.scores else len(ch.encode()))
        grown = text + ch
        new = [
            (k + 1, last if last and last[-1] + grown[len(grown) - k - 1] in self.inside else "", count - change)
            for k, last, count in places if grown[len(grown) - k - 1 :] in self.prefixes
        ]
        new.append((0, piece if ch in self.before else "", 0))
        return self._state((grown[len(grown) - new[0][0] :], tuple(new))), change

    def step(self, state: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = state.astype(np.int64) * self.n_classes + cls
        slot = self.table.find(keys)
        missing = self.table.keys[slot] != keys
        if missing.any():
            for key in np.unique(keys[missing]).tolist():
                self.table.add(key, *self._build(*divmod(key, self.n_classes)))
            slot = self.table.find(keys)
        return self.table.next[slot], self.table.change[slot]

    def _run(self, state: np.ndarray, cls: np.ndarray, until: np.ndarray, out: np.ndarray | None = None, rows: np.ndarray | None = None) -> np.ndarray:
        """The states of chunks (rows of `cls`) after their first `until` symbols; changes of the count go to `out`."""
        state = state.copy()
        for j in range(int(until.max(initial=0))):
            on = np.flatnonzero(until > j)
            state[on], change = self.step(state[on], cls[on, j])
            if out is not None:
                out[on if rows is None else rows[on], j] = change
        return state

    def changes(self, cls: np.ndarray, resets: np.ndarray, carry: int) -> tuple[np.ndarray, int]:
        """The change of the count at each symbol of a stream that begins in state `carry`, and the state at its end."""
        n = len(cls)
        lanes = -(-n // CHUNK)
        grid, stops = np.zeros(lanes * CHUNK, np.int32), np.zeros(lanes * CHUNK, bool)
        grid[:n], stops[:n] = cls, resets
        stops[n:] = True  # what fills the last chunk begins anew and isn't read
        grid, stops = grid.reshape(lanes, CHUNK), stops.reshape(lanes, CHUNK)
        out = np.zeros((lanes, CHUNK), np.int16)
        head = np.where(stops.any(1), stops.argmax(1), CHUNK)
        # behind its first reset a chunk needs nothing of what came before
        state = np.full(lanes, -1, np.int32)
        columns, stop_columns = np.ascontiguousarray(grid.T), np.ascontiguousarray(stops.T)
        end_state = -1
        for j in range(CHUNK):
            state[stop_columns[j]] = 0
            live = np.flatnonzero(state >= 0)
            if len(live) == lanes:
                state, change = self.step(state, columns[j])
                out[:, j] = change
            elif len(live):
                state[live], out[live, j] = self.step(state[live], columns[j][live])
            if j == (n - 1) % CHUNK:
                end_state = int(state[-1])
        entry = self._entries(grid, head, state, carry)
        before = self._run(entry, grid, head, out)
        # a last chunk that is a head up to the stream's end ends where its head does
        if end_state < 0:
            end_state = int(before[-1])
        return out.reshape(-1)[:n], end_state

    def _entries(self, grid: np.ndarray, head: np.ndarray, exits: np.ndarray, carry: int) -> np.ndarray:
        """The state in which each chunk begins.

        Chunks with a reset are constant maps. The maps of the others hold the states tried so far; the scan
        composes all maps, and where it meets a state that a map lacks, that and the guesses behind it are run.
        """
        lanes = len(head)
        open_lanes = np.flatnonzero(exits < 0)
        guess = exits.copy()
        maps: dict[int, dict[int, int]] = {int(i): {} for i in open_lanes}
        if len(open_lanes):
            guess[open_lanes] = self._run(np.zeros(len(open_lanes), np.int32), grid[open_lanes], head[open_lanes])
            for i, e in zip(open_lanes.tolist(), guess[open_lanes].tolist(), strict=True):
                maps[i][0] = e
        while True:
            entry = _scan(lanes, open_lanes, exits, maps, carry)
            asked = []
            for i in open_lanes.tolist():
                at = int(entry[i]) if entry[i] >= 0 else int(guess[i - 1])
                if at not in maps[i]:
                    asked.append((i, at))
            if not asked:
                if (entry >= 0).all():
                    return entry
                continue
            rows = np.array([i for i, _ in asked])
            ends = self._run(np.array([s for _, s in asked], np.int32), grid[rows], head[rows])
            for (i, at), e in zip(asked, ends.tolist(), strict=True):
                maps[i][at] = e
                guess[i] = e


def _scan(lanes: int, open_lanes: np.ndarray, exits: np.ndarray, maps: dict[int, dict[int, int]], carry: int) -> np.ndarray:
    """The states before all chunks by a prefix scan (doubling) over their maps; -1 where a map lacks the state it is asked for."""
    entry = np.concatenate([[carry], exits[:-1]]).astype(np.int32)
    if not len(open_lanes):
        return entry
    # runs of open chunks, each led by a constant: the chunk before it or the state at the stream's start
    known = sorted({s for m in maps.values() for x in m.items() for s in x} | {int(entry[i]) for i in open_lanes if entry[i] >= 0})
    place = {s: k for k, s in enumerate(known)}
    n = len(known)
    table = np.full((len(open_lanes), n + 1), n, np.int32)  # the last column is the state not known
    first = np.r_[True, np.diff(open_lanes) > 1]
    for row, i in enumerate(open_lanes.tolist()):
        for a, b in maps[i].items():
            table[row, place[a]] = place[b]
        if first[row]:
            table[row, :] = table[row, place[int(entry[i])]]
    run = np.arange(len(open_lanes)) - np.maximum.accumulate(np.where(first, np.arange(len(open_lanes)), 0))
    step = 1
    while step <= int(run.max()):
        on = np.flatnonzero(run >= step)
        table[on] = np.take_along_axis(table[on], table[on - step], 1)
        step *= 2
    ends = np.array([*known, -1], np.int32)[table[:, 0]]
    after = open_lanes + 1 < lanes
    entry[open_lanes[after] + 1] = ends[after]
    return entry


def _pieces(texts: list[str | None]) -> Iterator[list[tuple[int, str, bool]]]:
    """(row, text, whether the row begins here) in lists of at most SEGMENT characters; longer texts are cut."""
    part, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), SEGMENT):
            cut = text[at : at + SEGMENT]
            if size + len(cut) > SEGMENT and part:
                yield part
                part, size = [], 0
            part.append((row, cut, at == 0))
            size += len(cut)
    if part:
        yield part


def count_tokens(machine: Transducer, texts: list[str | None]) -> np.ndarray:
    """The number of tokens of each text; none for null and empty ones."""
    counts, carry, last = np.zeros(len(texts), np.int64), 0, machine.space
    for part in _pieces(texts):
        if machine.table.size > TRANSITIONS:
            kept = machine.states[carry]
            machine.reset()
            carry = machine._state(kept)
        stream = "".join(SPACE + t if begins else t for _, t, begins in part)
        cls = machine.classes[np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum([0, *(len(t) + begins for _, t, begins in part)])
        before = np.concatenate([[last], cls[:-1]])
        resets = ((cls == machine.space) & (before != machine.space)) | (cls >= machine.known) | (before >= machine.known)
        resets[starts[:-1]] |= np.array([begins for _, _, begins in part])
        change, carry = machine.changes(cls, resets, carry)
        last = int(cls[-1])
        np.add.at(counts, [row for row, _, _ in part], np.add.reduceat(change.astype(np.int64), starts[:-1]))
    return counts


_machines: dict[str, Transducer] = {}


def _machine(name: str, scores: dict[str, float]) -> Transducer:
    if name not in _machines:
        _machines[name] = Transducer(scores)
    return _machines[name]


def token_counts(docs: DataFrame, model: str, *, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    `model` is a model file of merges with byte fallback and no normalisation; the driver reads it and sends its pieces (some
    hundred kilobytes, the same for any input) to the tasks. Counts are those of the library without begin and end tokens;
    strings of special tokens are ordinary text. Nulls are empty texts: no bytes, no tokens. Very long texts are taken in
    parts, the state carried over. Repeated rows get a row each, null ids are carried along, an empty table gives no rows
    and other columns are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(load_vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(model, sent.value)
        for batch in batches:
            counts = count_tokens(machine, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts)], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

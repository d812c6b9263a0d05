"""Main text of web pages by a host's suffix array, with structure as a second judge.

A page is cut into blocks, whose tokens make one stream. Suffixes of all streams of a host are compared through the
shuffle: each is cut to a run that its own content delimits, equal runs meet by digest, and a run that stands in two
distinct pages of the host is boilerplate. Blocks that such runs cover go, unique runs stay. Structure then adds what
only it can know: an article's own blocks stay though they recur, and furniture (comments, forms, sidebars) goes
though it is unique. A host is never gathered in one place, so the result doesn't depend on its size.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import textnp
from codeloom.llm.io import BROADCAST_IDS, materialise, prepare

#: Least tokens of a repeated run, suffixes among which one is kept, and the share of a block's tokens that runs must cover.
RUN, WINDOW, COVERED = 8, 8, 0.9
#: Pages with one content are joined apart from the others if they are more than this part of all pages.
HOT_SHARE = 1000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*)>", re.S)
_RAW = "script style noscript template textarea title iframe svg math select datalist".split()
_CONTROLS = frozenset(["button", "label"])
_RAW_END = {x: re.compile(rf"</{x}\s*>", re.I) for x in (*_RAW, *_CONTROLS)}
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
           "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}

#: Elements and roles of furniture. In the closed ones nothing is an article; the open ones may wrap a whole page.
_CLOSED, _OPEN = frozenset("nav footer aside menu dialog".split()), frozenset("header form fieldset head".split())
_CLOSED_ROLES = frozenset("navigation contentinfo complementary search dialog alert menu menubar toolbar".split())
_OPEN_ROLES = frozenset(["banner", "form"])
#: Class names and ids are read as words, of which the last that isn't about layout says what the element is (article-comments
#: are comments, cookie-recipes are recipes). Names that begin with one of _STATES describe the page around.
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_STATES = frozenset("has no with without is hide show not".split())
_LAYOUT = frozenset(
    "list lists section area thread form body wrapper wrap container box block inner outer panel group slot unit zone space row column item items "
    "placeholder top bottom left right main primary secondary content".split()
)
_COMMENTS = frozenset("comment comments disqus respond reply replies".split())
_HEADS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored promo promos nav navbar navigation menu "
    "breadcrumb breadcrumbs pagination pager masthead footer sidebar newsletter popup modal overlay consent gdpr toolbar share sharing signup login "
    "subscribe subscription widget widgets aside".split()
)
#: Furniture outside of an article only; inside of one they may be its own.
_WEAK = frozenset("notice notices header banner social related recommended promotion promotions cookie cookies teaser teasers".split())
_PAIRS = frozenset(
    (a, b) for firsts, seconds in (
        ("more related recommended latest popular trending other further", "stories posts articles links news reading reads"),
        ("cookie cookies privacy", "notice banner bar message popup policy settings hint"),
        ("share sharing social", "tools buttons button links icons bar"), ("author", "bio box card"), ("skip", "link links"),
        ("site page global", "header notice banner"), ("side", "bar"), ("sign", "up in"), ("log", "in"), ("nav", "bar links"),
        ("newsletter", "signup box"), ("menu", "bar"),
    ) for a in firsts.split() for b in seconds.split()
)
_ATTR = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_NAMED_AS_THEY_LIKE = frozenset("body html h1 h2 h3 h4 h5 h6".split())
SILENT, ARTICLE, FURNITURE, CLOSED, WEAK = 0, 1, 2, 3, 4


@lru_cache(8192)
def _named(name: str) -> int:
    """What a class name or an id says: CLOSED, FURNITURE, WEAK or SILENT."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[0] in _STATES and len(words) > 1:
        return SILENT
    core = list(words)
    while len(core) > 1 and core[-1] in _LAYOUT:
        core.pop()
    head, pair = core[-1], tuple(core[-2:])
    joined = [head[: -len(x)] for x in _LAYOUT if head.endswith(x)]
    head = next((x for x in joined if x in _COMMENTS or x in _HEADS), head)
    if head in _COMMENTS:
        return CLOSED
    if head in _HEADS or pair in _PAIRS:
        return FURNITURE
    return WEAK if head in _WEAK and len(core) == 1 else SILENT


def _kind(name: str, attributes: str) -> int:
    """What an element says of its content: CLOSED is furniture with no article inside."""
    found = CLOSED if name in _CLOSED else FURNITURE if name in _OPEN else ARTICLE if name in ("article", "main") else SILENT
    for key, value in _ATTR.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'")
        value = value if key in ("class", "id") else value.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return CLOSED
        if key == "role":
            said = CLOSED if value in _CLOSED_ROLES else FURNITURE if value in _OPEN_ROLES else ARTICLE if value in ("main", "article") else SILENT
            found = said or found
        elif key == "itemprop" and value == "articlebody":
            found = found or ARTICLE
        elif key in ("class", "id") and name not in _NAMED_AS_THEY_LIKE:
            for word in value.split():
                said = _named(word)
                if said == CLOSED:
                    return CLOSED
                if said != SILENT and found in (SILENT, WEAK):
                    found = said
    return found


def blocks(page: str) -> list[tuple[str, int]]:
    """The page's text blocks in order with what structure says of them: white space single, references decoded, none empty."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    open_: Counter[str] = Counter()
    state = SILENT

    def flush() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                out.append((text, min(state, FURNITURE)))

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in _RAW_END:
            end = None if m[1] else _RAW_END[name].search(page, at)
            if end:
                at = end.end()
            elif not m[1] and name not in _CONTROLS:
                at = len(page)
            continue
        if name not in _BLOCK:
            continue
        flush()
        if m[1]:
            # an end without a start is passed over; else all that was opened since closes too
            while open_[name]:
                closed, state = stack.pop()
                open_[closed] -= 1
                if closed == name:
                    break
        elif name not in _VOID:
            if name in _CLOSES:
                while stack and stack[-1][0] in _CLOSES[name]:
                    closed, state = stack.pop()
                    open_[closed] -= 1
            stack.append((name, state))
            open_[name] += 1
            kind = _kind(name, m[3])
            # a header inside an article holds its title
            if kind == WEAK or name == "header" and kind == FURNITURE:
                kind = SILENT if state == ARTICLE else FURNITURE
            if kind != SILENT and state != CLOSED:
                state = kind
    parts.append(page[at:] if not re.match(r"<[/!a-zA-Z]", page[at : at + 2]) else "")
    flush()
    return out


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_EDGE = np.uint64(0x5851F42D4C957F2D)


class Streams:
    """The token streams of a batch of pages one after another, each between RUN edge marks, with digests of any run."""

    def __init__(self, texts: pa.ListArray) -> None:
        flat = texts.flatten()
        self.n_blocks = np.diff(texts.offsets.to_numpy())
        data, offsets = textnp.column_bytes(flat)
        starts, ends, first = textnp.word_spans(data, offsets)
        tokens = textnp.word_hashes(data, starts, ends)
        self.page_of_block = np.repeat(np.arange(len(self.n_blocks)), self.n_blocks)
        sizes = np.diff(first)
        self.size = np.bincount(self.page_of_block, sizes, len(self.n_blocks)).astype(np.int64) if len(sizes) else np.zeros(len(self.n_blocks), np.int64)
        shift = RUN * (2 * self.page_of_block + 1)
        self.begin, self.end = first[:-1] + shift, first[1:] + shift
        self.page_begin = np.cumsum(self.size) - self.size + RUN * (2 * np.arange(len(self.size)) + 1)
        padded = np.full(len(tokens) + 2 * RUN * len(self.size), _EDGE)
        padded[np.arange(len(tokens)) + np.repeat(shift, sizes)] = tokens
        self.total = np.zeros(len(padded) + 1, np.uint64)
        np.cumsum(padded * _powers(_BASE, len(padded)), out=self.total[1:])
        self.inverse = _powers(_INVERSE, len(padded) + 1)

    def digest(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        return textnp.mix64((self.total[end] - self.total[at]) * self.inverse[at] + (end - at).astype(np.uint64))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Page, first and last position of the runs that stand for the streams' suffixes.

        Each block is a run, a short one with what follows and with what goes before it up to RUN tokens. Of WINDOW
        neighbouring suffixes the one of least hash is kept, with the run to the next one kept and RUN - 1 tokens more.
        """
        b = [self.begin, np.minimum(self.begin, self.end - RUN)]
        e = [np.maximum(self.end, self.begin + RUN), self.end]
        p = [self.page_of_block, self.page_of_block]
        counts = np.maximum(self.size - RUN + 1, 0)
        page = np.repeat(np.arange(len(counts)), counts)
        at = np.repeat(self.page_begin - np.cumsum(counts) + counts, counts) + np.arange(len(page))
        wide = len(at) - WINDOW + 1
        if wide > 0:
            hashes = self.digest(at, at + RUN)
            least, anchor = hashes[:wide].copy(), np.arange(wide)
            for k in range(1, WINDOW):
                lower = hashes[k : k + wide] <= least
                least[lower] = hashes[k : k + wide][lower]
                anchor[lower] = np.flatnonzero(lower) + k
            anchor = np.unique(anchor[page[:wide] == page[WINDOW - 1 :]])
            same = page[anchor[1:]] == page[anchor[:-1]] if len(anchor) else np.zeros(0, bool)
            p.append(page[anchor[:-1]][same])
            b.append(at[anchor[:-1]][same])
            e.append(at[anchor[1:]][same] + RUN - 1)
        return np.concatenate(p), np.concatenate(b), np.concatenate(e)

    def keys(self, hosts: np.ndarray, page: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return textnp.mix64(self.digest(begin, end) ^ textnp.mix64(hosts.view(np.uint64))[page])

    def contents(self, furniture: np.ndarray) -> np.ndarray:
        """A digest of each page's long blocks that are no furniture (without any, of its stream): pages of one digest are copies."""
        out = self.digest(self.page_begin, self.page_begin + self.size)
        own = ~furniture & (self.end - self.begin >= RUN)
        if own.any():
            page = self.page_of_block[own]
            h = self.digest(self.begin[own], self.end[own])
            head = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
            rank = np.arange(len(page)) - np.repeat(head, np.diff(np.r_[head, len(page)]))
            out[page[head]] = textnp.mix64(np.add.reduceat(textnp.mix64(h + rank.astype(np.uint64)), head))
        return out

    def covered(self, page: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The share of each block's tokens inside the runs given by page and place in its stream."""
        marks = np.zeros(len(self.total) + 1, np.int64)
        base = self.page_begin[page]
        np.add.at(marks, base + np.maximum(begin, 0), 1)
        np.add.at(marks, base + np.maximum(np.minimum(end, self.size[page]), 0), -1)
        inside = np.r_[0, np.cumsum(np.cumsum(marks[:-1]) > 0)]
        return (inside[self.end] - inside[self.begin]) / np.maximum(self.end - self.begin, 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            part = batch.slice(i, 64)
            found = [blocks(x.as_py() or "") for x in part.column("html")]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("page_id", "url", "host", "k1", "k2")),
                 pa.array([[t for t, _ in b] for b in found], pa.list_(pa.string())),
                 pa.array([[s for _, s in b] for b in found], pa.list_(pa.int32()))],
                ["page_id", "url", "host", "k1", "k2", "texts", "states"],
            )


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about 1 MB of text, or of one page."""
    sizes = np.array([sum(map(len, x.as_py() or [])) for x in batch.column("texts")])
    for i, j in textnp.slices(np.r_[0, np.cumsum(sizes)], 1 << 20):
        yield batch.slice(i, j - i)


def _states(part: pa.RecordBatch) -> np.ndarray:
    return part.column("states").flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _run_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every run of a slice once: its key, the least and greatest content that has it, and its places."""
    for batch in batches:
        for part in _slices(batch):
            s = Streams(part.column("texts"))
            page, begin, end = s.runs()
            keys = s.keys(part.column("host").to_numpy(), page, begin, end)
            content = s.contents(_states(part) == FURNITURE)[page].view(np.int64)
            order = np.argsort(keys, kind="stable")
            keys, content = keys[order], content[order]
            head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
            if len(head):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[head].view(np.int64)), pa.array(np.minimum.reduceat(content, head)), pa.array(np.maximum.reduceat(content, head)),
                     pa.array(np.diff(np.r_[head, len(keys)]))], ["key", "lo", "hi", "n"],
                )


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs that touch a block outside of articles, by content of the page and place in its stream."""
    for batch in batches:
        for part in _slices(batch):
            s = Streams(part.column("texts"))
            page, begin, end = s.runs()
            outside = np.zeros(len(s.total), np.int64)
            open_ = _states(part) != ARTICLE
            np.add.at(outside, s.begin[open_], 1)
            np.add.at(outside, s.end[open_], -1)
            inside = np.r_[0, np.cumsum(np.cumsum(outside) > 0)]
            touch = inside[np.minimum(end, len(s.total))] > inside[np.maximum(begin, 0)]
            page, begin, end = page[touch], begin[touch], end[touch]
            rows = pa.array(page)
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.keys(part.column("host").to_numpy(), page, begin, end).view(np.int64)), part.column("k1").take(rows), part.column("k2").take(rows),
                 pa.array((begin - s.page_begin[page]).astype(np.int32)), pa.array((end - s.page_begin[page]).astype(np.int32))],
                ["key", "k1", "k2", "b", "e"],
            )


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of pages with the runs that their hosts repeat."""
    for batch in batches:
        for part in _slices(batch):
            s = Streams(part.column("texts"))
            runs = part.column("runs").fill_null([])
            page = runs.value_parent_indices().to_numpy() if len(runs) else np.zeros(0, np.int64)
            spans = runs.flatten()
            begin, end = (spans.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            repeated = s.covered(page, begin, end) >= COVERED
            states = _states(part)
            # what is repeated goes but for an article's own blocks; of what is unique only what is furniture by its mark-up
            by_run = repeated & (states != ARTICLE)
            by_structure = ~by_run & (states == FURNITURE)
            keep = ~(by_run | by_structure)
            count = lambda x: pa.array(np.bincount(s.page_of_block[x], minlength=len(s.size)).astype(np.int64))
            flat, bounds = part.column("texts").flatten().to_pylist(), np.r_[0, np.cumsum(s.n_blocks)]
            texts = ["\n".join(flat[k] for k in range(bounds[i], bounds[i + 1]) if keep[k]) for i in range(len(s.size))]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), count(by_run), count(by_structure)],
                ["page_id", "url", "text", "n_chars", "n_repeated", "n_furniture"],
            )


def _repeated_runs(parsed: DataFrame) -> DataFrame:
    """k1, k2, runs: for each content its runs outside of articles that stand in two distinct pages of the host."""
    counts = parsed.select("host", "texts", "states").mapInArrow(_run_counts, "key long, lo long, hi long, n long")
    repeated = materialise(
        counts.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).where("lo <> hi").select("key", "n")
    )
    asked = parsed.select("host", "k1", "k2", "texts", "states").mapInArrow(_asked, "key long, k1 long, k2 long, b int, e int")
    found, total = repeated.agg(F.count("*"), F.sum("n")).first()
    keys = repeated.select("key")
    if found <= BROADCAST_IDS:
        hits = asked.join(F.broadcast(keys), "key", "left_semi")
    else:
        # at most 10,000 runs can have more than a ten-thousandth of all places
        hot, cold = F.col("n") > total / 10_000, F.col("n") <= total / 10_000
        hits = asked.join(F.broadcast(repeated.where(hot).select("key")), "key", "left_semi").unionByName(
            asked.join(F.broadcast(repeated.where(hot).select("key")), "key", "left_anti").join(repeated.where(cold).select("key"), "key", "left_semi")
        )
    return hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("b", "e")).alias("runs"))


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per row of `pages`: page_id, url, text, n_chars (code points), n_repeated, n_furniture.

    Blocks are trimmed, their white space runs made one space, and joined by line feeds in page order. A block outside of
    an article or main element goes if runs of RUN tokens or more that stand in two distinct pages of its host cover it
    (counted in n_repeated); else it goes if structure calls it furniture or the page has an article elsewhere (counted
    in n_furniture). All other blocks stay. Pages whose long blocks are equal are copies and count as one, so a copied
    story isn't boilerplate. A null html is empty; a null url is a host of its own. Repeated rows each get a row; an
    empty table gives none. Ties can't arise: runs are counted, not ranked. Other columns are not read.
    """
    prepare(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)), F.lit(""))
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id", "url", html.alias("html"), F.xxhash64(host).alias("host"), F.xxhash64(host, html).alias("k1"), F.xxhash64(html, host, F.lit(1)).alias("k2")
    )
    # parsing again costs less than keeping the blocks of all pages on disk
    parsed = rows.mapInArrow(
        _parse, "page_id long, url string, host long, k1 long, k2 long, texts array<string>, states array<int>"
    )
    runs = materialise(_repeated_runs(parsed))
    # contents of which there are very many copies are few; they are joined by themselves
    copies = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    hot = materialise(copies.where(F.col("n") > max(1000, rows.count() / HOT_SHARE)).select("k1", "k2"))
    if hot.isEmpty():
        joined = parsed.join(runs, ["k1", "k2"], "left")
    else:
        mine = materialise(runs.join(F.broadcast(hot), ["k1", "k2"], "left_semi"))
        if mine.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0] <= BROADCAST_IDS:
            mine = F.broadcast(mine)
        joined = parsed.join(F.broadcast(hot), ["k1", "k2"], "left_semi").join(mine, ["k1", "k2"], "left").unionByName(
            parsed.join(F.broadcast(hot), ["k1", "k2"], "left_anti").join(runs, ["k1", "k2"], "left")
        )
    return joined.select("page_id", "url", "texts", "states", "runs").mapInArrow(
        _write, "page_id long, url string, text string, n_chars long, n_repeated long, n_furniture long"
    )

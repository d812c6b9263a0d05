"""Whitening, ranked search and token counts against brute force, the tokenizer's library and odd inputs."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from codeloom.llm import lexical_search, registry, token_counts, whitening

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# whitening


def brute_whitening(rows, components=16):
    """(vec_id -> deviation, whitened matrix) by a dense eigensolver."""
    kept = [(i, np.floor(64 * np.array(v, np.float64)).astype(np.int64) + 1_000_000) for i, v in rows]
    x = np.stack([v for _, v in kept])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    e, vec = np.linalg.eigh(c.T @ c / n)
    e, vec = e[::-1][:components], vec[:, ::-1][:, :components]
    return n, ((n * x - s) ** 2).sum(1), ((x - s / n) @ vec) / np.sqrt(e), e, np.trace(c.T @ c / n)


def check_whitening(rows, got, components=16):
    n, deviation, want, e, trace = brute_whitening(rows, components)
    assert len(got) == len(rows) * len(e)
    z = np.array([r.whitened for r in got]).reshape(len(rows), len(e))
    signs = np.sign((z * want).sum(0))
    assert np.abs(z * signs - want).max() < 1e-7
    assert [r.deviation for r in got[:: len(e)]] == deviation.tolist()
    assert {r.n for r in got} == {n}
    for r in got:
        assert math.isclose(r.explained, e[r.component - 1] / trace, rel_tol=1e-9) and r.identity_error < 1e-10


def test_whitening_matches_a_dense_solver(spark):
    df = registry.op11_embedding_whitening(spark, SF)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    check_whitening(rows, df.orderBy("vec_id", "component").collect())


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, n int, component string")


def test_whitening_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(whitening, "DIRECT_PARTS", 0)
    rng = np.random.default_rng(5)
    good = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32) * [9, 5, 3, 1, 0.5, 0.2]]) for i in range(60)]
    good += [(100 + i, good[0][1]) for i in range(30)] + [(7, good[3][1])]
    bad = [(200, None), (201, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (202, [float("nan")] * 6), (203, [float("inf")] + [0.0] * 5), (204, []), (205, [1.0, 2.0])]
    got = whitening.whiten(vectors_of(spark, good + bad)).collect()
    order = sorted(range(len(good)), key=lambda i: good[i][0])
    assert {r.vec_id for r in got} == {i for i, _ in good}
    rows = [good[i] for i in order]
    n, deviation, want, e, _ = brute_whitening(rows)
    assert {r.n for r in got} == {n} and len(got) == len(rows) * 6
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == Counter((i, d) for (i, _), d in zip(rows, deviation.tolist(), strict=True))
    assert whitening.whiten(vectors_of(spark, good[:0])).collect() == []
    assert whitening.whiten(vectors_of(spark, bad[:3])).collect() == []
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    null_id = whitening.whiten(vectors_of(spark, [(None, [1.0, 2.0]), (2, [2.0, 9.0])])).collect()
    assert {r.vec_id for r in null_id} == {None, 2} and {r.component for r in null_id} == {1}


def test_equal_deviations_and_missing_spread(spark):
    # the corners of a cube have one deviation three times, and two dimensions have none
    rows = [(i, [4.0 * (i & 1), 2.0 * (i & 2), 1.0 * (i & 4), 7.0, -3.0]) for i in range(8)]
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    assert {r.component for r in got} == {1, 2, 3} and all(math.isclose(r.explained, 1 / 3) for r in got)
    z = np.zeros((8, 3))
    for r in got:
        z[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(z.T @ z / 8 - np.eye(3)).max() < 1e-12


def test_numbers_beyond_64_bits_are_null():
    assert whitening._deviations(np.array([[1 << 40], [3]]), 1 << 40, [5]) == [None, ((3 << 40) - 5) ** 2 if ((3 << 40) - 5) ** 2 < 1 << 63 else None]
    assert whitening._deviations(np.array([[1 << 20], [3]]), 1 << 12, [5]) == [((1 << 32) - 5) ** 2 if ((1 << 32) - 5) ** 2 < 1 << 63 else None, ((3 << 12) - 5) ** 2]
    assert whitening._floor(np.array([1e300, -1e300])).tolist()[1] == -(1 << 63)


# ranked search


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def brute_ranks(docs, items, top=10):
    bags = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    n_docs, total = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        scores = []
        for i, bag in bags:
            if not bag:
                continue
            m = 25 + (75 * sum(bag.values()) * n_docs) // total
            s = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t, q in Counter(TERM.findall(lower(text or ""))).items() if bag[t]
            )
            if s > 0:
                scores.append((-s, math.inf if i is None else i))
        out += [(item, k, None if i == math.inf else i, -s) for k, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_search_matches_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.op12_ranked_search(spark, SF).select("item_id", "rank", "doc_id", "score")
    assert rows(got) == sorted(con.execute(lexical_search.ORACLE_SQL).fetchall(), key=str)


def test_search_odd_rows(spark):
    rng = random.Random(3)
    words = ["wort", "Été", "x9", "ÀB", "日本", "the", "The", "id", "z"] + [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(150)]
    docs += [(500 + i, "wort the id wort") for i in range(40)] + [(3, docs[3][1]), (None, "wort wort wort"), (900, None), (901, ""), (902, " .,;- ")]
    docs += [(950, " ".join(rng.choices(words, k=300_000)))]
    items = [(1, "The WORT, wort-id"), (2, None), (3, ""), (4, "..."), (5, "unheard"), (6, "w1 w2 w3 日本"), (6, "x9"), (7, "the the the"), (7, "the the the"), (None, "z")]
    d = spark.createDataFrame([(i, t, "q", 1) for i, t in docs], "doc_id long, text string, item_id string, score int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute_ranks(docs, items), key=str)
    assert rows(lexical_search.ranked(d, b)) == want
    assert rows(lexical_search.ranked(d, b, query_bytes=10)) == want
    assert lexical_search.ranked(d.limit(0), b).collect() == []
    assert lexical_search.ranked(d, b.limit(0)).collect() == []


def test_bounds_are_never_too_low():
    import pyarrow as pa

    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words[: rng.choice([5, 50, 300])], k=rng.randint(1, 400))) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    q = lexical_search.Queries([" ".join(rng.choices(words, k=12)) for _ in range(20)])
    q.weigh(200, dict.fromkeys(range(len(q.vocabulary)), 20))
    looseness = []
    for block in lexical_search._index(iter([batch])):
        ids, lengths, bits = block.column(0)[0].as_py(), np.array(block.column(1)[0].as_py()), block.column(3)[0].as_py()
        m = lexical_search._m(lengths, 200, int(lengths.sum()))
        slices = np.frombuffer(block.column(4)[0].as_py(), np.uint8).reshape(bits, -1)
        bound = sum(q.slice_sums(0, 20, s) * adds for s, adds in lexical_search._bounds(q, bits, slices, m))
        h, row, n, _ = lexical_search._counted(pa.array([texts[i] for i in ids]))
        at = np.minimum(np.searchsorted(q.vocabulary, h), len(q.vocabulary) - 1)
        on = q.vocabulary[at] == h
        exact = q.scores(0, 20, at[on], row[on], lexical_search._share(n[on], m[row[on]]), len(ids))
        assert (bound >= exact).all()
        looseness.append((bound.sum(), exact.sum()))
    assert sum(b for b, _ in looseness) < 1.6 * sum(e for _, e in looseness)


# token counts


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def machine():
    return token_counts.Transducer(token_counts.load_vocabulary(MODEL))


def odd_texts():
    rng = random.Random(1)
    return [
        None, "", "\n", " ", "▁", " a  b ", "a" * 5000, "aaaa " * 100, "=" * 3000 + "x", "\x00a", "日本語テキスト" * 300, "the" * 2000,
        " " * 1000 + "x" + " " * 37, "<s> </s> <unk> <0x0A>", "ﬁ é é ​﻿",
        "".join(rng.choice("abcdefghijklmnop_./ -=ABC0123456789é日\n\t▁") for _ in range(20000)),
        "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2000), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x1F300, 0x1F700)])) for _ in range(20000)),
        "".join(rng.choice("abt=-#") * rng.randrange(1, 40) for _ in range(2000)),
    ]


def test_token_counts_are_the_librarys(machine, library):
    texts = odd_texts() + ["".join(random.Random(2).choices(list(machine.scores), k=5000))]
    assert token_counts.count_tokens(machine, texts).tolist() == [len(library.encode(t)) if t else 0 for t in texts]


def test_token_counts_across_segments(machine, library, monkeypatch):
    monkeypatch.setattr(token_counts, "SEGMENT", 700)
    monkeypatch.setattr(token_counts, "CHUNK", 16)
    monkeypatch.setattr(token_counts, "TRANSITIONS", 3000)
    texts = odd_texts()
    assert token_counts.count_tokens(machine, texts).tolist() == [len(library.encode(t)) if t else 0 for t in texts]


def test_every_short_text_of_a_small_vocabulary():
    import itertools

    scores = {"ab": -1.0, "ba": -2.0, "aa": -3.0, "aba": -4.0, "bab": -5.0, "aaaa": -6.0, "▁a": -7.0, "a": -8.0, "b": -9.0, "▁": -10.0}
    machine = token_counts.Transducer(scores)
    texts = ["".join(t) for k in range(1, 9) for t in itertools.product("ab ", repeat=k)]
    want = [len(machine.merge("▁" + t.replace(" ", "▁"))) for t in texts]
    assert token_counts.count_tokens(machine, texts).tolist() == want


def test_token_counts_of_documents(spark, library):
    got = {r.doc_id: tuple(r)[1:] for r in registry.op13_token_counts(spark, SF).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got == {i: (len(t.encode()), n := len(library.encode(t)), n > 4096) for i, t in texts.items()}
    odd = spark.createDataFrame([(1, None, 3), (1, "", 4), (None, "ab ab", 5), (None, "ab ab", 5)], "doc_id long, text string, n_tokens int")
    assert sorted(map(tuple, token_counts.token_counts(odd, MODEL).collect()), key=str) == [(1, 0, 0, False)] * 2 + [(None, 5, 2, False)] * 2
    assert token_counts.token_counts(odd.limit(0), MODEL).collect() == []

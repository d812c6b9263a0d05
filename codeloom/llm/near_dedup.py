"""Near-duplicate documents by circulant MinHash.

Two permutations of a hashed universe make the whole signature: the first scatters a document's
shingles, the second is looked up at the scattered place shifted by k to give coordinate k, so one
shingle yields all coordinates as one contiguous run of the shifted table. Coordinates are banded;
documents that share a band are candidates, and every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import textnp
from codeloom.llm.components import connected_components
from codeloom.llm.io import discard, materialise, prepare, small, spread_join

WIDTH, BANDS, ROWS = 5, 48, 5
UNIVERSE = 1 << 18
_BLOCK = 8192


def _permutations(coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    scatter = rng.permutation(UNIVERSE).astype(np.uint32)
    ranks = rng.permutation(UNIVERSE).astype(np.uint32)
    shifted = np.concatenate([ranks, ranks[:coordinates]])
    return scatter, np.lib.stride_tricks.sliding_window_view(shifted, coordinates)


def signatures(shingles: np.ndarray, rows: np.ndarray, n_rows: int, scatter: np.ndarray, shifted: np.ndarray) -> np.ndarray:
    """Circulant signatures (n_rows x coordinates) of shingles sorted by row; rows without shingles stay at the maximum."""
    out = np.full((n_rows, shifted.shape[1]), 0xFFFFFFFF, np.uint32)
    places = scatter[shingles & np.uint64(UNIVERSE - 1)]
    for i in range(0, len(rows), _BLOCK):
        part = rows[i : i + _BLOCK]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        least = np.minimum.reduceat(shifted[places[i : i + _BLOCK]], first, axis=0)
        np.minimum.at(out, part[first], least) if len(first) < 2 else out.__setitem__(
            part[first], np.minimum(out[part[first]], least)
        )
    return out


def _sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = textnp.word_spans(data, offsets)
    words = textnp.word_hashes(data, starts, ends)
    return textnp.distinct_per_row(*textnp.shingle_hashes(words, first, width))


def _long_lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _features(width: int, bands: int, rows_per_band: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scatter, shifted = _permutations(bands * rows_per_band, seed)
        salt = textnp._splitmix_table(rows_per_band, 77) | np.uint64(1)
        lane = textnp._splitmix_table(bands, 99)
        for batch in batches:
            data, offsets = textnp.column_bytes(batch.column(1))
            for i, j in textnp.slices(offsets):
                shingles, rows = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                counts = np.bincount(rows, minlength=j - i)
                has = np.flatnonzero(counts)
                digest = np.zeros(j - i, np.uint64)
                if len(has):
                    first = (np.cumsum(counts) - counts)[has]
                    digest[has] = textnp.mix64(
                        np.add.reduceat(textnp.mix64(shingles), first)
                        ^ (np.bitwise_xor.reduceat(shingles, first) * np.uint64(0x9E3779B97F4A7C15))
                        ^ counts[has].astype(np.uint64)
                    )
                sig = signatures(shingles, rows, j - i, scatter, shifted)[has].astype(np.uint64)
                keys = np.zeros((len(has), bands), np.uint64)
                for k in range(rows_per_band):
                    keys += textnp.mix64(sig[:, k::rows_per_band] + np.uint64(k + 1)) * salt[k]
                keys = textnp.mix64(keys + lane)
                lengths = np.where(counts > 0, bands, 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(counts.astype(np.int64)), pa.array(digest.view(np.int64)),
                     _long_lists(np.ascontiguousarray(keys).reshape(-1), lengths)],
                    ["doc_id", "h", "n", "cls", "bands"],
                )
    return run


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textnp.column_bytes(batch.column(1))
            for i, j in textnp.slices(offsets):
                shingles, rows = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), _long_lists(shingles, np.bincount(rows, minlength=j - i))],
                    ["cls", "shingles"],
                )
    return run


def _sets_of(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(cls, shingles) of the classes in `wanted` (doc_id, cls); materialised."""
    return materialise(docs.join(small(materialise(wanted)), "doc_id").select("cls", "text").mapInArrow(
        _shingle_sets(width), "cls long, shingles array<long>"
    ))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets reach the threshold; materialised."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return materialise(
        pairs.join(left, "a").join(right, "b")
        .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")
    )


def _enough(x, y, percent: int):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different roots that may reach the threshold; none that does is missing.

    With shingles in one order for all, two sets that reach it share a shingle among the first
    n - ceil(n * percent / 100) + 1 of each, and at the first that they share enough must be left in both
    to make the least intersection that their sizes allow. The order is by how many of `nodes` hold a
    shingle: passages that many share come last, where too little is left, and pair nobody.
    """
    held = sets.select("cls", F.explode("shingles").alias("token"))
    common = held.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = held.join(common, "token").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("by_df"))
    n, alone = F.col("n"), F.col("n") - F.size("by_df")
    take = n - F.ceil(n * percent / 100) + 1 - alone
    prefix = materialise(
        nodes.join(ranked, "cls").where(take > 0)
        .select("cls", "n", "root", alone.alias("alone"), F.posexplode(F.slice("by_df", F.lit(1), take.cast("int"))))
        .select("cls", "n", "root", F.col("col.token").alias("token"), (n - F.col("alone") - F.col("pos")).alias("left"))
    )
    mixed = prefix.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("token")
    prefix = materialise(prefix.join(mixed, "token"))
    other = prefix.select("token", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("left").alias("left_b"))
    return prefix.join(other, "token").where(
        (F.col("cls") < F.col("b")) & (F.col("root") != F.col("rb")) & _enough(F.col("n"), F.col("nb"), percent)
        & (F.least("left", "left_b") * (100 + percent) >= percent * (F.col("n") + F.col("nb")))
    ).select(F.col("cls").alias("a"), "b").distinct()


def _grouped(
    docs: DataFrame, *, width: int = WIDTH, percent: int = 75, bands: int = BANDS, rows_per_band: int = ROWS, seed: int = 8
) -> tuple[DataFrame, DataFrame]:
    """Rows as (doc_id, h, n, cls), with the hash of the text, the size of its set and the class of equal sets, and (cls, rep, root)."""
    prepare(docs.sparkSession)
    spark, docs = docs.sparkSession, docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    wide = materialise(docs.mapInArrow(
        _features(width, bands, rows_per_band, seed), "doc_id long, h long, n long, cls long, bands array<long>"
    ))
    feats = materialise(wide.select("doc_id", "h", "n", "cls"))
    classes = materialise(
        feats.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"))
    )
    of_class = classes.select("cls", F.col("rep").alias("doc_id"))
    first = wide.join(of_class, ["cls", "doc_id"])
    if feats.join(of_class, ["cls", "doc_id"]).count() > classes.count():
        first = first.dropDuplicates(["cls"])  # rows that repeat a doc_id
    banded = materialise(first.select("cls", "n", F.explode("bands").alias("key")))
    discard(spark, wide)
    shared = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    members = materialise(banded.join(shared, "key").distinct())
    discard(spark, banded)
    reach = members.groupBy("cls").agg(F.sum(F.col("c") - 1).alias("reach"))
    members = materialise(members.join(reach, "cls"))
    centres = members.groupBy("key").agg(F.max(F.struct("reach", "cls", "n")).alias("centre"))
    stars = materialise(members.join(centres, "key").where(
        (F.col("cls") != F.col("centre.cls")) & _enough(F.col("n"), F.col("centre.n"), percent)
    ).select(F.col("cls").alias("a"), F.col("centre.cls").alias("b")).distinct())
    of = lambda ids: classes.join(ids, "cls").select(F.col("rep").alias("doc_id"), "cls")
    ends = stars.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets = _sets_of(of(ends), docs, width)
    links = _confirmed(stars, sets, percent)
    discard(spark, sets)
    roots = connected_components(links)
    labelled = materialise(members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
        "key", "cls", "n", F.coalesce("root", "cls").alias("root")
    ))
    open_keys = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    nodes = materialise(labelled.join(open_keys, "key").select("cls", "n", "root").distinct())
    sets = _sets_of(of(nodes.select("cls")), docs, width)
    more = _confirmed(materialise(_prefix_pairs(nodes, sets, percent)), sets, percent)
    discard(spark, sets)
    if not more.isEmpty():
        roots = connected_components(links.union(more))
    grouped = materialise(
        classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    )
    discard(spark, members, stars, labelled, nodes)
    return feats, grouped


_EMPTY = "n = 0 OR doc_id IS NULL"


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set holds the distinct `width`-word shingles of its text (A-Z lower-cased, words split at
    ASCII white space); fewer words make one shingle, no words an empty set that is linked with nothing.
    Documents are linked where 100 * intersection >= percent * union; component_id is the least doc_id
    reachable over links and kept marks that document. 48 bands of 5 coordinates miss a pair of
    similarity 0.75 with probability 3e-6.

    Equal sets are one class and are never compared. In each bucket the classes are first compared with the
    bucket's most connected class, which settles large groups with one comparison per member. Classes of
    buckets that still span components are then compared by an exact prefix filter over their sets, so no
    link between components is lost and a group of n that share a passage doesn't make n * n pairs.

    A row without doc_id is not linked (component_id null, kept true). Rows that repeat a doc_id each get
    a row. An empty table gives an empty result. Only doc_id and text are read; other columns are ignored.
    """
    feats, grouped = _grouped(docs, **options)
    least = materialise(grouped.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("rows")))
    component = spread_join(grouped, least, "root").select("cls", "component_id")
    rows = materialise(component.join(feats.where(f"NOT ({_EMPTY})").groupBy("cls").agg(F.count("*").alias("rows")), "cls"))
    linked = spread_join(feats.where(f"NOT ({_EMPTY})").select("doc_id", "n", "cls"), rows, "cls")
    alone = feats.where(_EMPTY).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n", "component_id").unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` with one row of each group of near-duplicates, all columns as they came.

    Rows are judged by doc_id and text: of a group the row of the least doc_id stays (of several, that of the least hash of
    its text), so rows of one id with different texts are each kept or dropped by their own group. Rows without doc_id or
    words stay. Of rows that repeat doc_id and text one stays.
    """
    feats, grouped = _grouped(docs, **options)
    linked = feats.where(f"NOT ({_EMPTY})").groupBy("doc_id", "h", "cls").agg(F.count("*").alias("c"))
    of_class = linked.groupBy("cls").agg(F.min(F.struct("doc_id", "h")).alias("first"))
    heads = grouped.join(of_class, "cls").groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.h")
    gone = small(materialise(linked.join(heads, ["doc_id", "h"], "left_anti").select("doc_id", "h")))
    again = linked.where("c > 1").select("doc_id", "h")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", F.xxhash64("text").alias("h"))
    left = keyed.join(gone, ["doc_id", "h"], "left_anti")
    if not again.isEmpty():
        repeated = left.join(again, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
        left = left.join(again, ["doc_id", "h"], "left_anti").unionByName(repeated)
    return left.select("_row.*")

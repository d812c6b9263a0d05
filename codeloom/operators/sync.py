"""One call that brings a stored index up to date with a tree of files, or builds it."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import index
from codeloom.operators.changes import manifest_diff, tombstones
from codeloom.operators.flows import saved
from codeloom.operators.search import FIELDS, postings, searchable
from codeloom.operators.upkeep import keep_members, update_manifest, update_postings
from codeloom.sources import files as sources
from codeloom.sources.store import Store

#: Raised when tables change their form, so that stored indexes are built again.
FORMAT = 1
MANIFEST = ("path", "stamp", "size", "hash")
_STONES = "seq long, qname string, file string, start_line int, n_upstream long, upstream string"


def settings(names: list[str], decorators: list[str]) -> str:
    """A digest of what an index is built with."""
    return hashlib.sha256(json.dumps([FORMAT, sorted(names), sorted(decorators)]).encode()).hexdigest()


def parsed_tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """The tables that an index is built from, of files parsed one a row."""
    parts = {k: sources.exploded(parsed, k) for k in ("nodes", "calls", "imports", "bases")}
    return parts | {"types": sources.exploded(parsed, "types").select("scope", "receiver", "type"), "listed": sources.listed(parsed)}


def _parse(files: DataFrame) -> DataFrame:
    python = files.where(sources.language(F.col("path")) == "python").withColumn("module", sources.module_of(F.col("path")))
    return saved(sources.parse_python(python))


def _named(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("file", F.col("path"))


def _stones(old_nodes: DataFrame, new_nodes: DataFrame, edges: DataFrame, seq: int) -> DataFrame:
    lines = old_nodes.select("qname", F.col("start_line").cast("int").alias("start_line"))
    t = tombstones(_named(old_nodes), new_nodes, edges).join(lines, "qname")
    return t.select(F.lit(seq).cast("long").alias("seq"), "qname", "file", "start_line", "n_upstream", "upstream")


def _build(store: Store, files: DataFrame, names: list[str], decorators: list[str]) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables of a build from scratch, and the names of stored ones that stay: tombstones outlive it."""
    parsed = _parse(files)
    tables = index.build(parsed_tables(parsed), names, decorators)
    tables |= {"parsed": parsed, "files": files.select(*MANIFEST), "postings": postings(searchable(_named(tables["nodes"])), "qname", list(FIELDS))}
    last, same = store.last(), []
    if last is not None and "tombstones" in last.folders:
        same.append("tombstones")
    else:
        tables["tombstones"] = store.spark.createDataFrame([], _STONES)
    if last is not None and "members" in last.folders:
        tables["members"] = keep_members(store.read("members"), tables["nodes"])[0]
    return tables, same


def sync(
    store: Store, files: DataFrame, names: list[str] = (), decorators: list[str] = (), touched: DataFrame | None = None, batch: str | None = None
) -> dict[str, object]:
    """Brings nodes, edges, degrees, flows, postings, members, manifest and tombstones of a store up to date with files(path, content, size, hash, stamp).

    An empty store, or one built with other settings, is built from scratch. Else the manifest says which files came, went or changed, of all or of
    touched(path) alone; those are parsed, and all tables follow in one commit. Tables that a change can't move (flows, postings
    of equal nodes) are referred to and not written again. If it fails the store stays as it was. A named batch is applied once.
    Returns state (`built`, `updated`, `unchanged`, `repeated`), the numbers of files added, changed and deleted, whether flows moved, and seconds.
    A null or empty content is an empty module; a file that doesn't parse has no symbols; hints of unknown files that aren't there change nothing.
    """
    began, names, decorators = time.time(), list(names), list(decorators)
    out = {"state": "unchanged", "added": 0, "changed": 0, "deleted": 0, "flows": False}
    if batch is not None and store.has(batch):
        return out | {"state": "repeated", "seconds": time.time() - began}
    last, now = store.last(), settings(names, decorators)
    meta = lambda t: store.spark.range(1).select(F.lit(now).alias("settings"), F.lit(t).alias("state"))
    if last is None or store.read("meta", last.version).first().settings != now:
        tables, same = _build(store, files, names, decorators)
        store.commit(tables | {"meta": meta("built")}, tuple(same), batch)
        return out | {"state": "built", "added": store.read("files").count(), "flows": True, "seconds": time.time() - began}

    read = lambda name: store.read(name, last.version)
    known, seen = read("files"), files.select(*MANIFEST)
    if touched is not None:
        only = touched.select("path").distinct()
        known, seen = known.join(only, "path", "left_semi"), seen.join(only, "path", "left_semi")
    diff = saved(manifest_diff(known, seen))
    counts = {r.status: r["count"] for r in diff.groupBy("status").count().collect()}
    if not counts:
        return out | {"seconds": time.time() - began}
    fresh = _parse(files.join(diff.where("status <> 'deleted'").select("path"), "path", "left_semi"))
    parsed = saved(index.replace_files(read("parsed"), fresh, diff))
    old = {t: read(t) for t in index.TABLES}
    new, _, moved = index.update(old, parsed_tables(parsed), diff.select("path"), names, decorators)
    tables = {"parsed": parsed, "files": update_manifest(read("files"), files.select(*MANIFEST), diff), "nodes": new["nodes"], "edges": new["edges"], "degrees": new["degrees"],
              "postings": update_postings(read("postings"), _named(old["nodes"]), _named(new["nodes"])),
              "tombstones": read("tombstones").unionByName(_stones(old["nodes"], new["nodes"], old["edges"], last.seq + 1))}
    same = ["meta"]
    if moved:
        tables["flows"] = new["flows"]
    else:
        same.append("flows")
    if "members" in last.folders:
        tables["members"] = keep_members(read("members"), new["nodes"])[0]
    store.commit(tables, tuple(same), batch)
    return out | {"state": "updated"} | counts | {"flows": moved, "seconds": time.time() - began}

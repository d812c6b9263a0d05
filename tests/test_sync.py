"""A store that is brought up to date by one call and by a stream, against one built from scratch."""

import datetime

from pyspark.sql import functions as F

from codeloom.operators import sync
from codeloom.sources.store import Store
from codeloom.streaming import follow

BASE = {
    "src/app/main.py": "from app.util import *\n\ndef main():\n    helper()\n    later()\n",
    "src/app/util.py": "def helper():\n    return other()\n\ndef other():\n    pass\n",
    "src/app/base.py": "class Base:\n    def stay(self):\n        pass\n",
    "src/app/bad.py": "def (:\n",
}
EDITED = {k: v for k, v in BASE.items() if k != "src/app/base.py"} | {
    "src/app/util.py": "def helper(x=1):\n    return 1\n\ndef later():\n    helper()\n",
    "src/app/new.py": "from app.util import helper\n\ndef fresh():\n    helper()\n",
}


def tree(spark, files, stamp=0.0):
    f = spark.createDataFrame([(p, c) for p, c in files.items()], "path string, content string")
    return f.select("*", F.length("content").cast("long").alias("size"), F.sha2(F.col("content").cast("binary"), 256).alias("hash"), F.lit(stamp).alias("stamp"))


COLUMNS = {
    "nodes": ("qname", "kind", "parent", "path", "start_line", "signature"), "edges": ("path", "source", "target", "kind", "resolution"),
    "degrees": ("qname", "in_degree", "out_degree"), "flows": ("entry", "node", "position", "depth"), "postings": ("id", "field", "pos", "token"),
    "files": ("path", "size", "hash"),
}


def tables(store):
    return {t: sorted(tuple(map(str, r)) for r in store.read(t).select(*c).collect()) for t, c in COLUMNS.items()}


def test_sync_and_stream_equal_a_build(spark, tmp_path):
    store, scratch = Store(spark, str(tmp_path / "index")), Store(spark, str(tmp_path / "scratch"))
    assert sync.sync(store, tree(spark, BASE), ["main"])["state"] == "built"
    ids = {r.qname: r.id for r in store.read("nodes").collect()}
    assert sync.sync(store, tree(spark, BASE, 9.0), ["main"])["state"] == "unchanged" and store.last().seq == 1

    # a stream whose events come late, twice and out of order; c is quiet only after the watermark passed it
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, "src/app/util.py", "modified", at(3)), (2, "src/app/new.py", "added", at(1)), (1, "src/app/util.py", "modified", at(3)),
            (3, "src/app/base.py", "modified", at(1)), (4, "src/app/base.py", "deleted", at(1)), (5, "notes.txt", "added", at(1)), (6, "src/app/gone.py", "deleted", at(2)),
            (7, None, "added", at(2)), (8, "src/app/util.py", None, None)]
    schema = "event_id long, path string, change string, ts timestamp"
    inbox = str(tmp_path / "events")
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
    spark.createDataFrame([(9, "src/app/main.py", "modified", at(50))], schema).coalesce(1).write.mode("append").parquet(inbox)
    batch = {(r.path, r.change, r.n_events) for r in follow.settled(spark.read.schema(schema).parquet(inbox), "1 second", "5 seconds").collect()}
    assert batch == {("src/app/util.py", "modified", 1), ("src/app/new.py", "added", 1), ("src/app/base.py", "deleted", 2), ("src/app/gone.py", "deleted", 1), ("src/app/main.py", "modified", 1)}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    now = iter([tree(spark, BASE)] + [tree(spark, EDITED)] * 9)
    follow.follow(store, stream, lambda: next(now), str(tmp_path / "checkpoint"), "s", ["main"], quiet="1 second", late="5 seconds", once=True).awaitTermination()
    sync.sync(scratch, tree(spark, EDITED), ["main"])
    assert tables(store) == tables(scratch)
    assert {r.qname for r in store.read("tombstones").collect()} == {"app.base", "app.base::Base", "app.base::Base.stay", "app.util::other"}
    assert all(r.id == ids[r.qname] for r in store.read("nodes").collect() if r.qname in ids)

    # the same batch again changes nothing; other settings build anew, and tombstones outlive that
    done = [r.batch for r in store._pointers().where("batch IS NOT NULL").collect()]
    seq = store.last().seq
    assert len(done) == 1 and sync.sync(store, tree(spark, BASE), ["main"], batch=done[0])["state"] == "repeated" and store.last().seq == seq
    assert sync.sync(store, tree(spark, EDITED), ["main", "fresh"])["state"] == "built" and store.read("tombstones").count() == 4
    assert store.prune(1) and store.read("tombstones").count() == 4 and store.read("flows").count() > 0


def test_a_body_alone_keeps_flows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "index"))
    small = {"src/a.py": "def f():\n    pass\n", "src/b.py": None}
    sync.sync(store, tree(spark, small).na.fill(0, ["size"]))
    folder = store.last().folders["flows"]
    got = sync.sync(store, tree(spark, small | {"src/a.py": "def f():\n    return 1\n"}).na.fill(0, ["size"]))
    assert (got["state"], got["changed"], got["flows"]) == ("updated", 1, False) and store.last().folders["flows"] == folder
    assert sync.sync(store, tree(spark, {}).na.fill(0, ["size"]))["deleted"] == 2 and store.read("nodes").count() == 0 and store.read("files").count() == 0

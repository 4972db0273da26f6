"""Leases, vacuum, co-partitioned lookups and bucket-wise re-indexing."""

import os
import threading

import pytest
from pyspark.sql import functions as F
from test_store import change, frame, names_in, stored

from vesper.operators import freshness
from vesper.schemas import LISTING
from vesper.sources.store import Store, Superseded, bucket_of
from vesper.streaming.reindex import pending


def listed(spark, *rows):
    return spark.createDataFrame([(p, p.rsplit("/", 1)[0], size, 1, i) for i, (p, size) in enumerate(rows)], LISTING)


def test_a_leased_version_outlives_ten_writes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=2, keep=1)
    store.upsert(frame(spark, *[change(f"/d/{i}.jpg") for i in range(6)]), 1)
    with store.lease() as lease:
        reader = lease.read()
        for i in range(10):
            store.upsert(frame(spark, change(f"/d/{i % 6}.jpg", size=20 + i)), 2 + i)
        assert {r["file_size"] for r in reader.collect()} == {10} and lease.number == 1
        assert names_in(tmp_path / "s" / "versions") == {"000000000001", "000000000011"}
        store.vacuum(grace=0)
        assert {r["file_size"] for r in lease.read().collect()} == {10}
    store.upsert(frame(spark, change("/d/0.jpg", size=99)), 50)
    assert names_in(tmp_path / "s" / "versions") == {"000000000012"} and not names_in(tmp_path / "s" / "leases")
    with pytest.raises(Exception, match=r"(?i)not.?(found|exist)"):
        lease.read().collect()


def test_an_expired_lease_pins_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=1, keep=1)
    store.lease(seconds=-1)
    store.upsert(frame(spark, change("/d/a.jpg")), 1)
    store.lease(seconds=-1)
    store.upsert(frame(spark, change("/d/b.jpg")), 2)
    assert names_in(tmp_path / "s" / "versions") == {"000000000002"} and not names_in(tmp_path / "s" / "leases")


def test_vacuum_takes_what_no_version_names(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"), buckets=4, keep=1)
    store.upsert(frame(spark, *[change(f"/d/{i}.jpg") for i in range(20)]), 1)
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda number, manifest: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            store.upsert(frame(spark, change("/d/0.jpg", size=11)), 2)
    store.upsert(frame(spark, change("/d/1.jpg", size=12)), 3)
    before = stored(store)
    assert store.vacuum().count() == 0  # all files are young
    gone = store.vacuum(grace=0).collect()
    assert len(gone) >= 3 and all(r["bytes"] > 0 and r["message"] is None for r in gone)
    assert stored(store) == before and names_in(tmp_path / "s") == {"versions", *store._latest()[1]["data"].values()}
    assert len(list((tmp_path / "s").rglob("*.parquet"))) == len(store._latest()[1]["data"]) and store.vacuum(grace=0).count() == 0


def test_a_claimed_number_without_a_manifest_is_passed_over(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=1, patience=0.2)
    store.upsert(frame(spark, change("/d/a.jpg")), 1)
    assert store._claim(2) and not store._claim(2)
    store.upsert(frame(spark, change("/d/b.jpg")), 2)
    assert store._latest()[0] == 3 and len(stored(store)) == 2


def test_writers_at_the_same_moment_lose_nothing(spark, tmp_path):
    stores = [Store(spark, str(tmp_path / "s"), buckets=1) for _ in range(3)]
    errors = []

    def write(k):
        try:
            stores[k].upsert(frame(spark, change(f"/d/{k}.jpg")), k)
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and len(stored(stores[0])) == 3 and stores[0]._latest()[0] == 3


def exchanges(df):
    """The leaves below each exchange of the plan, and those below none."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    out, over = {True: [], False: []}, []
    for line in plan:
        body = line.lstrip(" :+-")
        depth = len(line) - len(body)
        over = [d for d in over if d < depth]
        if body.startswith("Exchange"):
            over.append(depth)
        if "Scan" in body:
            out[bool(over)].append(body)
    return out


def test_a_lookup_shuffles_the_listing_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("vesper.sources.store.FOLDERS", 4)
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    store.upsert(frame(spark, *[change(f"/d/{i}.jpg", clip=[float(i)]) for i in range(0, 60, 2)], change("/d/v.mp4", ns="video")), 1)
    store.upsert(frame(spark, change("/d/4.jpg", size=11), change("/d/6.jpg", clip=[0.5])), 2)
    found = listed(spark, *[(f"/d/{i}.jpg", 10) for i in range(60)], ("/d/v.mp4", 10), ("/none/x.jpg", 1))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scans = exchanges(store.lookup(found, "image"))
        assert not any("parquet" in s for s in scans[True]) and sum("Bucketed: true" in s for s in scans[False]) == len(set(store._latest()[1]["data"].values()))
        key = lambda r: r["ordinal"]
        assert sorted(store.lookup(found, "image").collect(), key=key) == sorted(freshness.lookup(found, store.read(), "image").collect(), key=key)
        store.compact()
        scans = exchanges(store.lookup(found, "image"))
        assert len([s for s in scans[False] if "parquet" in s]) == 1 and not any("parquet" in s for s in scans[True])
        assert sorted(store.lookup(found, "image").collect(), key=key) == sorted(freshness.lookup(found, store.read(), "image").collect(), key=key)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert Store(spark, str(tmp_path / "new")).lookup(found, "image").where("status = 'miss'").count() == 62
    for i in range(5):
        store.upsert(frame(spark, change(f"/d/{i}.jpg", size=30 + i)), 10 + i)
    assert sorted(store.lookup(found, "image").collect(), key=key) == sorted(freshness.lookup(found, store.read(), "image").collect(), key=key)


def test_one_path_reads_one_bucket_and_no_vectors(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    store.upsert(frame(spark, *[change(f"/d/{i}.jpg", clip=[1.0]) for i in range(40)], change("/d/v.mp4", audio=[1.0], ns="video"), change("/d/w.mp4", ns="video")), 1)
    one = listed(spark, ("/d/3.jpg", 11))
    prints = store.fingerprints(one)
    assert len(prints.inputFiles()) == 1 and prints.select("path").distinct().count() == store.read().where(bucket_of(8) == one.select(bucket_of(8)).first()[0]).count()
    todo = pending(one, prints)
    text = todo._jdf.queryExecution().executedPlan().toString()
    assert "has_clip" in text and "clip_vector" not in text and "thumbnail_path" not in text
    every = listed(spark, ("/d/3.jpg", 11), ("/d/4.jpg", 10), ("/d/v.mp4", 10), ("/d/w.mp4", 10), ("/d/new.png", 1))
    assert {(r["path"], r["status"]) for r in pending(every, store.fingerprints(every)).collect()} == {("/d/3.jpg", "invalidated"), ("/d/w.mp4", "hit"), ("/d/new.png", "miss")}
    assert sorted(pending(every, store.read()).collect()) == sorted(pending(every, store.fingerprints()).collect())


def test_a_guarded_write_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=1)
    store.upsert(frame(spark, change("/d/a.jpg")), 1, guard=lambda: True)
    with pytest.raises(Superseded):
        store.upsert(frame(spark, change("/d/b.jpg")), 2, guard=lambda: False)
    assert set(stored(store)) == {("image", "/d/a.jpg")} and store._latest()[0] == 1
    assert os.path.isdir(tmp_path / "s") and store.fingerprints().where(F.col("has_clip")).count() == 0

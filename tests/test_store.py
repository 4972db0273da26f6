import os

import pytest
from pyspark.sql import functions as F

from vesper.operators import freshness, merge, prune, summary
from vesper.operators.encode import HashEncoder, encode, runnable
from vesper.plans.ranges import running_sum
from vesper.schemas import LISTING, STORE
from vesper.sources.listing import listing
from vesper.sources.store import Store, location
from vesper.streaming.reindex import pending, reindex


def change(path, size=10, mtime=1, thumb=None, clip=None, audio=None, ns="image", version=1):
    return (ns, path, path.rsplit("/", 1)[0], size, mtime, None, 0, version, thumb, clip, audio)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), STORE)


def stored(store):
    return {(r["namespace"], r["path"]): r for r in store.read().collect()}


def test_upsert_coalesces_only_fresh_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.read().count() == 0
    store.upsert(frame(spark, change("/d/v.mp4", clip=[0.5], ns="video"), change("/d/a.jpg", clip=[1.0])), 100)
    store.upsert(frame(spark, change("/d/v.mp4", audio=[0.25], ns="video"), change("/d/a.jpg", size=11, thumb="t")), 200)
    rows = stored(store)
    assert rows[("video", "/d/v.mp4")]["clip_vector"] == [0.5] and rows[("video", "/d/v.mp4")]["audio_vector"] == [0.25]
    assert rows[("image", "/d/a.jpg")]["clip_vector"] is None and rows[("image", "/d/a.jpg")]["thumbnail_path"] == "t"


def test_upsert_that_changes_nothing_keeps_the_time(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert(frame(spark, change("/d/a.jpg", clip=[1.0], thumb="t")), 100)
    store.upsert(frame(spark, change("/d/a.jpg"), change("/d/b.jpg")), 200)
    rows = stored(store)
    assert rows[("image", "/d/a.jpg")]["updated_at"] == 100 and rows[("image", "/d/b.jpg")]["updated_at"] == 200


def test_bad_changes_are_reported_and_others_written(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    bad = store.upsert(frame(spark, change("/d/a.jpg"), change("/d/gone.jpg", size=None)), 1).collect()
    assert [b["path"] for b in bad] == ["/d/gone.jpg"] and list(stored(store)) == [("image", "/d/a.jpg")]


def names_in(folder):
    return {f.name for f in folder.iterdir() if not f.name.startswith(".")}


def test_a_write_leaves_other_buckets_alone(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    store.upsert(frame(spark, *[change(f"/d/{i}.jpg") for i in range(40)]), 1)
    before = store._latest()[1]["data"]
    store.upsert(frame(spark, change("/d/3.jpg", size=11)), 2)
    after = store._latest()[1]["data"]
    assert len(before) == 8 and set(after) == set(before) and sum(after[b] != before[b] for b in before) == 1
    rows = stored(store)
    assert len(rows) == 40 and rows[("image", "/d/3.jpg")]["updated_at"] == 2 and rows[("image", "/d/4.jpg")]["updated_at"] == 1
    assert store.delete_in_dir("/none") == 0 and store._latest()[0] == 2


def test_a_crash_before_the_manifest_leaves_the_store(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert(frame(spark, change("/d/a.jpg")), 1)

    def crash(number, manifest):
        raise OSError("gone")

    monkeypatch.setattr(store, "_commit", crash)
    with pytest.raises(OSError):
        store.upsert(frame(spark, change("/d/a.jpg", size=11), change("/d/b.jpg")), 2)
    other = Store(spark, str(tmp_path / "s"))
    assert {k: r["file_size"] for k, r in stored(other).items()} == {("image", "/d/a.jpg"): 10}
    other.upsert(frame(spark, change("/d/b.jpg")), 3)
    assert set(stored(other)) == {("image", "/d/a.jpg"), ("image", "/d/b.jpg")}


def test_of_two_writers_neither_is_lost(spark, tmp_path):
    first, second = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    commit = first._commit

    def late(number, manifest):
        first._commit = commit
        second.upsert(frame(spark, change("/d/a.jpg", size=20)), 2)
        return commit(number, manifest)

    first._commit = late
    first.upsert(frame(spark, change("/d/b.jpg")), 1)
    assert set(stored(first)) == {("image", "/d/a.jpg"), ("image", "/d/b.jpg")} and first._latest()[0] == 2


def test_readers_of_earlier_versions_finish_and_old_files_go(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=1, keep=2)
    store.upsert(frame(spark, change("/d/a.jpg")), 1)
    reader = store.read()
    store.upsert(frame(spark, change("/d/b.jpg")), 2)
    assert reader.count() == 1
    for i in range(3):
        store.upsert(frame(spark, change(f"/d/{i}.jpg")), 3 + i)
    assert len(stored(store)) == 5 and names_in(tmp_path / "s" / "versions") == {f"{n:012d}" for n in (4, 5)}
    assert len([n for n in names_in(tmp_path / "s") if n.startswith("data-")]) == 2


def test_running_sum(spark):
    values = [("a", 1, 5), ("a", 1, 5), (None, 2, 1), ("b", None, 2), *[("hot", i % 50, i) for i in range(200)]]
    rows = spark.createDataFrame(values, "d string, p int, v long")
    order = sorted(range(len(values)), key=lambda i: [(x is not None, x) for x in values[i][:2]])
    prior, total = {}, 0
    for i in order:
        prior.setdefault(values[i][:2], total)
        total += values[i][2]
    for ranges in (1, 2, 16, 256):
        found = running_sum(rows, ["d", "p"], "v", ranges=ranges).collect()
        assert len(found) == len(values)
        for key in prior:
            assert min(r["_prior"] for r in found if (r["d"], r["p"]) == key) == prior[key]
        assert sorted(r["n"] for r in running_sum(rows, ["d", "p"], into="n", ranges=ranges).collect()) == list(range(len(values)))
    assert running_sum(rows.limit(0), ["d", "p"]).count() == 0


def test_lookup_statuses(spark):
    store = frame(spark, change("/d/a.jpg", clip=[1.0]), change("/d/b.jpg"), change("/d/h.jpg"), change("/d/v.mp4", ns="video")).withColumn("content_hash", F.lit("same"))
    rows = [("/d/a.jpg", "/d", 10, 1, 0, None), ("/d/b.jpg", "/d", 12, 1, 1, "other"), ("/d/h.jpg", "/d", 10, 9, 2, "same"), ("/d/v.mp4", "/d", 10, 1, 3, None)]
    listed = spark.createDataFrame(rows, "path string, dir string, file_size long, mtime long, ordinal long, content_hash string")
    assert [r["status"] for r in freshness.lookup(listed, store, "image").orderBy("ordinal").collect()] == ["hit", "invalidated", "hit", "miss"]
    assert {r["path"] for r in freshness.to_hash(listed, store, "image").collect()} == {"/d/b.jpg", "/d/h.jpg"}


def test_delete_purge_and_drop(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.upsert(frame(spark, change("/p/p.bin"), change("/p/sub/c.bin"), change("/pq/x.bin", ns="video"), change("/p/old.bin", version=0)), 1)
    assert store.delete_in_dir("/p") == 1
    assert set(stored(store)) == {("image", "/p/sub/c.bin"), ("video", "/pq/x.bin")}
    store.delete(frame(spark, change("/pq/x.bin", ns="video")))
    assert set(stored(store)) == {("image", "/p/sub/c.bin")}
    assert store.files().where("length > 0").count() > 0
    store.drop()
    assert store.read().count() == 0


def test_register_enters_all_files_as_images(spark):
    listed = spark.createDataFrame([("/d/a.jpg", "/d", 1, 1, 0), ("/d/v.mp4", "/d", 1, 1, 1)], LISTING)
    out = merge.upsert(spark.createDataFrame([], STORE), merge.register(listed, 1), 5).collect()
    assert {(r["namespace"], r["path"], r["updated_at"]) for r in out} == {("image", "/d/a.jpg", 5), ("image", "/d/v.mp4", 5)}


def test_locations(monkeypatch):
    monkeypatch.setenv("XDG_CACHE_HOME", "/x")
    assert location() == "/x/vesper/store" and location("custom", base="/y") == "/y" and location("work", "n") == os.path.join(os.getcwd(), "n")


@pytest.mark.parametrize(("budget", "gone"), [(300, ["a", "b"]), (330, ["a", "b"]), (0, ["a", "b", "d"]), (400, [])])
def test_prune_oldest_first_until_it_fits(spark, budget, gone):
    entries = spark.createDataFrame([("image", "a", 1, 40), ("image", "b", 2, 60), ("image", "c", 3, 0), ("video", "d", 4, 300)], "namespace string, path string, updated_at long, thumb_bytes long")
    for bins in (1, 2, 4096):
        assert sorted(r["path"] for r in prune.victims(entries, 400 - budget, bins=bins).collect()) == gone


def test_prune_removes_orphans_first(spark):
    entries = spark.createDataFrame([("image", "old", 1, "t/old", 50), ("image", "new", 2, "t/new", 70)], "namespace string, path string, updated_at long, thumbnail_path string, thumb_bytes long")
    files = spark.createDataFrame([("t/old", 50), ("t/new", 70), ("t/loose", 30)], "path string, length long")
    loose, out, report = prune.prune(entries, files, 100, 250 - 30 - 50)
    assert [r["path"] for r in loose.collect()] == ["t/loose"] and [r["path"] for r in out.collect()] == ["old"]
    r = report.first()
    assert r["target_reached"] and r["removed_orphan_bytes"] == 30 and r["bytes_after"] == 170
    loose, out, report = prune.prune(entries, files, 100, 250)
    assert loose.count() == 0 and out.count() == 0 and report.first()["target_reached"]
    assert not prune.prune(entries, files, 100, 10)[2].first()["target_reached"]


def test_footprint_and_summary(spark):
    files = spark.createDataFrame([("sidecar", 7), ("sidecar", 11), ("thumbnail", 3), ("thumbnail", 5)], "kind string, length long")
    assert tuple(prune.footprint(files).first()) == (0, 18, 8, 26)
    rows = frame(spark, change("/A/1", 4), change("/A/2", 6), change("/A/3", 2), change("/B/1", 8))
    assert {(r["dir"], r["file_count"], r["total_size"]) for r in summary.dir_summary(rows).collect()} == {("/A", 3, 12), ("/B", 1, 8)}
    assert tuple(summary.totals(summary.dir_summary(rows.limit(0))).first()) == (0, 0, 0)


def test_listing_depth_and_types(spark, tmp_path):
    for name in ("a.jpg", "b.txt", "sub/c.png", "sub/deep/d.webp", "v.mp4", "E.JPG"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * 3)
    names = lambda **k: [os.path.basename(r["path"]) for r in listing(spark, str(tmp_path), **k).orderBy("ordinal").collect()]
    assert names(depth=0) == ["a.jpg"] and names(depth=1) == ["a.jpg", "c.png"] and names() == ["a.jpg", "c.png", "d.webp"]
    assert names(images=False, videos=True) == ["v.mp4"]
    assert listing(spark, str(tmp_path / "missing")).count() == 0


def test_encode_outcomes(spark):
    class Picky(HashEncoder):
        def encode(self, contents):
            if b"boom" in contents:
                raise ValueError("bad frame")
            return super().encode(contents)

    rows = spark.createDataFrame([("a", b"1"), ("b", b"boom"), ("c", b""), ("d", b"1")], "path string, content binary").coalesce(1)
    out = {r["path"]: r for r in encode(rows, Picky).collect()}
    assert out["a"]["vector"] == out["d"]["vector"] and out["b"]["message"] == "bad frame" and out["c"]["outcome"] == "skipped"
    assert runnable(("image", "audio"), ("image",), 3) == (("image",), False) and runnable(("audio",), (), 1) == ((), True) and runnable(("audio",), (), 0) == ((), False)


def test_stream_reindexes_only_what_changed(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    seen = []

    def changes(todo):
        seen.append(sorted(r["path"] for r in todo.collect()))
        null = lambda k: F.lit(None).cast(k)
        return todo.select("namespace", "path", "dir", "file_size", "mtime", null("string").alias("content_hash"), null("long").alias("updated_at"), F.lit(1).alias("payload_version"), null("string").alias("thumbnail_path"), F.array(F.lit(1.0).cast("float")).alias("clip_vector"), null("array<float>").alias("audio_vector"))

    def arrive(*rows):
        spark.createDataFrame(list(rows), LISTING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = reindex(spark, str(tmp_path / "in"), store, changes, lambda: 7, str(tmp_path / "cp"))
        query.awaitTermination(120)

    arrive(("/d/a.jpg", "/d", 1, 1, 0), ("/d/b.jpg", "/d", 1, 1, 1))
    arrive(("/d/a.jpg", "/d", 1, 1, 0), ("/d/b.jpg", "/d", 2, 2, 1), ("/d/c.mp4", "/d", 1, 1, 2))
    assert seen == [["/d/a.jpg", "/d/b.jpg"], ["/d/b.jpg", "/d/c.mp4"]]
    assert pending(spark.createDataFrame([("/d/a.jpg", "/d", 1, 1, 0)], LISTING), store.read()).count() == 0

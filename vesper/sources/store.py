"""The keyed feature store: Parquet files in buckets by a hash of the path, and numbered manifests that name a version's files."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Similarity
from ..operators import freshness, merge, prune, similarity
from ..plans import cells
from ..plans.cells import cells as deal
from ..plans.tables import written
from ..schemas import NAMESPACES, STORE, VECTOR
from .remove import remove

MANIFESTS, LEASES = "versions", "leases"
ATTEMPTS = 5
#: Folders of data up to which a lookup joins each as it is partitioned; beyond, the store's side is shuffled.
FOLDERS = 16
#: Seconds after which files that no version names are taken to be a crashed writer's.
GRACE = 24 * 3600
FINGERPRINT = ("namespace", "path", "file_size", "mtime", "content_hash", "has_clip", "has_audio")
#: What files hold: the store's columns, and whether there are vectors, so that this is known without reading them.
HELD = T.StructType([*STORE.fields, T.StructField("has_clip", T.BooleanType()), T.StructField("has_audio", T.BooleanType())])


class Superseded(RuntimeError):
    """A write that was refused as a later request has taken its place."""


def location(kind: str = "cache", name: str = "store", base: str | None = None, app: str = "vesper") -> str:
    """Where a store lies: custom (base itself), cache (the user's cache folder) or work (the working folder)."""
    if kind == "custom":
        return base or name
    if kind == "work":
        return os.path.join(os.getcwd(), name)
    return os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.join(os.path.expanduser("~"), ".cache"), app, name)


def bucket_of(n: int) -> Column:
    """As Spark's bucketed tables have it."""
    return F.pmod(F.hash("path"), F.lit(n)).cast("int")


@dataclass(frozen=True)
class Lease:
    """A version that stays readable until release() or, if that never comes, until it expires."""

    store: Store
    name: str
    number: int
    manifest: dict

    def read(self) -> DataFrame:
        return self.store._rows(self.manifest)

    def release(self) -> None:
        self.store._fs.delete(self.store._at(LEASES, self.name), False)

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


class Store:
    """Readers see the files that the manifest of the largest number names.

    Rows lie in buckets by Spark's hash of the path, as bucketed tables have it. A write merges only the buckets that its keys fall in, into files
    of its own, and then claims the next number with a marker file, which only one writer can make, and renames its manifest to it. A crash before
    that leaves the store as it was. A writer that finds the number taken merges anew with what is there; a number that was claimed but got no manifest for
    `patience` seconds is passed over by the next writer. The last `keep` versions stay readable, and so does any that a lease pins; others are deleted by
    the next write, with the folders that only they name. Files of crashed writers and buckets that were rewritten since go by vacuum(), which holds
    all files against those that a version names.
    """

    def __init__(self, spark: SparkSession, root: str, version: int = 1, buckets: int = 64, keep: int = 3, patience: float = 60.0):
        self.spark, self.root, self.version, self.buckets, self.keep, self.patience = spark, root.rstrip("/"), version, buckets, keep, patience
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self._path("/".join([self.root, *names]))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _numbers(self) -> list[int]:
        return [int(n) for n in self._names(MANIFESTS) if n.isdigit()]

    def _load(self, *names: str) -> dict:
        source = self._fs.open(self._at(*names))
        try:
            return json.loads(source.readLine())
        finally:
            source.close()

    def _save(self, content: dict, *names: str) -> None:
        out = self._fs.create(self._at(*names), False)
        out.writeBytes(json.dumps(content))
        out.close()

    def _manifest(self, number: int) -> dict:
        return self._load(MANIFESTS, f"{number:012d}")

    def _latest(self) -> tuple[int, dict]:
        """Number and manifest: how many buckets, the folder that holds each (those with rows), and the folders made for it."""
        numbers = self._numbers()
        return (numbers[-1], self._manifest(numbers[-1])) if numbers else (0, {"buckets": self.buckets, "data": {}, "made": []})

    def _files(self, manifest: dict, buckets: set[str] | None = None) -> list[str]:
        """Patterns of the files of buckets: a file's name has its bucket's number."""
        return sorted(f"{self.root}/{name}/*_{int(b):05d}.c*" for b, name in manifest["data"].items() if buckets is None or b in buckets)

    def _held(self, manifest: dict, buckets: set[str] | None = None) -> DataFrame:
        files = self._files(manifest, buckets)
        rows = self.spark.read.schema(HELD).parquet(*files) if files else self.spark.createDataFrame([], HELD)
        return merge.purge(rows, self.version)

    def _rows(self, manifest: dict, buckets: set[str] | None = None) -> DataFrame:
        return self._held(manifest, buckets).select(*STORE.fieldNames())

    def _write(self, rows: DataFrame, n: int, kind: str) -> tuple[str, set[str]]:
        """Writes rows to a folder of their own, a file for each bucket: its name and the buckets that it holds."""
        name, table = f"{kind}-{uuid.uuid4().hex}", f"vesper_{uuid.uuid4().hex}"
        held = rows.select(*STORE.fieldNames(), F.col("clip_vector").isNotNull().alias("has_clip"), F.col("audio_vector").isNotNull().alias("has_audio"))
        dealt = held.repartition(n, "path").sortWithinPartitions("path", "namespace")
        dealt.write.bucketBy(n, "path").sortBy("path").format("parquet").option("path", f"{self.root}/{name}").saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay
        found = (re.search(r"_(\d{5})\.c\d+", f) for f in self._names(name))
        return name, {str(int(m[1])) for m in found if m}

    def _table(self, name: str, n: int) -> DataFrame:
        """A folder as a bucketed table, so that joins on the path know how it is partitioned."""
        table = "vesper_" + hashlib.sha256(f"{self.root}/{name}".encode()).hexdigest()[:24]
        where = self._fs.makeQualified(self._at(name)).toString().replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({', '.join(f'{f.name} {f.dataType.simpleString()}' for f in HELD)}) USING parquet CLUSTERED BY (path) SORTED BY (path) INTO {n} BUCKETS LOCATION '{where}'")
        return self.spark.table(table)

    def _claim(self, number: int) -> bool:
        """Makes the marker file of a number, which only one writer can; False if another has it."""
        marker = self._at(MANIFESTS, f".claim-{number:012d}")
        try:
            out = self._fs.create(marker, False)
        except Py4JJavaError:
            if not self._fs.exists(marker):
                raise
            return False
        out.close()
        return True

    def _commit(self, number: int, manifest: dict) -> bool:
        """Whether the manifest became that number; False if another writer was first."""
        if self._fs.exists(self._at(MANIFESTS, f"{number:012d}")) or not self._claim(number):
            return False
        fresh = f".{uuid.uuid4().hex}"
        self._save(manifest, MANIFESTS, fresh)
        if not self._fs.rename(self._at(MANIFESTS, fresh), self._at(MANIFESTS, f"{number:012d}")):
            raise OSError(f"version {number} can't be named")
        self._retire()
        return True

    def _next(self, number: int) -> int:
        """The number after this one that nobody has claimed; waits for those who have, but not for ever."""
        number += 1
        until = time.monotonic() + self.patience
        while self._fs.exists(self._at(MANIFESTS, f".claim-{number:012d}")) and not self._fs.exists(self._at(MANIFESTS, f"{number:012d}")):
            if time.monotonic() > until:
                number += 1
                continue
            time.sleep(0.05)
        return number

    def _leased(self) -> set[int]:
        """Numbers that leases pin; those that have expired go."""
        pinned = set()
        for name in self._names(LEASES):
            try:
                lease = self._load(LEASES, name)
            except Py4JJavaError:  # released in the meantime
                continue
            if lease["until"] > time.time():
                pinned.add(lease["number"])
            else:
                self._fs.delete(self._at(LEASES, name), False)
        return pinned

    def _retire(self) -> None:
        """Deletes the manifests that neither `keep` nor a lease holds, and the folders that only these name."""
        numbers = self._numbers()
        live = {*numbers[-self.keep :], *self._leased()} & set(numbers)
        named = {n: {*m["data"].values(), *m["made"], *([m["index"]] if "index" in m else [])} for n, m in ((n, self._manifest(n)) for n in numbers)}
        held = set().union(*(named[n] for n in live))
        for n in sorted(set(numbers) - live):
            for name in named[n] - held:
                self._fs.delete(self._at(name), True)
            self._fs.delete(self._at(MANIFESTS, f"{n:012d}"), False)
            self._fs.delete(self._at(MANIFESTS, f".claim-{n:012d}"), False)

    def lease(self, seconds: float = 3600.0) -> Lease:
        """Pins the current version: its files stay until the lease is released or expires. Its own read() gives that version."""
        name = uuid.uuid4().hex
        while True:
            number, manifest = self._latest()
            self._save({"number": number, "until": time.time() + seconds}, LEASES, name)
            # a writer that retired the version before it saw the lease leaves a later one
            if not number or self._fs.exists(self._at(MANIFESTS, f"{number:012d}")):
                return Lease(self, name, number, manifest)
            self._fs.delete(self._at(LEASES, name), False)

    def vacuum(self, grace: float = GRACE) -> DataFrame:
        """Deletes the files that no version names and that are older than `grace` seconds: path, bytes, message of each.

        What a writer at work has made isn't named yet, hence the grace. Files are found by Spark's file source and held against the versions'
        buckets by an anti join; executors delete them. Versions that leases pin count as named.
        """
        self._retire()
        live = {(name, int(b)) for n in self._numbers() for b, name in self._manifest(n)["data"].items()}
        named = self.spark.createDataFrame(sorted(live), "folder string, bucket int")  # a row for each bucket of each version
        kinds = [n for n in self._names("") if n.startswith(("data-", "changes-"))] if self._fs.exists(self._at("")) else []
        found = self._listed([f"{self.root}/{k}" for k in kinds]).where(F.col("mtime") <= F.lit(time.time() - grace))
        loose = found.join(F.broadcast(named), ["folder", "bucket"], "left_anti")  # at most versions x buckets rows
        out = written(remove(loose.select("path", "length")))
        for k in kinds:
            left = [n for n in self._names(k) if n.endswith(".parquet")]
            if not left:
                self._fs.delete(self._at(k), True)
        return out

    def _listed(self, folders: list[str]) -> DataFrame:
        """path, folder, bucket, length, mtime of the files of data folders."""
        if not folders:
            return self.spark.createDataFrame([], "path string, folder string, bucket int, length long, mtime double")
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folders)
        return files.select("path", F.regexp_extract("path", "([^/]+)/[^/]*$", 1).alias("folder"), F.expr("try_cast(regexp_extract(path, '_([0-9]{5})[.]c[0-9]+', 1) AS int)").alias("bucket"), "length", (F.unix_micros("modificationTime") / 1e6).alias("mtime"))

    def _change(self, touched: Callable[[dict], set[str]], merged: Callable[[DataFrame], DataFrame], made: tuple[str, ...] = (), guard: Callable[[], bool] | None = None) -> None:
        """Puts merged(rows) in place of the rows of the buckets that touched(manifest) gives; refused if guard() is False when all is written."""
        for _ in range(ATTEMPTS):
            number, old = self._latest()
            hit = touched(old)
            if not hit:
                return
            name, left = self._write(merged(self._rows(old, hit)), old["buckets"], "data")
            if guard and not guard():
                self._fs.delete(self._at(name), True)
                raise Superseded("a later request has taken this one's place")
            data = {b: d for b, d in old["data"].items() if b not in hit} | dict.fromkeys(left, name)
            if self._latest()[0] == number and self._commit(self._next(number), {**old, "data": data, "made": [name, *made]}):
                return
            self._fs.delete(self._at(name), True)
        raise RuntimeError(f"the store was changed by others during each of {ATTEMPTS} attempts")

    def read(self) -> DataFrame:
        """All rows of the current payload version; a store that was never written is empty."""
        return self._rows(self._latest()[1])

    def fingerprints(self, of: DataFrame | None = None) -> DataFrame:
        """FINGERPRINT columns: all that freshness needs, without thumbnails and vectors. `of` (path): only the buckets that these fall in are read."""
        manifest = self._latest()[1]
        buckets = None if of is None else {str(r[0]) for r in of.select(bucket_of(manifest["buckets"])).distinct().collect()}
        return self._held(manifest, buckets).select(*FINGERPRINT)

    def paths(self) -> DataFrame:
        return self.read().select("namespace", "path")

    def replace(self, rows: DataFrame) -> None:
        self._change(lambda old: {str(b) for b in range(old["buckets"])}, lambda _: rows)

    def compact(self) -> None:
        """Rewrites all buckets into one folder, which makes lookups one join."""
        self._change(lambda old: {str(b) for b in range(old["buckets"])} if old["data"] else set(), lambda rows: rows)

    def upsert(self, changes: DataFrame, now: int, guard: Callable[[], bool] | None = None) -> DataFrame:
        """Merges changes; returns (path, message) of those that couldn't be. With a guard that is False in the end, nothing is changed: Superseded.

        Changes are written once beside the store, so that what makes them (an encoder, say) doesn't run again for the merge.
        """
        n = self._latest()[1]["buckets"]
        staged, hit = self._write(changes, n, "changes")
        good, bad = merge.split_changes(self.spark.read.schema(STORE).parquet(f"{self.root}/{staged}"))

        def touched(old: dict) -> set[str]:
            if old["buckets"] != n:
                raise RuntimeError("the store was made anew with other buckets")
            return hit

        self._change(touched, lambda rows: merge.upsert(rows, good, now), (staged,), guard)
        return bad

    def delete_in_dir(self, directory: str, recursive: bool = False) -> int:
        removed = 0

        def touched(old: dict) -> set[str]:
            nonlocal removed
            gone = self._rows(old).where(merge.held_in_dir(directory, recursive)).groupBy(bucket_of(old["buckets"]).alias("bucket")).count().collect()  # a row a bucket
            removed = sum(g["count"] for g in gone)
            return {str(g["bucket"]) for g in gone}

        self._change(touched, lambda rows: merge.delete_in_dir(rows, directory, recursive))
        return removed

    def delete(self, keys: DataFrame) -> None:
        def touched(old: dict) -> set[str]:
            return {str(r["bucket"]) for r in keys.select(bucket_of(old["buckets"]).alias("bucket")).distinct().collect()} & set(old["data"])

        self._change(touched, lambda rows: merge.delete(rows, keys))

    def lookup(self, listing: DataFrame, namespace: str) -> DataFrame:
        """freshness.lookup() in the store. Only the listing is shuffled: each folder of data is a bucketed table, and meets the files listed for
        the buckets that it holds. A store in more than FOLDERS folders is read as a whole and shuffled; compact() mends that."""
        manifest = self._latest()[1]
        n, folders = manifest["buckets"], {}
        for b, name in manifest["data"].items():
            folders.setdefault(name, []).append(int(b))
        if not folders or len(folders) > FOLDERS:
            return freshness.lookup(listing, self._rows(manifest), namespace)
        dealt, out = listing.repartition(n, "path"), []
        for name, held in sorted(folders.items()):
            here = bucket_of(n).isin(*held)
            rows = merge.purge(self._table(name, n), self.version).where(here)
            out.append(freshness.lookup(dealt.where(here) if len(held) < n else dealt, rows, namespace))
        rest = sorted(set(range(n)) - {b for held in folders.values() for b in held})
        if rest:
            out.append(freshness.lookup(listing.where(bucket_of(n).isin(*rest)), self.spark.createDataFrame([], STORE), namespace))
        if listing.where("path IS NULL").limit(1).count():
            out.append(freshness.lookup(listing.where("path IS NULL"), self.spark.createDataFrame([], STORE), namespace))
        every = out[0]
        for part in out[1:]:
            every = every.unionByName(part)
        return every

    def index(self, n: int = 256) -> int:
        """Lays the vectors of the current version out by cells round pivots, and names the index in a new version; returns how many cells hold rows.

        Each namespace and cell is a folder of files; beside them stands a zone map: each cell's centre, and the largest angle to it and norm that its vectors have. Later
        writes keep the index: what they rewrote is read from the buckets instead, until the next index().
        """
        for _ in range(ATTEMPTS):
            number, old = self._latest()
            name, zones = f"index-{uuid.uuid4().hex}", {}
            rows = self._rows(old).where("clip_vector IS NOT NULL OR audio_vector IS NOT NULL")
            rows = rows.select(F.xxhash64("namespace", "path").alias("ordinal"), "namespace", "path", "dir", F.col("clip_vector").alias("clip"), F.col("audio_vector").alias("audio"), bucket_of(old["buckets"]).alias("_bucket"))
            for namespace in NAMESPACES:
                dealt = deal(rows.where(F.col("namespace") == namespace), ["clip", "audio"], n)
                dealt.rows.drop("ordinal", "namespace").repartition("_cell").write.partitionBy("_cell").parquet(f"{self.root}/{name}/{namespace}")
                held = np.flatnonzero(dealt.size).tolist()
                zones[namespace] = {"cells": held, "angle": dealt.angle.tolist(), "norm": dealt.norm.tolist(), "pivots": [p.astype(np.float32).tolist() for p in dealt.pivots]}
            self._save({"of": old["data"], "zones": zones}, name, "_zones.json")
            if self._latest()[0] == number and self._commit(self._next(number), {**old, "index": name, "made": []}):
                return sum(len(z["cells"]) for z in zones.values())
            self._fs.delete(self._at(name), True)
        raise RuntimeError(f"the store was changed by others during each of {ATTEMPTS} attempts")

    def near(self, target_path: str, threshold: float, namespace: str = "image", cfg: Similarity = Similarity()) -> DataFrame:
        """namespace, path, dir, clip, audio of all that can score `threshold` or more against a stored item, itself included; without an index, of all.

        The target is read from its bucket. Of the index, only cells are opened whose bound reaches the threshold; rows that were written since
        come from their buckets.
        """
        manifest = self._latest()[1]
        shape = ("namespace", "path", "dir", F.col("clip_vector").alias("clip"), F.col("audio_vector").alias("audio"))
        own = self.spark.createDataFrame([(target_path,)], "path string").select(bucket_of(manifest["buckets"])).first()[0]
        target = self._rows(manifest, {str(own)}).where((F.col("namespace") == namespace) & (F.col("path") == target_path)).select(*shape)
        if "index" not in manifest:
            return self._rows(manifest).where(F.col("namespace") == namespace).select(*shape)
        found, vector = self._load(manifest["index"], "_zones.json"), target.first()
        if vector is None:
            return target
        zone = found["zones"][namespace]
        bounds = [cells.reach(vector[c], np.array(p, np.float64).reshape(len(a) - 1, -1), np.array(a[:-1]), np.array(n[:-1])) for c, p, a, n in zip(("clip", "audio"), zone["pivots"], zone["angle"], zone["norm"], strict=True)]
        most = bounds[0] if namespace == "image" else np.maximum(np.maximum(*bounds), cfg.image_weight * bounds[0] + cfg.audio_weight * bounds[1])
        open_ = [c for c in zone["cells"] if c >= len(most) or not most[c] < threshold]
        stale = {b for b in {*manifest["data"], *found["of"]} if manifest["data"].get(b) != found["of"].get(b)}
        folders = [f"{self.root}/{manifest['index']}/{namespace}/_cell={c}" for c in open_]
        out = target
        if folders:
            schema = T.StructType([f for f in STORE.fields if f.name in ("path", "dir")] + [T.StructField("clip", VECTOR), T.StructField("audio", VECTOR), T.StructField("_bucket", T.IntegerType())])
            kept = self.spark.read.schema(schema).parquet(*folders).where((F.col("path") != target_path) & ~F.col("_bucket").isin(*[int(b) for b in stale]))
            out = out.unionByName(kept.select(F.lit(namespace).alias("namespace"), "path", "dir", "clip", "audio"))
        if stale & set(manifest["data"]):
            out = out.unionByName(self._rows(manifest, stale).where((F.col("namespace") == namespace) & (F.col("path") != target_path)).select(*shape))
        return out

    def focus(self, target_path: str, threshold: float, scope: str = "everywhere", namespace: str = "image", cfg: Similarity = Similarity()) -> DataFrame:
        """similarity.focus() in the store, by near()."""
        return similarity.focus(self.near(target_path, threshold, namespace, cfg), target_path, threshold, scope, namespace, cfg)

    def prune(self, thumbnails: str, max_bytes: int, remover: Callable[[DataFrame], DataFrame] = remove) -> prune.Pruned:
        """prune.enforce() on this store and a folder of thumbnail files; sizes are those of the current version's files and of the folder's."""

        def files() -> DataFrame:
            at = self._path(thumbnails)
            if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
                return self.spark.createDataFrame([], "path string, length long")
            found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(thumbnails)
            return found.select(F.regexp_replace("path", "^file:(//)?(?=/)", "").alias("path"), "length")

        def measure() -> int:
            sizes = self.files().unionByName(files().select(F.lit("thumbnail").alias("kind"), "length"))
            return prune.footprint(sizes).first()["total_bytes"]

        return prune.enforce(self.read(), files(), remover, max_bytes, measure, self.delete)

    def drop(self) -> None:
        self._fs.delete(self._path(self.root), True)

    def files(self) -> DataFrame:
        """kind and length of the files of the current version, for footprint()."""
        files = self._files(self._latest()[1])
        if not files:
            return self.spark.createDataFrame([], "kind string, length long")
        return self.spark.read.format("binaryFile").load(files).select(F.lit("database").alias("kind"), "length")

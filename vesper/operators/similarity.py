"""Pair and nearest-neighbour queries over feature vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Similarity
from ..functions import paths
from ..functions.vectors import dot, weighted_score
from ..plans.blocks import BLOCK, Prune, similar_pairs
from ..plans.matrices import matrix, products, strips
from ..plans.sums import vector_sums


def image_pairs(rows: DataFrame, threshold: float, top: int | None = Similarity.max_image_pairs, vector: str = "clip", block: int = BLOCK, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """Best pairs of images with a cosine of `threshold` or more (inclusive): left_path, right_path, similarity.

    rows: ordinal, path, vector (of unit length). Left is the row of smaller ordinal; ties go by left and right path. Null and
    empty vectors, vectors of different length, and scores that aren't finite make no pair. top 0: no rows.
    """
    usable = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).select("ordinal", "path", F.col(vector).alias("v"))

    def score(t: pa.Table) -> Callable[[slice, slice], np.ndarray]:
        v, length = matrix(t["v"])

        def scores(a: slice, b: slice) -> np.ndarray:
            s = products(v, length, a, b)
            s[(length[a, None] != length[None, b]) | ~np.isfinite(s)] = np.nan
            return s

        return scores

    return similar_pairs(usable, score, threshold, top, block, Prune(("v",), lambda b: b[0], report))


def video_pairs(rows: DataFrame, threshold: float, cfg: Similarity = Similarity(), clip: str = "clip", audio: str = "audio", block: int = BLOCK, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """All pairs of videos with a weighted score of `threshold` or more: left_path, right_path, similarity.

    A modality counts if its vector has a component that isn't zero. Both modalities on both sides are weighted; else the one
    that both sides have counts alone, image first; else there is no pair. Vectors of different length are compared over the shorter. NaN makes no pair.
    """
    usable = rows.where(F.col(clip).isNotNull() | F.col(audio).isNotNull()).select("ordinal", "path", F.col(clip).alias("clip"), F.col(audio).alias("audio"))

    def score(t: pa.Table) -> Callable[[slice, slice], np.ndarray]:
        parts = [(v, length, (v != 0).any(axis=1)) for v, length in (matrix(t[c]) for c in ("clip", "audio"))]

        def scores(a: slice, b: slice) -> np.ndarray:
            (image, has_image), (sound, has_sound) = ((products(v, length, a, b), signal[a, None] & signal[None, b]) for v, length, signal in parts)
            return np.where(has_image & has_sound, cfg.image_weight * image + cfg.audio_weight * sound, np.where(has_image, image, np.where(has_sound, sound, np.nan)))

        return scores

    def bound(b: list[np.ndarray]) -> np.ndarray:
        return np.maximum(np.maximum(b[0], b[1]), cfg.image_weight * b[0] + cfg.audio_weight * b[1])

    return similar_pairs(usable, score, threshold, None, block, Prune(("clip", "audio"), bound, report))


def all_pairs(images: DataFrame, videos: DataFrame) -> DataFrame:
    """Image pairs, then video pairs: order by kind_rank, similarity descending, paths."""
    kinds = ((images, "image", 0), (videos, "video", 1))
    first, second = (p.select(F.lit(kind).alias("kind"), F.lit(rank).alias("kind_rank"), "left_path", "right_path", "similarity") for p, kind, rank in kinds)
    return first.unionByName(second)


def focus(store: DataFrame, target_path: str, threshold: float, scope: str = "everywhere", namespace: str = "image", cfg: Similarity = Similarity()) -> DataFrame:
    """path, similarity of what is like one stored item: its own namespace, the target left out, best first.

    scope: everywhere, dir (the target's directory) or subtree (that and below). Scores: the plain dot product over
    the shorter vector for images, the weighted one for videos; `threshold` is inclusive, NaN fails. The target is one
    row by its key, joined on the namespace; the candidates are scanned once. Stored rows count whether or not they
    are fresh. A missing target or one without vectors: no rows.
    """
    own = store.where((F.col("namespace") == namespace) & (F.col("path") == target_path)).select("namespace", F.col("clip").alias("_clip"), F.col("audio").alias("_audio")).limit(1)
    where = target_path.rsplit("/", 1)[0]
    candidates = store.where((F.col("namespace") == namespace) & (F.col("path") != target_path))
    if scope != "everywhere":
        candidates = candidates.where(paths.in_dir("dir", where, scope == "subtree"))
    met = candidates.join(F.broadcast(own), "namespace")  # one row
    s = dot("clip", "_clip") if namespace == "image" else weighted_score((F.col("clip"), F.col("audio")), (F.col("_clip"), F.col("_audio")), cfg.image_weight, cfg.audio_weight)
    scored = met.withColumn("similarity", s).where(F.col("similarity").isNotNull() & ~F.isnan("similarity") & (F.col("similarity") >= threshold))
    return scored.select("path", "similarity").orderBy(F.desc("similarity"), "path")


def focus_status(store: DataFrame, target_path: str, result: DataFrame, namespace: str = "image", had_errors: bool = False) -> DataFrame:
    """One row that says why a result may be empty: n_items, nothing_indexed (no usable target), had_errors."""
    target = (F.col("namespace") == namespace) & (F.col("path") == target_path) & (F.col("clip").isNotNull() | (F.col("audio").isNotNull() if namespace == "video" else F.lit(False)))
    known = store.agg(F.coalesce(F.bool_or(target), F.lit(False)).alias("k")).select(F.lit(1).alias("one"), "k")
    return result.agg(F.count("*").alias("n_items")).withColumn("one", F.lit(1)).join(known, "one").select("n_items", (~F.col("k")).alias("nothing_indexed"), F.lit(had_errors).alias("had_errors"))


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector (array<double>): the element-wise mean of each key's vectors, divided by its length (L2) if that isn't zero.

    A position's mean is over the vectors that have it; one that only nulls have is null. Null keys and keys without an element have no row.
    """
    sums = vector_sums(rows, key, vector).where(F.size("sums") > 0)
    mean = F.zip_with("sums", "counts", lambda s, n: F.when(n > 0, s / n))
    length = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda a, m: a + F.coalesce(m * m, F.lit(0.0))))
    scaled = sums.select("key", mean.alias("m"), length.alias("n"))
    return scaled.select(F.col("key").alias(key), F.transform("m", lambda m: F.when(F.col("n") > 0, m / F.col("n")).otherwise(m)).alias(vector))


def mean_vector(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """mean_vectors() as key, pos, value."""
    return mean_vectors(rows, key, vector).select(key, F.posexplode(vector).alias("pos", "value"))


def cross_max(pairs: DataFrame, floor: float = Similarity.cross_floor) -> DataFrame:
    """left_key, right_key, similarity from (left_key, right_key, left_id, right_id, s): each vector's best score on the other
    side, 0 below the floor, averaged over both sides."""
    keys = ("left_key", "right_key")
    best = [pairs.groupBy(*keys, side).agg(F.max("s").alias("b")).select(*keys, "b") for side in ("left_id", "right_id")]
    return best[0].unionByName(best[1]).groupBy(*keys).agg(F.avg(F.when(F.col("b") < floor, 0.0).otherwise(F.col("b"))).alias("similarity"))


def cross_max_of(rows: DataFrame, key: str, id_col: str, vector: str, floor: float = Similarity.cross_floor, block: int = BLOCK) -> DataFrame:
    """cross_max() of the vectors of every two keys, left_key < right_key: tasks hold two blocks of vectors and a strip of their scores, and send
    each vector's best score for each other key."""
    usable = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(id_col).alias("i"), F.col(vector).alias("v"))
    nb = max(1, -(-usable.count() // block))
    dealt = usable.withColumn("_mine", F.pmod(F.xxhash64("i"), F.lit(nb)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    dealt = dealt.withColumn("_lo", F.least("_mine", "_other")).withColumn("_hi", F.greatest("_mine", "_other"))
    kind = rows.schema[key].dataType.simpleString()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by([("_mine", "ascending"), ("k", "ascending")])
        v, length = matrix(t["v"])
        own, ids, coded = t["_mine"].to_numpy(), t["i"].combine_chunks(), t["k"].combine_chunks().dictionary_encode()
        of, n = coded.indices.to_numpy(), len(own)
        first = int(np.searchsorted(own, own[0], "right"))
        sides = [(slice(0, first), slice(first, n)), (slice(first, n), slice(0, first))] if t["_lo"][0].as_py() != t["_hi"][0].as_py() else [(slice(0, n), slice(0, n))]
        for mine, others in sides:
            theirs = of[others]
            start = np.flatnonzero(np.append(True, theirs[1:] != theirs[:-1])) if len(theirs) else []
            for a in strips(mine, len(theirs)) if len(theirs) else ():
                top = np.fmax.reduceat(products(v, length, a, others), start, axis=1)
                i, k = np.nonzero((of[a, None] != theirs[start]) & ~np.isnan(top))
                row = pa.array(i + a.start)
                columns = [coded.dictionary.take(pa.array(x)) for x in (of[a][i], theirs[start][k])]
                yield pa.RecordBatch.from_arrays([*columns, ids.take(row), pa.array(top[i, k])], ["own", "other", "i", "s"])

    found = dealt.groupBy("_lo", "_hi").applyInArrow(best, f"own {kind}, other {kind}, i {rows.schema[id_col].dataType.simpleString()}, s double")
    each = found.groupBy("own", "other", "i").agg(F.max("s").alias("b"))
    ends = each.select(F.least("own", "other").alias("left_key"), F.greatest("own", "other").alias("right_key"), F.when(F.col("b") < floor, 0.0).otherwise(F.col("b")).alias("b"))
    return ends.groupBy("left_key", "right_key").agg(F.avg("b").alias("similarity"))


def display_path(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """dir, path, display_path: the stored thumbnail of a listed file, else the file itself."""
    return rows.join(entries.select("path", "thumbnail_path"), "path", "left").select("dir", "path", F.coalesce("thumbnail_path", "path").alias("display_path"))

"""Pair search by blocks: every pair of rows meets in one task, and no task holds more than two blocks and a strip of their scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import cells, meeting, met
from .matrices import strips

BLOCK = 2048
#: Gives, of a task's rows, the scores of two slices of them (NaN: no pair).
Score = Callable[[pa.Table], Callable[[slice, slice], np.ndarray]]
#: Pairs sent in one batch.
SENT = 1 << 16
#: By how much a score may differ between groups, as products are summed in another order.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Prune:
    """How a score is bounded: the vector columns, and a function from the bounds of their dot products to that of the score."""

    columns: tuple[str, ...]
    bound: Callable[[list[np.ndarray]], np.ndarray]
    report: Callable[[int, int], None] | None = None


def similar_pairs(rows: DataFrame, score: Score, threshold: float, top: int | None = None, block: int = BLOCK, prune: Prune | None = None) -> DataFrame:
    """left_path, right_path, similarity of pairs that score `threshold` or more; left has the smaller ordinal.

    rows: ordinal, path and what score() needs to give the scores of a task's rows, a strip at a time. Rows are
    dealt to ceil(n / block) blocks by a hash of the ordinal and each pair of blocks is one group, so that a row is
    sent once for each block. With `top`, a group sends its best `top` pairs by score, left path and right path, and
    the whole result is cut likewise.

    With `prune` and more than one block, rows are dealt to cells round pivots instead, and cells whose bound is below the
    threshold never meet; with `top`, the threshold is first raised to the score that the best `top` pairs within cells have. Both are exact.
    Where that would send more rows than blocks do, as of vectors in all directions, blocks are used. prune.report gets the pairs of units and how many were skipped.
    """
    n = rows.count()
    nb = max(1, -(-n // block))
    if prune and nb > 1:
        found = cells(rows, list(prune.columns), nb)
        least = threshold
        if top:
            own = meeting(found, prune.bound, threshold, block)
            own = replace(own, meets=own.meets & np.eye(len(own.meets), dtype=bool))
            best = [r[0] for r in _searched(met(found, own), score, threshold, top).select("similarity").collect()]  # at most `top`
            least = max(threshold, min(best) - ROUNDING) if len(best) == top else threshold
        plan = meeting(found, prune.bound, least, block)
        if prune.report:
            prune.report(plan.pairs, plan.skipped)
        if not plan.meets.any():
            return _searched(_blocks(rows, 1).limit(0), score, threshold, top)
        if plan.copies <= n * nb:
            return _searched(met(found, plan), score, least, top)
    return _searched(_blocks(rows, nb), score, threshold, top)


def _blocks(rows: DataFrame, nb: int) -> DataFrame:
    mine = F.pmod(F.xxhash64("ordinal"), F.lit(nb)).cast("int")
    dealt = rows.withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    return dealt.withColumn("_lo", F.least("_mine", "_other")).withColumn("_hi", F.greatest("_mine", "_other")).drop("_other")


def _searched(dealt: DataFrame, score: Score, threshold: float, top: int | None) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).sort_by("_mine")
        own, ordinal, path = t["_mine"].to_numpy(), t["ordinal"].to_numpy(), t["path"].combine_chunks()
        scores, n = score(t), len(own)
        two = t["_lo"][0].as_py() != t["_hi"][0].as_py()
        first = int(np.searchsorted(own, own[0], "right")) if two else n
        rank = np.argsort(np.argsort(np.array(path.to_pylist(), object), kind="stable"), kind="stable") if top is not None else None
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for a in strips(slice(0, first), n - first if two else n):
            b = slice(first if two else a.start, n)
            s = scores(a, b)
            with np.errstate(invalid="ignore"):
                hit = s >= threshold
            if not two:
                hit = np.triu(hit, 1)
            i, j = np.nonzero(hit)
            found, i, j = s[i, j], i + a.start, j + b.start
            turned = ordinal[i] > ordinal[j]
            i, j = np.where(turned, j, i), np.where(turned, i, j)
            some = ordinal[i] < ordinal[j]
            i, j, found = i[some], j[some], found[some]
            if top is None:
                for k in range(0, len(found), SENT):
                    yield _pairs(path, i[k : k + SENT], j[k : k + SENT], found[k : k + SENT])
                continue
            i, j, found = (np.concatenate([x, y]) for x, y in zip(best, (i, j, found), strict=True))
            if len(found) > top:
                keep = np.flatnonzero(found >= np.partition(found, len(found) - top)[len(found) - top]) if top else np.zeros(0, np.int64)
                keep = keep[np.lexsort((rank[j[keep]], rank[i[keep]], -found[keep]))][:top]
                i, j, found = i[keep], j[keep], found[keep]
            best = [i, j, found]
        yield _pairs(path, *best)

    pairs = dealt.groupBy("_lo", "_hi").applyInArrow(search, "left_path string, right_path string, similarity double")
    return pairs.orderBy(F.desc("similarity"), "left_path", "right_path").limit(top) if top is not None else pairs


def _pairs(path: pa.Array, i: np.ndarray, j: np.ndarray, found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([path.take(pa.array(i)), path.take(pa.array(j)), pa.array(found, pa.float64())], ["left_path", "right_path", "similarity"])

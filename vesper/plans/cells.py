"""Pair search that passes over what can't match: vectors are dealt to cells round pivots, and cells too far apart never meet."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matrices import matrix, strips

#: Cells at most: their centres and all pairs of them are held by the driver.
PIVOTS = 1024
#: What rounding may add to a bound, for each product of norms.
SLACK = 1e-6


@dataclass(frozen=True)
class Cells:
    """rows: with `_cell`. size: rows of each cell; angle and norm: the largest of each cell and vector column; between: angles of the cells' pivots by
    column; pivots: their directions by column. The last cell, without a pivot, holds rows with a component that isn't finite."""

    rows: DataFrame
    size: np.ndarray
    angle: np.ndarray
    norm: np.ndarray
    between: np.ndarray
    pivots: list[np.ndarray]

    def bounds(self) -> np.ndarray:
        """For each vector column and pair of cells, the most that a dot product over the two can be.

        A vector's angle to its pivot is at most its cell's, so that two vectors are apart by what their pivots are apart less both
        cells' angles. Rows with a component that isn't finite are in the last cell, which meets all.
        """
        apart = np.maximum(0, self.between - self.angle[:, :, None] - self.angle[:, None, :])
        with np.errstate(invalid="ignore"):
            most = self.norm[:, :, None] * self.norm[:, None, :]
            out = most * np.maximum(0, np.cos(np.minimum(apart, math.pi))) + SLACK * most + 1e-9
        out[:, -1, :] = out[:, :, -1] = np.inf
        return out


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions (zero where there is none) and norms."""
    with np.errstate(all="ignore"):
        norm = np.sqrt((v * v).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        return np.where(good[:, None], v / np.where(good, norm, 1)[:, None], 0), norm


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between directions, each padded with zeros to the longer; pi / 2 and more where one has none, as for any direction, so 0 is subtracted safely."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    return np.arccos(np.clip(a @ b.T, -1, 1))


def _spread(directions: list[np.ndarray], n: int) -> list[int]:
    """Numbers of at most n rows, each the farthest from those before."""
    known = [d.any(axis=1) for d in directions]
    far, chosen = np.full(len(directions[0]), 4.0), []
    while len(chosen) < min(n, len(far)) and far.max() > 0:
        k = int(far.argmax())
        chosen.append(k)
        total, have = np.zeros(len(far)), np.zeros(len(far))
        for d, has in zip(directions, known, strict=True):
            meets = has & has[k]
            total += np.where(meets, _angles(d, d[k : k + 1])[:, 0], 0)
            have += meets
        far = np.minimum(far, np.where(have > 0, total / np.maximum(have, 1), 4.0))
        far[k] = 0
    return chosen


def cells(rows: DataFrame, columns: list[str], n: int) -> Cells:
    """Deals rows (ordinal and vector columns) to n cells, at most PIVOTS, by the pivot of smallest angle.

    Pivots are chosen far apart among the 4 n rows of smallest hash of the ordinal: the same in every run, at most 4 PIVOTS vectors. A row's angle is the mean of its columns that have a
    direction. Vectors of different length are padded with zeros, which leaves the product over the shorter.
    """
    n = min(n, PIVOTS)
    picked = rows.orderBy(F.xxhash64("ordinal"), "ordinal").limit(4 * n).select(*columns).toArrow()
    pivots = [_unit(matrix(picked[c])[0])[0] for c in columns]
    chosen = _spread(pivots, n)
    pivots, n = [p[chosen] for p in pivots], len(chosen)
    known = [p.any(axis=1) for p in pivots]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few rows at a time, as each has an angle to every pivot
        for batch in (whole.slice(at.start, at.stop - at.start) for whole in batches for at in strips(slice(0, whole.num_rows), n)):
            angles, norms, wild = [], [], np.zeros(batch.num_rows, bool)
            total, have = np.zeros((batch.num_rows, n)), np.zeros((batch.num_rows, n))
            for c, pivot, has in zip(columns, pivots, known, strict=True):
                v = matrix(pa.chunked_array([batch.column(c)]))[0]
                wild |= ~np.isfinite(v).all(axis=1)
                unit, norm = _unit(v)
                meets = unit.any(axis=1)[:, None] & has[None, :]
                angle = np.where(meets, _angles(unit, pivot), math.pi)
                total += np.where(meets, angle, 0)
                have += meets
                angles.append(angle)
                norms.append(norm)
            with np.errstate(invalid="ignore"):
                cell = np.where(have > 0, total / np.maximum(have, 1), 4.0).argmin(axis=1)
            own = np.arange(batch.num_rows)
            # a vector without direction has no product to bound
            angle = [np.where(m > 0, a[own, cell], 0.0) for a, m in zip(angles, norms, strict=True)]
            cell[wild] = n
            new = [pa.array(cell.astype(np.int32)), *(pa.array(np.where(wild, 0, x)) for x in angle), *(pa.array(np.where(wild, 0, x)) for x in norms)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *extra])

    extra = ["_cell", *(f"_angle{i}" for i in range(len(columns))), *(f"_norm{i}" for i in range(len(columns)))]
    schema = T.StructType([*rows.schema.fields, T.StructField("_cell", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in extra[1:])])
    dealt = rows.mapInArrow(deal, schema)
    found = dealt.groupBy("_cell").agg(F.count("*"), *(F.max(c) for c in extra[1:])).collect()  # a row a cell
    size, stats = np.zeros(n + 1, np.int64), np.zeros((2 * len(columns), n + 1))
    for r in found:
        size[r[0]], stats[:, r[0]] = r[1], r[2:]
    between = np.zeros((len(columns), n + 1, n + 1))
    for k, (p, has) in enumerate(zip(pivots, known, strict=True)):
        between[k, :n, :n] = np.where(has[:, None] & has[None, :], _angles(p, p), 0)
    return Cells(dealt.drop(*extra[1:]), size, stats[: len(columns)], stats[len(columns) :], between, pivots)


def reach(target: list[float] | None, pivots: np.ndarray, angle: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """For each cell with a pivot, the most that the dot product of one vector with any of the cell's can be."""
    unit, length = _unit(np.array([target or [0.0]], np.float64))
    if not math.isfinite(length[0]):
        return np.full(len(angle), np.inf)
    known = pivots.any(axis=1) & unit.any()
    apart = np.where(known, _angles(unit, pivots)[0], 0) - angle
    return length[0] * norm * (np.maximum(0, np.cos(np.clip(apart, 0, math.pi))) + SLACK) + 1e-9


@dataclass(frozen=True)
class Meeting:
    """Which cells meet: units are cells cut to `block` rows. copies: rows to be sent; pairs and skipped: pairs of units, and those that never meet."""

    meets: np.ndarray
    units: np.ndarray
    copies: int
    pairs: int
    skipped: int


def meeting(found: Cells, bound: Callable[[list[np.ndarray]], np.ndarray], threshold: float, block: int) -> Meeting:
    meets = ~(bound(list(found.bounds())) < threshold)
    units = -(-found.size // block)
    meets &= (units > 0)[:, None] & (units > 0)[None, :]
    total = int(units.sum())
    same = int((units * (units + 1) // 2)[np.diag(meets)].sum())
    across = int((np.triu(meets, 1) * units[:, None] * units[None, :]).sum())
    return Meeting(meets, units, int((found.size[:, None] * meets * units[None, :]).sum()), total * (total + 1) // 2, total * (total + 1) // 2 - same - across)


def met(found: Cells, plan: Meeting) -> DataFrame:
    """rows with _mine, _lo, _hi: a copy for each unit that a row's unit meets."""
    spark = found.rows.sparkSession
    first = np.concatenate([[0], np.cumsum(plan.units)[:-1]])
    partners = [(c, int(first[c]), int(plan.units[c]), [(int(first[b]), int(first[b] + plan.units[b] - 1)) for b in np.flatnonzero(plan.meets[c])]) for c in range(len(plan.units)) if plan.meets[c].any()]
    table = spark.createDataFrame(partners, "_cell int, _first int, _n int, _with array<struct<a:int,b:int>>")
    rows = found.rows.join(F.broadcast(table), "_cell")  # at most PIVOTS + 1 rows of as many pairs
    rows = rows.withColumn("_mine", (F.col("_first") + F.pmod(F.xxhash64("ordinal"), F.col("_n"))).cast("int")).withColumn("_b", F.explode("_with"))
    rows = rows.withColumn("_other", F.explode(F.sequence("_b.a", "_b.b")))
    return rows.withColumn("_lo", F.least("_mine", "_other")).withColumn("_hi", F.greatest("_mine", "_other")).drop("_cell", "_first", "_n", "_with", "_b", "_other")

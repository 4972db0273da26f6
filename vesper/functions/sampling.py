"""Timestamps at which a video is sampled, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Sampling
from .vectors import col, finite



def _empty() -> Column:
    return F.array().cast("array<double>")


def uniform_points(n: int, zone: str | Column) -> Column:
    """n points inside (0, zone), equally spaced; none if n is 0 or the zone isn't positive."""
    z = col(zone).cast("double")
    return F.when(z > 0, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: z / (n + 1) * i)).otherwise(_empty()) if n else _empty()


def gap_filter(points: str | Column, gap: float, exempt: tuple[float, ...] = ()) -> Column:
    """Of sorted points, those at least `gap` after the last one kept. Points within 1e-9 of an exempt value are
    always kept, repeats included, and count as the last one kept."""
    fixed = F.array(*map(F.lit, exempt)) if exempt else None

    def step(acc: Column, t: Column) -> Column:
        keep = (F.size(acc) == 0) | (t - F.try_element_at(acc, F.lit(-1)) >= gap)
        if fixed is not None:
            keep = keep | F.exists(fixed, lambda f: F.abs(f - t) < 1e-9)
        return F.when(keep, F.array_append(acc, t)).otherwise(acc)

    return F.aggregate(col(points).cast("array<double>"), _empty(), step)


def sample_timestamps(duration: str | Column, cfg: Sampling = Sampling()) -> Column:
    """Head anchors, points in the head zone, shares and tail anchors of a duration: sorted, inside (0, duration),
    thinned to the least gap. Null, NaN, infinite and non-positive durations: none."""
    d = col(duration).cast("double")
    zone = F.least(F.lit(cfg.head_zone), d * 0.5)
    start = cfg.head_anchors[-1] if cfg.head_anchors else 0.0
    step = (zone - start) / (cfg.head_points + 1)
    head = F.when(zone > start, F.transform(F.sequence(F.lit(1), F.lit(cfg.head_points)), lambda i: step * i + start)).otherwise(_empty())
    points = F.concat(F.array(*map(F.lit, cfg.head_anchors)), head, F.array(*[d * s for s in cfg.shares]), F.array(*[d - t for t in cfg.tail_anchors]))
    inside = F.array_sort(F.filter(points, lambda t: (t > 0) & (t < d)))
    return F.when(finite(d) & (d > 0), gap_filter(inside, cfg.min_gap, cfg.head_anchors)).otherwise(_empty())


def sampling_summary(duration: str | Column, cfg: Sampling = Sampling()) -> Column:
    """Counts of points by part of the video: head, tail and between."""
    d, points = col(duration).cast("double"), sample_timestamps(duration, cfg)
    head = F.size(F.filter(points, lambda t: t <= F.least(F.lit(cfg.head_zone), d * 0.5)))
    tail = F.size(F.filter(points, lambda t: t >= d - max(cfg.tail_anchors)))
    return F.struct(F.size(points).alias("total"), head.alias("head"), F.greatest(F.lit(0), F.size(points) - head - tail).alias("mid"), tail.alias("tail"))

"""Array numerics as column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v: str | Column) -> Column:
    return col(v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def dot(a: str | Column, b: str | Column) -> Column:
    """Sum of products over the shorter of two vectors; empty: 0; null if either is null."""
    x, y = doubles(a), doubles(b)
    n = F.least(F.size(x), F.size(y))
    return total(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p * q))


def strict_dot(a: str | Column, b: str | Column) -> Column:
    """As dot(), but null for empty vectors, vectors of different length, and sums that aren't finite."""
    s = total(F.zip_with(doubles(a), doubles(b), lambda p, q: p * q))
    return F.when((F.size(col(a)) == F.size(col(b))) & (F.size(col(a)) > 0) & finite(s), s)


def has_signal(v: str | Column) -> Column:
    """Whether some element isn't zero (NaN isn't); null and empty vectors have none."""
    return F.coalesce(F.exists(doubles(v), lambda x: x != 0), F.lit(False))


def weighted_score(left: tuple[Column, Column], right: tuple[Column, Column], image_weight: float, audio_weight: float) -> Column:
    """Score of two (image, audio) vector pairs: both modalities weighted if all four have signal, else the one that
    both sides have (image first), else null. Weights stay as they are."""
    image, audio = has_signal(left[0]) & has_signal(right[0]), has_signal(left[1]) & has_signal(right[1])
    both = dot(left[0], right[0]) * image_weight + dot(left[1], right[1]) * audio_weight
    return F.when(image & audio, both).when(image, dot(left[0], right[0])).when(audio, dot(left[1], right[1]))


def norm(v: str | Column, epsilon: float = 0.0) -> Column:
    return F.sqrt(total(F.transform(doubles(v), lambda x: x * x)) + epsilon)


def l2_normalise(v: str | Column, least: float = 1e-12) -> Column:
    """v / |v| if |v| is over `least`, else v."""
    n = norm(v)
    return F.when(n > least, F.transform(doubles(v), lambda x: x / n)).otherwise(doubles(v))


def l2_normalise_smooth(v: str | Column, epsilon: float = 1e-8) -> Column:
    """v / sqrt(sum of squares + epsilon): a zero vector stays zero."""
    n = norm(v, epsilon)
    return F.transform(doubles(v), lambda x: x / n)

"""Running sums over a total order, without one task that sorts everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES, STEP = 256, 16


def running_sum(rows: DataFrame, order: list[str], value: str | None = None, into: str = "_prior", ranges: int = RANGES) -> DataFrame:
    """rows with `into`: the sum of `value` (None: the number) of the rows before each in ascending order of the columns `order`.

    Rows are dealt to ranges between the ranges - 1 rows whose keys have the smallest hashes: a sample of the rows, so that a
    column of one value doesn't matter as long as the whole key varies, and the same sample in every run. Each range is
    sorted by itself and gets the sums of earlier ranges, of which there are at most `ranges`.
    """
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    kinds = rows.select(key.alias("k")).schema["k"].dataType
    sampled = rows.select(key.alias("k"), F.xxhash64(*order).alias("h")).orderBy("h").limit(ranges - 1).orderBy("k").collect()
    bounds = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r["k"], kinds, strict=True)]) for r in sampled]
    dealt = rows.withColumn("_key", key).withColumn("_range", _below(bounds, F.col("_key"))).drop("_key")
    each = F.lit(1).cast("long") if value is None else F.col(value)
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range").agg(F.sum(each).alias("_s"))
    sums = sums.select("_range", F.coalesce(F.sum("_s").over(before.orderBy("_range")), F.lit(0)).alias("_earlier"))
    within = F.coalesce(F.sum(each).over(before.partitionBy("_range").orderBy(*order)), F.lit(0))
    return dealt.withColumn("_within", within).join(F.broadcast(sums), "_range").withColumn(into, F.col("_within") + F.col("_earlier")).drop("_range", "_within", "_earlier")  # at most `ranges` rows


def _below(bounds: list[Column], key: Column) -> Column:
    """How many of the bounds, which are in order, aren't over the key: first among every sixteenth, then among those between."""
    count = lambda some: F.size(F.filter(F.array(*some), lambda b: b <= key)) if some else F.lit(0)
    if len(bounds) <= STEP:
        return count(bounds)
    coarse, blocks = count(bounds[STEP - 1 :: STEP]), F.array(*[F.array(*bounds[k : k + STEP]) for k in range(0, len(bounds), STEP)])
    rest = F.coalesce(F.size(F.filter(F.get(blocks, coarse), lambda b: b <= key)), F.lit(0))
    return coarse * STEP + F.greatest(rest, F.lit(0))

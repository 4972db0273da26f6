"""Sums of whole vectors by key: combined in the tasks that read them, then merged, so that what is shuffled doesn't grow with the rows of a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .matrices import matrix

#: Numbers that a task holds before it sends its sums on.
HELD = 1 << 21


class _Held:
    """Sums and counts of each position, by key."""

    def __init__(self) -> None:
        self.sums: dict = {}
        self.size = 0

    def add(self, key, total: np.ndarray, count: np.ndarray) -> None:
        old = self.sums.get(key)
        if old is None:
            self.sums[key] = (total.copy(), count.copy())
            self.size += 2 * len(total)
            return
        if len(old[0]) < len(total):
            self.size += 2 * (len(total) - len(old[0]))
            old = tuple(np.pad(x, (0, len(total) - len(x))) for x in old)
            self.sums[key] = old
        old[0][: len(total)] += total
        old[1][: len(count)] += count

    def sent(self, kind: pa.DataType) -> pa.RecordBatch:
        keys, pairs = list(self.sums), list(self.sums.values())
        out = [pa.array(keys, kind), pa.array([p[0] for p in pairs], pa.list_(pa.float64())), pa.array([p[1] for p in pairs], pa.list_(pa.int64()))]
        self.sums, self.size = {}, 0
        return pa.RecordBatch.from_arrays(out, ["key", "sums", "counts"])


def vector_sums(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, sums (array<double>), counts (array<long>): of each position over the key's vectors, which may be of different length.

    Null elements aren't counted, NaN makes a sum NaN. Null keys and null vectors are left out. A task sends a row for each key it has met (more often
    if it meets more numbers than it may hold), so that a key of a third of all rows is as many rows as there are tasks.
    """
    kind = rows.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            column = pa.chunked_array([batch.column(1)])
            v, length = matrix(column)
            here = np.arange(v.shape[1]) < length[:, None]
            here[here] = pc.is_valid(pc.list_flatten(column)).to_numpy()
            v = np.where(here, v, 0)
            coded = pc.dictionary_encode(batch.column(0))
            code, keys = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            if len(first):
                with np.errstate(all="ignore"):
                    totals = np.add.reduceat(v[order], first, axis=0)
                counts, longest = np.add.reduceat(here[order].astype(np.int64), first, axis=0), np.maximum.reduceat(length[order], first)
                for k, total, count, n in zip(code[order][first], totals, counts, longest, strict=True):
                    held.add(keys[k], total[:n], count[:n])
            if held.size > HELD:
                yield held.sent(batch.schema.field(0).type)
        if held.sums:
            yield held.sent(batch.schema.field(0).type)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = _Held(), None
        for batch in batches:
            for k, total, count in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                # rows are in order of their keys: what is held is complete when a new key comes
                if held.size > HELD and k != last:
                    yield held.sent(batch.schema.field(0).type)
                held.add(k, total.values.to_numpy(), count.values.to_numpy())
                last = k
        if held.sums:
            yield held.sent(batch.schema.field(0).type)

    usable = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    return usable.mapInArrow(combine, schema).repartition("key").sortWithinPartitions("key").mapInArrow(merge, schema)

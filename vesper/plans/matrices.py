"""Arrow array columns as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores of pairs that a task holds at once.
STRIP = 1 << 20


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of an array column, padded with zeros, as doubles; and their lengths (null: 0)."""
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
    out = np.zeros((len(length), length.max(initial=0)))
    out[np.arange(out.shape[1]) < length[:, None]] = pc.list_flatten(column).to_numpy()
    return out, length


def products(v: np.ndarray, length: np.ndarray, a: slice, b: slice) -> np.ndarray:
    """Dot products of the rows `a` with the rows `b`, each over the shorter of the two."""

    def one(i: int, others: slice) -> np.ndarray:
        shared = np.arange(v.shape[1]) < np.minimum(length[i], length[others])[:, None]
        return np.where(shared, v[i] * v[others], 0).sum(axis=1)

    with np.errstate(all="ignore"):
        left, right = (np.isfinite(v[x]).all(axis=1) for x in (a, b))
        s = np.where(left[:, None], v[a], 0) @ np.where(right[:, None], v[b], 0).T
        for i in np.flatnonzero(~left):  # zero times infinity would spoil padding
            s[i] = one(a.start + i, b)
        for j in np.flatnonzero(~right):
            s[:, j] = one(b.start + j, a)
    return s


def strips(a: slice, width: int) -> Iterator[slice]:
    """The rows `a` by as many as make STRIP scores with `width` others, so that the scores held at once don't grow with the square of a group."""
    step = max(1, STRIP // max(1, width))
    for at in range(a.start, a.stop, step):
        yield slice(at, min(a.stop, at + step))

"""Removal of long passages that an earlier document has, found by anchors at the positions of a difference cover."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pow2

# Perfect difference sets. Every number below the period is a difference of two members, modulo the period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
LENGTH = 13
#: Bytes of text that are hashed at once (longer texts in pieces), and whose postings are combined before they are sent.
PIECE, BATCH = 1 << 20, 1 << 24
#: Bytes of text to each bucket of postings, and postings in a row.
BUCKET, ROW = 1 << 24, 1 << 15
#: A null id counts as the largest.
LAST = (1 << 63) - 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: The low bits of a row's hash, by which texts are dealt besides their id: rows of one id, as of null ids, don't meet in one group.
SHORT = (1 << 16) - 1
_POSTED = "bucket int, direct boolean, base long, ids binary, rows binary, counts binary, keys binary, places binary"


def cover_for(length: int) -> tuple[int, tuple[int, ...], int]:
    """Period, cover and anchor width for windows of `length` words: the largest period that leaves anchors at least as wide.

    Two equal windows that start at i and j share an offset below the period at which both i + offset and j + offset
    are in the cover, and the anchor there ends in the window as period - 1 + width is `length`.
    """
    period = max(v for v in COVERS if v == 1 or 2 * v - 1 <= length)
    return period, COVERS[period], length - period + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    """A 64-bit hash of the n words from each position."""
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= factor
        out += h[k : len(h) - n + 1 + k]
    return _mix(out)


def pieces(text: bytes, overlap: int) -> Iterator[tuple[int, list[bytes]]]:
    """The number of words before each piece of a text, and its words with the first `overlap` of what follows."""
    before, held, at = 0, [], 0
    while True:
        cut = _SPACE.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        held += text[at:end].split()  # on just these six characters
        at = end
        if not cut:
            yield before, held
            return
        if len(held) > overlap:
            yield before, held
            before += len(held) - overlap
            held = held[len(held) - overlap :]


def hashed(text: bytes, overlap: int) -> Iterator[tuple[int, np.ndarray]]:
    digest = xxhash.xxh3_64_intdigest
    for before, words in pieces(text, overlap):
        yield before, np.fromiter(map(digest, words), np.uint64, len(words))


def anchors(before: int, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the piece that are in the cover, and the hash of the anchor at each."""
    period, cover, width = cover_for(length)
    if len(h) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place = np.arange(len(h) - width + 1)
    place = place[np.isin((place + before) % period, cover)]
    return place, grams(h, width, _A)[place]


def windows(before: int, h: np.ndarray, shared: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Extends anchors: places in the text and 128-bit keys of the windows with an anchor of `shared` (sorted, as _short() gives them) at a place of the cover."""
    period, _, width = cover_for(length)
    place, anchor = anchors(before, h, length)
    hit = np.zeros(len(h) + 1, np.int32)
    hit[place[_member(_short(anchor), shared)] + 1] = 1
    hit = np.cumsum(hit)
    n = len(h) - length + 1
    at = np.flatnonzero(hit[length - width + 1 : length - width + 1 + n] > hit[:n]) if n > 0 else np.zeros(0, np.int64)
    if not len(at):
        return at, np.zeros((0, 2), np.uint64)
    return at + before, np.stack([grams(h, length, _A)[at], grams(_mix(h + _B), length, _C)[at]], axis=1)


def _short(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(16)


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.searchsorted(among, values)
    return (at < len(among)) & (among[np.minimum(at, len(among) - 1)] == values) if len(among) else np.zeros(len(values), bool)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal rows."""
    new = _starts(*columns)
    return list(zip(new.tolist(), [*new[1:].tolist(), len(columns[0])], strict=True)) if len(new) else []


class _Postings:
    """Postings of a batch of texts: keys (columns of uint64), the number of their document in the batch, and, where wanted, their place in it.

    Of a key that several documents of the batch have, the smallest id stands for all towards other batches (with the largest, where only
    a difference counts), so that a passage in a third of all documents is sent once or twice a batch; what the batch itself settles is passed on directly.
    """

    def __init__(self, buckets: int, mask: int, width: int, placed: bool):
        self.buckets, self.mask, self.width, self.placed = buckets, np.uint64(mask), width, placed
        self.clear()

    def clear(self) -> None:
        self.ids, self.rows, self.keys, self.doc, self.place = [], [], [], [], []

    def add(self, own: int, row: int, keys: np.ndarray, place: np.ndarray) -> None:
        """Of a document or a piece of one."""
        self.ids.append(own)
        self.rows.append(row)
        self.keys.append(keys)
        self.doc.append(np.full(len(keys), len(self.ids) - 1, np.int64))
        self.place.append(place)

    def sent(self) -> Iterator[pa.RecordBatch]:
        if self.keys and sum(map(len, self.keys)):
            ids, rows = np.array(self.ids, np.int64), np.array(self.rows, np.int64)
            keys, doc, place = np.concatenate(self.keys), np.concatenate(self.doc), np.concatenate(self.place)
            order = np.lexsort((place, ids[doc], *keys.T[::-1])) if self.placed else np.lexsort((ids[doc], *keys.T[::-1]))
            keys, doc, place = keys[order], doc[order], place[order]
            first = _starts(*keys.T)
            size = np.diff(np.append(first, len(keys)))
            low, high = np.repeat(ids[doc[first]], size), np.repeat(ids[doc[first + size - 1]], size)
            own = ids[doc]
            if self.placed:  # later documents lose the window whatever other batches hold
                direct, post = own > low, own == low
            else:  # the smallest and largest id for other batches, and every document of the batch is told if they differ; rows of one id must all hear from others
                direct, post = high > low, high == low
                post[first] = post[first + size - 1] = True
            spread = (rows[doc].view(np.uint64) & np.uint64(self.buckets - 1)).astype(np.int64)
            yield from self._rows(direct, spread, True, ids, rows, keys, doc, place)
            yield from self._rows(post, (keys[:, 0] & self.mask).astype(np.int64), False, ids, rows, keys, doc, place)
        self.clear()

    def _rows(self, which, bucket, direct, ids, rows, keys, doc, place) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(which)
        at = at[np.lexsort((doc[at], bucket[at]))]
        bucket, doc, keys, place = bucket[at], doc[at], _packed(keys[at], self.width), place[at].astype("<u4")
        out = []
        for a, b in _runs(bucket):
            for k in range(a, b, ROW):
                d = doc[k : min(b, k + ROW)]
                new = _starts(d)
                count = np.diff(np.append(new, len(d))).astype("<u2")  # at most ROW
                out.append((int(bucket[k]), direct, *_narrow(ids[d[new]]), rows[d[new]].astype("<i8" if self.placed else "<u2").tobytes(), count.tobytes(), keys[k : k + len(d)].tobytes(), place[k : k + len(d)].tobytes() if self.placed else b""))
        for k in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[k : k + 256], strict=True), (pa.int32(), pa.bool_(), pa.int64(), *[pa.binary()] * 5), strict=True)], _POSTED.replace(",", "").split()[::2])


def _narrow(ids: np.ndarray) -> tuple[int, bytes]:
    """A base, and what ids are more than that: in 4 bytes each, or, where they are too far apart, the ids in 8."""
    base, most = int(ids.min()), int(ids.max())
    return (base, (ids - base).astype("<u4").tobytes()) if most - base < 1 << 32 else (0, ids.astype("<i8").tobytes())


def _widened(base: int, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u4" if len(data) == 4 * n else "<i8").astype(np.int64) + base


def _packed(keys: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bytes of each key column, rows joined."""
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(len(keys), keys.shape[1], 8)[:, :, :width].reshape(len(keys), keys.shape[1] * width)


def _unpacked(data: bytes, columns: int, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, columns, width)
    out = np.zeros((len(raw), columns, 8), np.uint8)
    out[:, :, :width] = raw
    return out.reshape(len(raw), columns * 8).view("<u8")


def _settled(posted: DataFrame, columns: int, width: int, placed: bool) -> DataFrame:
    """id, row, data of postings that another document settles: their keys, with the low bits of their row's hash, or, if placed, their places where a smaller id has the key.

    A bucket's postings, bounded as buckets grow with the text, are sorted in one task by numpy; direct ones pass through.
    """

    def solve(parts: list[tuple]) -> Iterator[tuple]:
        rows, counts, keys, places = (b"".join(p[i] for p in parts) for i in range(4, 8))
        count = np.frombuffer(counts, "<u2")
        ids = np.repeat(np.concatenate([_widened(p[2], p[3], len(p[5]) // 2) for p in parts]), count)
        rows = np.repeat(np.frombuffer(rows, "<i8" if placed else "<u2").astype(np.int64), count)
        key = _unpacked(keys, columns, width)
        if parts[0][1]:
            at = np.arange(len(key))
        else:
            order = np.lexsort((ids, *key.T[::-1]))
            sorted_ids, k = ids[order], key[order]
            first = _starts(*k.T)
            size = np.diff(np.append(first, len(k)))
            low, high = sorted_ids[first], sorted_ids[first + size - 1]
            at = order[sorted_ids > np.repeat(low, size) if placed else np.repeat(high > low, size)]
        at = at[np.lexsort((rows[at], ids[at]))]
        data = np.frombuffer(places, "<u4")[at] if placed else _packed(key[at], width)
        for a, b in _runs(ids[at], rows[at]):
            yield int(ids[at[a]]), int(rows[at[a]]), data[a:b].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[list[tuple]]:
            held: list[tuple] = []
            for batch in batches:
                for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    # direct rows have nothing to be held against, and go on one by one
                    if held and (held[0][:2] != r[:2] or r[1]):
                        yield held
                        held = []
                    held.append(r)
            if held:
                yield held

        out, size = [], 0
        for group in groups():
            for row in solve(group):
                out.append(row)
                size += len(row[2]) + 64
                if size > 1 << 22:
                    yield _batch(out)
                    out, size = [], 0
        yield _batch(out)

    return posted.repartition("bucket").sortWithinPartitions("bucket", "direct").mapInArrow(run, "id long, row long, data binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["id", "row", "data"])


def _with_found(texts: DataFrame, settled: DataFrame, data: str | Column, how: str) -> DataFrame:
    """texts with `data`, a list of what was found of the rows of their id and low bits.

    Both joins of a run need the same columns of the texts by the same keys, so that Spark shuffles the texts once and reads that twice.
    """
    found = settled.groupBy("id", F.col("row").bitwiseAND(SHORT).alias("short")).agg(F.collect_list(data).alias("data")).select(F.col("id").alias("_id"), F.col("short").alias("_short"), "data")
    return texts.join(found, (F.col("id") == F.col("_id")) & (F.col("short") == F.col("_short")), how).drop("_id", "_short")


def earlier(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """id, row, data: places of the windows of `length` words that also start in a text of smaller id, of (doc, id, short, row, text) rows.

    1. Anchors are posted at the places of the cover; those of one document only go. 2. Texts that have others, or whose id and low bits have, are hashed again; every window
    that holds one at a place of the cover is posted under its 128-bit hash, and lost if the smallest id there is smaller.
    """

    def post(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
        held, size = _Postings(buckets, buckets - 1, (6, 8)[level], bool(level)), 0
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_buffer()
                shared = np.unique(_unpacked(b"".join(batch.column("data")[k].as_py()), 1, 6)) if level else None
                own = batch.column("id")[k].as_py(), batch.column("row" if level else "short")[k].as_py()
                for before, h in hashed(text.to_pybytes() if text else b"", length - 1):
                    if level:
                        place, keys = windows(before, h, shared, length)
                    else:
                        keys = _short(np.unique(anchors(before, h, length)[1]))[:, None]
                        place = np.zeros(len(keys), np.int64)
                    held.add(*own, keys, place)
                    size += min(PIECE, text.size if text else 0) + 64
                    if size > BATCH:
                        yield from held.sent()
                        size = 0
        yield from held.sent()

    shared = _settled(texts.select("id", "short", "text").mapInArrow(lambda b: post(b, 0), _POSTED), 1, 6, False)
    again = _with_found(texts, shared, "data", "inner")
    return _settled(again.mapInArrow(lambda b: post(b, 1), _POSTED), 2, 8, True)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, bucket: int = BUCKET, with_kept: bool = True) -> DataFrame:
    """id, n_words, n_removed, kept_sha256, and with_kept: kept (text) and removed (array of start and end, in words).

    A window is `length` words of one document in a row. Every word is removed that a window covers whose words also start in a document of smaller id;
    windows are judged on the input. A null id counts as the largest, rows of one id aren't smaller than one another, and equal rows lose the same.
    Null text: no words. Shorter texts lose nothing. Long texts are hashed in pieces that overlap, places are 32 bits wide. Empty table: no rows.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("binary").alias("text"))
    texts = texts.select("doc", "id", F.col("row").bitwiseAND(SHORT).alias("short"), "row", "text")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = earlier(texts, length, pow2(total / bucket, 32, 1 << 22))
    rows = _with_found(texts, found, F.struct("row", "data"), "left").select("doc", "row", "text", "data")
    names = ["doc", "n_words", "n_removed", "kept_sha256", "kept", "removed"][: 6 if with_kept else 4]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def one(text: bytes, places: np.ndarray) -> tuple:
        digest, total, removed, kept, spans = hashlib.sha256(), 0, 0, [], []
        some, last = False, -1
        for before, words in pieces(text, 0):
            n = len(words)
            edge = np.zeros(n + 1, np.int64)
            near = places[(places > before - length) & (places < before + n)] - before
            np.add.at(edge, np.maximum(near, 0), 1)
            np.add.at(edge, np.minimum(near + length, n), -1)
            gone = np.cumsum(edge[:n]) > 0
            kept_words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if len(near) else words
            if kept_words:
                part = b" " * some + b" ".join(kept_words)
                some = True
                digest.update(part)
                if with_kept:
                    kept.append(part)
            if with_kept:
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))) + before
                for a, b in turn.reshape(-1, 2).tolist():
                    if spans and spans[-1]["end"] == a:
                        spans[-1]["end"] = b
                    else:
                        spans.append({"start": a, "end": b})
            total, removed = total + n, removed + n - len(kept_words)
        return total, removed, digest.hexdigest(), b"".join(kept).decode("utf-8", "replace"), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for doc, row, text, data in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    places = np.unique(np.frombuffer(b"".join(d["data"] for d in data or [] if d["row"] == row), "<u4")).astype(np.int64)
                    out.append((doc, *one(text or b"", places))[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names)

    schema = "doc long, n_words long, n_removed long, kept_sha256 string" + ", kept string, removed array<struct<start:long,end:long>>" * with_kept
    return rows.mapInArrow(run, schema).withColumnRenamed("doc", id_col)


SQL_OP11 = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 12 <= len(ws) THEN array_to_string(ws[i : i + 12], ' ') END AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
m AS (SELECT *, win IS NOT NULL AND min(doc_id) OVER (PARTITION BY win) < doc_id AS dup FROM p),
c AS (SELECT *, coalesce(max(CASE WHEN dup THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) >= i - 12, false) AS gone FROM m),
k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""

"""Exact removal of long repeated byte strings, by column-wise Burrows-Wheeler construction over candidate passages."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

LENGTH, GRAM = 200, 64
BLOCK = 1024
#: Bytes that are hashed at once; longer texts are hashed in pieces.
BATCH = 1 << 20
#: Tasks that the copies of one passage are spread over.
SALTS = 32
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_PLACE = np.uint64((1 << 28) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _A)


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of the `gram` bytes (a power of two) from each position, by doubling."""
    h, n, factor = _BYTES[raw], 1, _A
    while n < gram:
        h = h[:-n] * factor + h[n:]
        n, factor = 2 * n, np.uint64((int(factor) * int(factor) + 2) % (1 << 64))
    return _mix(h)


def passages(raw: np.ndarray, starts: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Passages of a batch of texts: text number, first and last window start, lead, anchor hash, content hash.

    Each window of `length` bytes has an anchor, its gram of smallest hash (the leftmost of equals). Windows that
    follow one another and have the same anchor are a passage: the bytes from its first window to the end of its last.
    Equal windows have equal anchors at equal places, so that a window can only recur in a passage of the same anchor
    hash. `lead` is the anchor's place in the passage.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    n = len(raw) - length + 1
    if n <= 0:
        return none
    h = gram_hashes(raw, gram)
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, span = length - gram + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: span - width], low[width - span :])
    anchor = (low[:n] & _PLACE).astype(np.int64)
    ends = np.append(starts[1:], len(raw))
    whole = np.zeros(n + 1, np.int32)  # windows that lie in one text
    fits = ends - starts >= length
    np.add.at(whole, starts[fits], 1)
    np.add.at(whole, ends[fits] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(whole[:n]))
    if not len(at):
        return none
    a = anchor[at]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, last = at[new], at[np.append(new[1:], len(at)) - 1]
    a = a[new]
    content, end = (last - first).astype(np.uint64) * _A, last + length - gram
    for k in range(0, width + length - gram + gram, gram):  # the grams that tile the passage, and its last
        content = _mix(content * _B + h[np.minimum(first + k, end)])
    text = np.searchsorted(starts, first, side="right") - 1
    return text, first - starts[text], last - starts[text], a - first, h[a].view(np.int64), content.view(np.int64)


def _batches(ids: list, texts: list[bytes], length: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, places in their texts, joined bytes and starts of the pieces of a batch. Pieces of a long text overlap by length - 1
    bytes, so that each window lies in just one."""
    held, own, places, size = [], [], [], 0
    for i, t in zip(ids, texts, strict=True):
        for at in range(0, max(1, len(t) - length + 1), BATCH):
            piece = t[at : at + BATCH + length - 1]
            held.append(piece)
            own.append(i)
            places.append(at)
            size += len(piece)
            if size >= BATCH:
                yield own, np.array(places, np.int64), *_joined(held)
                held, own, places, size = [], [], [], 0
    if held:
        yield own, np.array(places, np.int64), *_joined(held)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])[:-1]]).astype(np.int64)


def anchored(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, places, raw, starts in _batches(batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], length):
                text, first, last, lead, anchor, content = passages(raw, starts, length, gram)
                if len(text):
                    first, last = first + places[text], last + places[text]
                    yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content), pa.array(np.array(ids, np.int64)[text]), *(pa.array(x.astype(np.int32)) for x in (first, last, lead))], ["anchor", "content", "doc", "first", "last", "lead"])

    return texts.mapInArrow(run, "anchor long, content long, doc long, first int, last int, lead int")


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The minimum of values[low..high], both included."""
    levels, span = [values], 1
    most = int((high - low).max()) + 1 if len(low) else 1
    while 2 * span <= most:
        levels.append(np.minimum(levels[-1][:-span], levels[-1][span:]))
        span *= 2
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    for k, table in enumerate(levels):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[low[at]], table[high[at] - (1 << k) + 1])
    return out


def repeated_windows(passage: list[bytes], lead: np.ndarray, length: int = LENGTH, group: np.ndarray | None = None) -> np.ndarray:
    """For each passage and column, whether its window from there recurs in another passage (of its group) at the same column.

    Passages stand side by side with their anchors in one column. Each round inserts the next column's symbol of
    every passage, from right to left: the order of the suffixes from that column follows from the order of
    the last one by a stable counting sort on the symbol (the Burrows-Wheeler last-to-first step), and the common
    prefix of neighbours is one more than the least common prefix between their places before, or none if their symbols differ. A
    passage enters at its own last column and leaves after its first. A window recurs if the common prefix with a
    neighbour is `length` or more. The state is one order and one array of prefixes, passed over once a round.
    """
    tail = np.array([len(p) for p in passage]) - lead
    left, right = int(lead.max()), int(tail.max())
    x = np.zeros((len(passage), left + right), np.uint8)
    for i, p in enumerate(passage):
        x[i, left - lead[i] : left + tail[i]] = np.frombuffer(p, np.uint8)
    columns = np.ascontiguousarray(x.T)
    entering = {int(c): np.flatnonzero(tail == c) for c in np.unique(tail)}
    order, prefix = np.zeros(0, np.int64), np.zeros(0, np.int16)
    found = np.zeros((len(passage), left + right), bool)
    for c in range(right - 1, -left - 1, -1):
        if (new := entering.get(c + 1)) is not None:
            prefix = np.concatenate([np.zeros(len(new), np.int16), prefix])
            prefix[len(new) : len(new) + 1] = 0
            order = np.concatenate([new, order])
        there = np.flatnonzero(lead[order] >= -c)
        symbol = columns[c + left][order]
        if group is not None:
            symbol = group[order] * 256 + symbol
        to = there[np.argsort(symbol[there], kind="stable")]
        if not len(to):
            break
        symbol = symbol[to]
        same = np.flatnonzero(symbol[1:] == symbol[:-1])
        after = np.zeros(len(to), np.int16)
        after[same + 1] = 1 + _range_min(prefix, to[same] + 1, to[same + 1])
        order, prefix = order[to], after
        again = np.flatnonzero(prefix >= length)
        if len(again):
            found[order[again], c + left] = True
            found[order[again - 1], c + left] = True
    return found


def _recurring(wanted: DataFrame, length: int, gram: int, block: int) -> DataFrame:
    """doc, first, last: windows of passages that occur once, but share windows with other passages of their anchor.

    wanted: anchor, n, doc, first, lead, passage. The windows of an anchor lie in columns gram - length to 0, and two
    passages that share a window in some columns share the bytes that all windows from these columns have: for all
    columns, the anchor. A group of more than `block` passages is split by halving its columns: for each half, its passages are
    grouped by the bytes that they must share. Groups of `block` or fewer go to the column-wise construction,
    and one column's group is equal windows. So a passage is sent at most twice a level, and no two blocks need be held
    against each other, however many different passages an anchor has.
    """
    level = wanted.select(F.col("anchor").alias("key"), F.lit(gram - length).alias("low"), F.lit(0).alias("high"), "n", "doc", "first", "lead", "passage")
    found, width = [], length - gram + 1
    while True:
        level = stash(level)
        counts = stash(level.groupBy("key").agg(F.count("*").alias("_m"), F.min("n").alias("_least")).where("_m > 1 AND _least = 1").select(F.col("key").alias("_key"), "_m"))
        met = level.join(counts, F.col("key") == F.col("_key"))
        if width == 1:
            found.append(met.where("n = 1").select("doc", (F.col("first") + F.col("lead") + F.col("low")).alias("first"), (F.col("first") + F.col("lead") + F.col("low")).alias("last")))
            break
        found.append(_solved(met.where(F.col("_m") <= block).drop("_key", "_m"), length))
        if not counts.where(F.col("_m") > block).limit(1).count():
            break
        level, width = _halved(met.where(F.col("_m") > block).drop("_key", "_m"), length), (width + 1) // 2
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def _halved(rows: DataFrame, length: int) -> DataFrame:
    """Rows cut to either half of their columns, with the hash of the bytes that windows from all of these columns share as key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                begin, end = -r["lead"], len(r["passage"]) - r["lead"] - length  # its columns
                middle = (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                    if low > high or high < begin or low > end:
                        continue
                    shared = r["passage"][high + r["lead"] : low + length + r["lead"]]
                    key = int.from_bytes(hashlib.blake2b(b"%d %d %d " % (r["key"], low, high) + shared, digest_size=8).digest(), "little", signed=True)
                    a, b = max(0, low + r["lead"]), high + length + r["lead"]
                    out.append((key, low, high, r["n"], r["doc"], r["first"] + a, r["lead"] - a, r["passage"][a:b]))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["key", "low", "high", "n", "doc", "first", "lead", "passage"])

    return rows.mapInArrow(run, "key long, low int, high int, n long, doc long, first int, lead int, passage binary")


def _solved(rows: DataFrame, length: int) -> DataFrame:
    """doc, first, last of recurring windows of groups of equal key, as many of them at a time as make a batch."""
    dealt = rows.repartition("key").sortWithinPartitions("key")

    def solve(t: pa.Table) -> pa.RecordBatch:
        key, n, doc, first, lead = (t[c].to_numpy() for c in ("key", "n", "doc", "first", "lead"))
        found = repeated_windows(t["passage"].to_pylist(), lead.astype(np.int64), length, np.cumsum(np.concatenate([[0], key[1:] != key[:-1]])))
        found[n > 1] = False  # covered as a whole, elsewhere
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edge == 1)
        high = np.nonzero(edge == -1)[1] - 1
        base = first[row] + lead[row] - int(lead.max())
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array((base + low).astype(np.int32)), pa.array((base + high).astype(np.int32))], ["doc", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size < 1 << 22:
                continue
            t = pa.concat_tables(held).combine_chunks()
            key = t["key"].to_numpy()
            at = int(np.argmax(key == key[-1]))  # the last group may go on
            if at:
                yield solve(t.slice(0, at))
            held, size = [t.slice(at)], t.slice(at).nbytes
        if held and sum(map(len, held)):
            yield solve(pa.concat_tables(held).combine_chunks())

    return dealt.mapInArrow(run, "doc long, first int, last int")


def repeated(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc and spans (array of first and last start of windows that also start elsewhere) of (doc, text) rows.

    1. Passages whose anchor hash occurs once hold no repeat. That is a combined count by anchor.
    2. If all passages of an anchor are equal, each is repeated as a whole; so is any passage with an equal one.
    3. For other anchors, one copy of each different passage goes to the column-wise construction, which finds the
       windows that they share.
    """
    runs = anchored(texts, length, gram)
    counts = runs.select("anchor", "content").groupBy("anchor").agg(F.count("*").alias("_n"), F.min("content").alias("_lo"), F.max("content").alias("_hi")).where("_n > 1").select(F.col("anchor").alias("_anchor"), (F.col("_lo") == F.col("_hi")).alias("whole"))
    counts = stash(counts)  # so that the rows of a frequent anchor can be split in the join
    shared = runs.join(counts, F.col("anchor") == F.col("_anchor"))
    shared = stash(shared.select(F.when(~F.col("whole"), F.col("anchor")).alias("anchor"), F.when(~F.col("whole"), F.col("content")).alias("content"), "doc", "first", "last", F.when(~F.col("whole"), F.col("lead")).alias("lead"), "whole"))
    mixed = shared.where("not whole")
    kinds = mixed.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc", "first", "last", "lead")).alias("one"))
    kinds = stash(kinds)
    # the copies of a passage are spread by a hash of their place, and its row meets them in as many tasks
    many = kinds.where("n > 1").select(F.col("anchor").alias("_a"), F.col("content").alias("_c"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    salted = mixed.withColumn("_salt", F.pmod(F.xxhash64("doc", "first"), F.lit(SALTS)).cast("int"))
    copied = salted.join(many, (F.col("anchor") == F.col("_a")) & (F.col("content") == F.col("_c")) & (F.col("_salt") == F.col("_s")))
    open_ = kinds.groupBy("anchor").agg(F.min("n").alias("_least")).where("_least = 1").select(F.col("anchor").alias("_a"))
    wanted = kinds.join(open_, F.col("anchor") == F.col("_a")).select("anchor", "content", "n", "one.*")
    per_doc = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "content", "n", "first", "last", "lead")).alias("passages"))
    once = texts.join(per_doc.withColumnRenamed("doc", "_doc"), F.col("doc") == F.col("_doc")).groupBy("doc").agg(F.first("text").alias("text"), F.first("passages").alias("passages"))
    found = _recurring(_cut_out(once, length), length, gram, block)
    every = shared.where("whole").select("doc", "first", "last").unionByName(copied.select("doc", "first", "last")).unionByName(found)
    return every.groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def _cut_out(rows: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, out = batch.slice(at, 128), []
                for doc, text, cuts in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    out += [(c["anchor"], c["content"], c["n"], doc, c["first"], c["lead"], text[c["first"] : c["last"] + length]) for c in cuts]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["anchor", "content", "n", "doc", "first", "lead", "passage"])

    return rows.mapInArrow(run, "anchor long, content long, n long, doc long, first int, lead int, passage binary")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, with_kept: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, and with_kept: kept (binary) and removed (array of start, end).

    Every byte of the UTF-8 text that a `length`-byte string covers which also starts elsewhere, in this or another
    document, is removed. Matches never cross documents and are judged on the input. Null text: empty. Shorter texts
    lose nothing. Each row is a document of its own, also where its id is null or repeated. Places are 32 bits wide, as Spark's
    strings are of less than 2 GB; long texts are hashed in pieces. Empty table: no rows.
    """
    # rows are joined by a hash of id and text: rows equal in both lose the same bytes
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), text_col).alias("doc"), F.col(text_col).alias("text"))
    spans = repeated(texts.select("doc", "text"), length, gram, block).withColumnRenamed("doc", "_doc")
    rows = texts.join(spans, F.col("doc") == F.col("_doc"), "left").select(F.col("id").alias("doc"), "text", "spans")
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "removed"][: 7 if with_kept else 5]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                lists = part.column(2)
                flat, ends = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
                first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy() + length
                for i, (doc, text) in enumerate(zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True)):
                    text, f, e = text or b"", first[ends[i] : ends[i + 1]], last[ends[i] : ends[i + 1]]
                    order = np.argsort(f, kind="stable")
                    f, e = f[order], np.maximum.accumulate(e[order]) if len(f) else e
                    new = np.concatenate([[True], f[1:] > e[:-1]]) if len(f) else np.zeros(0, bool)
                    begin, end = f[new].tolist(), np.minimum(e[np.append(new[1:], True)] if len(f) else e, len(text)).tolist()
                    kept = b"".join(text[a:b] for a, b in zip([0, *end], [*begin, len(text)], strict=True))
                    out.append((doc, len(text), len(text) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), kept, [{"start": a, "end": b} for a, b in zip(begin, end, strict=True)])[: len(names)])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names)

    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<struct<start:long,end:long>>" * with_kept
    return rows.mapInArrow(run, schema).withColumnRenamed("doc", id_col)

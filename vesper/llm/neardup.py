"""Near-duplicate documents by an inverted join of MinHash coordinates, confirmed on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, stash
from .components import components, local_components

#: Coordinates of a signature, how many must collide for similarity 0.85, and the probability that a pair of the least similarity has fewer.
COORDINATES, MATCHES, MISS = 32, 17, 4e-6
#: Rows of a block of signatures, and of whole sets; and bytes of a block of sets.
SIGN_BLOCK, SET_BLOCK, SET_BYTES = 64, 64, 1 << 24
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = np.random.default_rng(20240229).integers(1, 1 << 63, (2, COORDINATES), dtype=np.uint64)
_SEEDS[0] |= np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], n: int = 3) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the n-word shingles of each text, A-Z lower-cased.

    A text of fewer words has its whole sequence as its one shingle; without words, none.
    """
    out = []
    for text in texts:
        raw = np.frombuffer(text, np.uint8)
        inside = ~_IS_SPACE[raw]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            out.append(np.zeros(0, np.uint64))
            continue
        raw, lengths = _LOWER[raw[inside]].astype(np.uint64), ends - starts
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        place = (np.arange(len(raw)) - np.repeat(first, lengths)).astype(np.uint64)
        word = _mix(np.add.reduceat(_mix((place << np.uint64(8)) + raw + _A), first) + lengths.astype(np.uint64))
        width = min(n, len(word))
        shingle = np.full(len(word) - width + 1, np.uint64(width))
        for k in range(width):
            shingle = _mix(shingle * _A + word[k : len(word) - width + 1 + k])
        out.append(np.unique(shingle))
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The high 32 bits of the smallest value of each coordinate's permutation."""
    return ((hashes[:, None] * _SEEDS[0] + _SEEDS[1]) >> np.uint64(32)).astype(np.uint32).min(axis=0)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows that are equal in id and text have one key; others have keys of their own, also where ids are null or repeated."""
    return docs.select(F.xxhash64(F.col(id_col).cast("long"), text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def profiles(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """key (a hash of id and text), doc_id, n_shingles, two hashes of the set, and the signature (binary; empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ones, twos, signs = [], [], [], []
            for at in range(0, batch.num_rows, 256):
                texts = [t or b"" for t in batch.column(2).slice(at, 256).cast(pa.binary()).to_pylist()]
                for s in shingle_sets(texts, n):
                    sizes.append(len(s))
                    ones.append(int(_mix(s + _A).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                    twos.append(int(_mix(s * _C + _B).sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                    signs.append(np.concatenate([signature(s[i : i + 65536])[None] for i in range(0, len(s), 65536)]).min(axis=0).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(signs, pa.binary())], ["key", "doc_id", "n_shingles", "h1", "h2", "sign"])

    return _keyed(docs, id_col, text_col).select("key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, n_shingles long, h1 long, h2 long, sign binary")


def _tokens(signs: np.ndarray) -> np.ndarray:
    """A 64-bit token for each (coordinate, value) pair."""
    return _mix((np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) + signs + _A).view(np.int64)


def least_matches(percent: int) -> int:
    """The most collisions that can be asked for, so that a pair of similarity percent / 100 has fewer with a probability of at most MISS."""
    p, m, fewer = percent / 100, 0, 0.0
    while m < COORDINATES and (fewer := fewer + math.comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)) <= MISS:
        m += 1
    if not m:
        raise ValueError(f"{COORDINATES} coordinates can't find pairs of {percent} % with a miss probability of {MISS}")
    return m


def postings(classes: DataFrame, hot: dict[int, int], matches: int = MATCHES) -> DataFrame:
    """token, rep, sign for the COORDINATES - matches + 1 rarest coordinate-value pairs of each class.

    Any order that is the same for all classes will do: two signatures that agree in `matches` coordinates then share
    a posting among these, so the matches - 1 longest lists of each class are skipped and only counted in pairs found
    elsewhere.
    """
    shared = classes.sparkSession.sparkContext.broadcast((np.array(sorted(hot), np.int64), np.array([hot[k] for k in sorted(hot)], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                signs = np.frombuffer(b"".join(part.column("sign").to_pylist()), np.uint32).reshape(-1, COORDINATES)
                tokens = _tokens(signs.astype(np.uint64))
                often = np.zeros(tokens.shape, np.int64)
                if len(keys):
                    where = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
                    often = np.where(keys[where] == tokens, counts[where], 0)
                order = np.lexsort((tokens, often), axis=1)[:, : COORDINATES - matches + 1]
                rows = np.repeat(np.arange(len(tokens)), order.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(np.take_along_axis(tokens, order, 1).ravel()), part.column("rep").take(pa.array(rows))], ["token", "rep"])

    return classes.select("rep", "sign").mapInArrow(run, "token long, rep long")


def in_blocks(keys: DataFrame, rows_of: Callable[[DataFrame], DataFrame], key: str, payload: list[str], work: Callable[[np.ndarray, np.ndarray, list], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Edges (a, b) whose connected sets are those of all matches among rows of equal key, without a task for a whole large key.

    keys has a row for each member of a key: key, rep and its weight, the share of a block that it fills. rows_of() adds the
    payload to rows of keys. Keys of one row are dropped. A key is dealt to as many blocks as its members fill, by a hash of rep.
    First each block meets the first one, so that twice the rows are sent. What is connected then needs no further
    comparison: of a key with three blocks or more, the members outside its largest connected set meet all others, by
    pairs of blocks, and those inside it don't meet each other again. A key of copies of one text is so done in linear
    time, and what remains quadratic is the number of its members that aren't alike.
    """
    share = lambda w, n: F.least(F.greatest(F.lit(1), F.ceil(w)), F.greatest(F.lit(1), n)).cast("int")
    counts = keys.groupBy(key).agg(F.count("*").alias("_m"), F.sum("weight").alias("_w")).where("_m > 1")
    counts = stash(counts.select(F.col(key).alias("_key"), share(F.col("_w"), F.col("_m")).alias("_nb")))
    rows = rows_of(keys.select(key, "rep"))
    mine = F.pmod(F.xxhash64("rep"), F.col("_nb")).cast("int")
    others = F.when(F.col("_nb") == 1, F.array(F.lit(0))).when(F.col("_mine") == 0, F.sequence(F.lit(1), F.col("_nb") - 1)).otherwise(F.array("_mine"))
    dealt = rows.join(counts, F.col(key) == F.col("_key")).withColumn("_mine", mine).withColumn("hi", F.explode(others)).withColumn("lo", F.lit(0))
    edges = stash(_matches_of(dealt, key, payload, work))
    wide = counts.where("_nb > 2")
    if not wide.limit(1).count():
        return edges
    labels = components(edges).select(F.col("node").alias("_node"), "component")
    hot = keys.join(wide.select("_key"), F.col(key) == F.col("_key")).join(labels, F.col("rep") == F.col("_node"), "left")
    hot = stash(hot.select(F.col(key).alias("_hot"), F.col("rep").alias("_rep"), "weight", F.coalesce("component", "rep").alias("label")))
    sets = hot.groupBy("_hot", "label").agg(F.count("*").alias("m"), F.sum("weight").alias("w"))
    most = sets.groupBy("_hot").agg(F.max_by("label", F.struct("m", "label")).alias("_most"), F.max(F.struct("m", "label", "w")).alias("top"), F.sum("m").alias("m"), F.sum("w").alias("w")).where(F.col("m") > F.col("top.m"))
    most = stash(most.select(F.col("_hot").alias("_key"), "_most", share(F.col("top.w"), F.col("top.m")).alias("_na"), share(F.col("w") - F.col("top.w"), F.col("m") - F.col("top.m")).alias("_nb")))
    placed = hot.join(most, F.col("_hot") == F.col("_key")).withColumn("_few", F.col("label") != F.col("_most"))
    turn = F.xxhash64("_rep", F.lit(1))
    placed = placed.withColumn("_mine", F.when(F.col("_few"), F.col("_na") + F.pmod(turn, F.col("_nb"))).otherwise(F.pmod(turn, F.col("_na"))).cast("int"))
    placed = placed.withColumn("_from", F.when(F.col("_few"), 0).otherwise(F.col("_na"))).withColumn("_to", F.col("_na") + F.col("_nb") - 1).select("_hot", "_rep", "_mine", "_from", "_to")
    rest = rows_of(placed.select(F.col("_hot").alias(key), F.col("_rep").alias("rep"))).join(placed, (F.col(key) == F.col("_hot")) & (F.col("rep") == F.col("_rep")))
    rest = rest.withColumn("_other", F.explode(F.sequence("_from", "_to"))).withColumn("lo", F.least("_mine", "_other")).withColumn("hi", F.greatest("_mine", "_other"))
    return edges.unionByName(_matches_of(rest, key, payload, work))


def _matches_of(dealt: DataFrame, key: str, payload: list[str], work: Callable[[np.ndarray, np.ndarray, list], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Edges of groups of equal key, lo and hi. work(group, rep, payload) gets whole groups, as many as make a batch, and returns
    the positions of matching rows; only the edges of a spanning star of each connected set of the batch go out."""
    dealt = dealt.select(F.col(key).alias("k"), "lo", "hi", "rep", *payload).repartition("k", "lo", "hi").sortWithinPartitions("k", "lo", "hi", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def solve(t: pa.Table) -> pa.RecordBatch:
            k, lo, hi, rep = (t[c].to_numpy() for c in ("k", "lo", "hi", "rep"))
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            a, b = work(np.cumsum(new) - 1, rep, [t[c] for c in payload])
            label = local_components(len(rep), a, b)
            node = np.flatnonzero(label != np.arange(len(rep)))
            ids, ends = np.unique(np.concatenate([rep[node], rep[label[node]]]), return_inverse=True)
            label = local_components(len(ids), ends[: len(node)], ends[len(node) :])  # of all groups of the batch
            node = np.flatnonzero(label != np.arange(len(ids)))
            return pa.RecordBatch.from_arrays([pa.array(ids[node], pa.int64()), pa.array(ids[label[node]], pa.int64())], ["a", "b"])

        size = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size < 1 << 22:
                continue
            t = pa.concat_tables(held).combine_chunks()
            last = tuple(t[c][-1].as_py() for c in ("k", "lo", "hi"))
            same = np.ones(len(t), bool)
            for c, v in zip(("k", "lo", "hi"), last, strict=True):
                same &= t[c].to_numpy() == v
            at = int(np.argmax(same))  # the last group may go on
            if at:
                yield solve(t.slice(0, at))
            held, size = [t.slice(at)], t.slice(at).nbytes
        if held:
            yield solve(pa.concat_tables(held).combine_chunks())

    return dealt.mapInArrow(run, "a long, b long")


def _collide(matches: int):
    def work(group: np.ndarray, rep: np.ndarray, payload: list) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a group whose signatures agree in `matches` coordinates or more."""
        signs = np.frombuffer(b"".join(payload[0].to_pylist()), np.uint32).reshape(-1, COORDINATES)
        a, b = [], []
        for step in range(1, len(group)):
            i = np.flatnonzero(group[:-step] == group[step:])
            if not len(i):
                break
            for at in range(0, len(i), 1 << 16):
                j = i[at : at + (1 << 16)]
                hit = j[(signs[j] == signs[j + step]).sum(axis=1) >= matches]
                a.append(hit)
                b.append(hit + step)
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))

    return work


def _linked(percent: int):
    def work(group: np.ndarray, rep: np.ndarray, payload: list) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a group whose sets have 100 * intersection >= percent * union."""
        sets = [np.frombuffer(x, np.uint64) for x in payload[0].to_pylist()]
        bounds = np.concatenate([np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])), [len(group)]])
        a, b = [], []
        for at, end in zip(bounds[:-1], bounds[1:], strict=True):
            if end - at < 2:
                continue
            some = sets[at:end]
            sizes = np.array([len(s) for s in some], np.int64)
            both = np.zeros((len(some), len(some)), np.int64)
            values, column, times = np.unique(np.concatenate(some), return_inverse=True, return_counts=True)
            row = np.repeat(np.arange(len(some)), sizes)
            shared = times[column] > 1
            row, column = row[shared], column[shared]
            order = np.argsort(column, kind="stable")
            row, column = row[order], column[order]
            column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
            for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
                i, j = np.searchsorted(column, [low, low + 4096])
                m = np.zeros((len(some), 4096), np.float32)
                m[row[i:j], column[i:j] - low] = 1
                both += (m @ m.T).astype(np.int64)
            hit = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
            i, j = np.nonzero(np.triu(hit, 1))
            a.append(i + at)
            b.append(j + at)
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))

    return work


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links), kept (it is the smallest).

    Documents with equal shingle sets form a class, which goes on as one. Classes are posted under the
    coordinate-value pairs of their MinHash signature, the rarest first and only as many as least_matches(percent)
    needs; pairs met in a posting list count their collisions over the whole signature. Classes joined by enough of them
    make a family. In a family, blocks of whole shingle sets are held against each other: every pair in it is
    confirmed or refused exactly, unless other links connect it already, and the links' components are the result. Long lists and large families are cut into
    pairs of blocks, bounded in rows and bytes, and only spanning edges leave a task.

    Null text, or without words: an empty set, linked with nothing. Null and repeated ids: each row is a document of its own;
    component_id is the smallest id that isn't null, or null if all that are linked are, and is compared null-safe. Empty table: no rows. Other columns of docs are ignored.
    """
    matches = least_matches(percent)
    profile = cut(profiles(docs, id_col, text_col, n))
    classes = cut(profile.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("key").alias("rep"), F.min("doc_id").alias("least"), F.first("sign").alias("sign")))
    total = classes.count()
    if total > 1:
        tokens = _token_counts(classes, max(64, total // 1000))
        posted = postings(classes, tokens, matches)
        posted = cut(posted.join(posted.groupBy("token").count().where("count > 1").select("token"), "token"))
        signs = classes.select("rep", "sign")
        families = components(in_blocks(posted.withColumn("weight", F.lit(1 / SIGN_BLOCK)), lambda some: some.join(signs, "rep"), "token", ["sign"], _collide(matches)))
        members = families.select(F.col("node").alias("rep"), F.col("component").alias("family")).join(classes.select("rep", "n_shingles"), "rep")
        members = stash(members.select("family", "rep", (F.lit(1 / SET_BLOCK) + F.col("n_shingles") * (8 / SET_BYTES)).alias("weight")))
        texts = _keyed(docs, id_col, text_col).select(F.col("key").alias("rep"), "text")
        # whole texts meet their members by one shuffle at every size, and their sets are written once
        sets = texts.hint("merge").join(members.select("family", "rep"), "rep").groupBy("rep").agg(F.first("family").alias("family"), F.first("text").alias("text"))
        sets = stash(_sets(sets, n)).select("rep", "shingles")
        whole = lambda some: some.join(sets, "rep")
        links = components(in_blocks(members, whole, "family", ["shingles"], _linked(percent)))
        least = links.join(classes.select(F.col("rep").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("smallest"))
        links = links.join(least, "component").select("node", "smallest")
    else:
        links = classes.select(F.col("rep").alias("node"), F.col("least").alias("smallest")).limit(0)
    placed = classes.select("h1", "h2", F.col("n_shingles").alias("_n"), "rep", "least").join(links, F.col("rep") == F.col("node"), "left").select("h1", "h2", "_n", F.coalesce("smallest", "least").alias("component_id"))
    found = profile.join(placed, (profile.h1 == placed.h1) & (profile.h2 == placed.h2) & (profile.n_shingles == placed._n), "left")
    component = F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _token_counts(classes: DataFrame, least: int) -> dict[int, int]:
    """Coordinate-value pairs that at least `least` classes have. With least = classes / 1000 these are at most
    1000 * COORDINATES pairs, whatever the input; that bound lets them go to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32).reshape(-1, COORDINATES)
            token, times = np.unique(_tokens(signs.astype(np.uint64)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(times)], ["token", "n"])

    return dict(classes.select("sign").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect())


def _sets(rows: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [s.tobytes() for s in shingle_sets([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()], n)]
                yield pa.RecordBatch.from_arrays([part.column("family"), part.column("rep"), pa.array(sets, pa.binary())], ["family", "rep", "shingles"])

    return rows.select("family", "rep", "text").mapInArrow(run, "family long, rep long, shingles binary")


SQL_OP5 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(list_zip(w[1:len(w) - 2], w[2:len(w) - 1], w[3:len(w)]), lambda z: z[1] || ' ' || z[2] || ' ' || z[3]) END)) AS s FROM w),
c AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT rep, n, unnest(s) AS g FROM c),
p AS (SELECT a.rep AS l, b.rep AS r FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT l, r FROM p UNION ALL SELECT r, l FROM p),
reach(a, b) AS (SELECT rep, rep FROM c UNION SELECT reach.a, e.r FROM reach JOIN e ON reach.b = e.l),
m AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id, coalesce(m.component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m ON m.rep = c.rep
"""

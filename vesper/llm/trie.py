"""The prefix trie of conversations, by distributed most-significant-digit radix partitioning over turn ids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, running_sum, stash, text_or_empty

#: Turns of a conversation in a row, turns that a bucket may have to be finished in one task, and ids in a part of a list of ids.
CHUNK, LOCAL, PART = 64, 1 << 14, 4096
NONE = hashlib.sha256(b"").hexdigest()
NODES = "conv long, depth long, parent long, turn_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_TOPS = NODES + ", top boolean"
_KINDS = [pa.int64()] * 8 + [pa.string()]


def digest(role: Column, text: Column) -> Column:
    """What tells turns apart: 32 bytes of the role's length, the role and the text; null is empty."""
    role, text = text_or_empty(role), text_or_empty(text)
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, pos (from 0), digest, words: turns in order, null turns first, ties by digest. Texts stay where they are read.

    Rows without a conversation id belong to none. A conversation of many turns is numbered by ranges of 1024 turn numbers, each in a task of its own.
    """
    rows = conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), digest(F.col(role_col), F.col(text_col)).alias("digest"), F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("one"))
    placed = running_sum(rows, ["conv"], ["turn", "digest"], "one", "nth", F.coalesce(F.shiftright("turn", 10), F.lit(-(1 << 62))))
    return placed.select("conv", (F.col("nth") - 1).alias("pos"), "digest", "words")


def lent(rows: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows of numbered() rebuilt, and all conversations (conv): of each c, the first h turns are those of conversation c - c % every
    (all if it has fewer, none if there is none), with h = crc32(c) % most; its own follow from the h-th on."""
    convs = rows.groupBy("conv").agg(F.count("*").alias("n"))
    base = F.col("conv") - F.col("conv") % every
    lender = convs.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = convs.select("conv", base.alias("base"), F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(most)).alias("h")).join(lender, "base", "left")
    plan = stash(plan.select("conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")))
    own = rows.join(plan.select("conv", "h", "taken"), "conv").where("pos >= h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "words")
    first = rows.where((F.col("conv") % every == 0) & (F.col("pos") < most - 1)).withColumnRenamed("conv", "base")
    borrowed = first.join(plan.select("conv", "base", "taken"), "base").where("pos < taken").select("conv", "pos", "digest", "words")
    return own.unionByName(borrowed), plan.select("conv")


def dictionary(rows: DataFrame) -> DataFrame:
    """turn_id, digest, words: a number for each different turn."""
    return stash(rows.groupBy("digest").agg(F.first("words").alias("words")).select(F.monotonically_increasing_id().alias("turn_id"), "digest", "words"))


def _chunks(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """conv, chunk, ids, words, before (words of earlier chunks): CHUNK turns in a row."""
    coded = rows.select("conv", "pos", "digest").join(turns, "digest")
    parts = coded.groupBy("conv", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("pos", "turn_id", "words"))).alias("t"))
    parts = parts.select("conv", "chunk", F.col("t.turn_id").alias("ids"), F.col("t.words").alias("words"), F.aggregate("t.words", F.lit(0).cast("long"), lambda a, w: a + w).alias("sum"))
    return stash(running_sum(parts, ["conv"], ["chunk"], "sum", "upto", F.shiftright("chunk", 10)).withColumn("before", F.col("upto") - F.col("sum")).drop("upto"))


def _streamed(rows: DataFrame, key: list[str], schema: str, part: bool) -> DataFrame:
    """Runs of equal `key` in rows that lie in order. part: ids joined in parts of at most PART; else parts to a row with the digest of all ids."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, n, ids, state, out = None, 0, 0, [], None, []

        def close() -> None:
            if own is not None:
                out.append((*own, first, n, b",".join(ids)) if part else (*own, first, n, state.hexdigest()))

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                k, value = row[: len(key)], row[len(key)]
                if k != own or (part and n == PART):
                    close()
                    own, first, n, ids, state = k, value, 0, [], None if part else hashlib.sha256()
                if part:
                    n += 1
                    ids.append(b"%d" % value)
                else:
                    state.update(b"," * (n > 0) + row[-1])
                    n += row[len(key) + 1]
                if len(out) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return rows.mapInArrow(run, schema)


def _classes(chunks: DataFrame, convs: DataFrame) -> DataFrame:
    """cls (smallest conversation), n, len, total (words), ends (digest of the ids, joined in order) of each different sequence.

    Ids are ordered by ranges, joined in parts where they lie, and only these parts meet for the digest, which streams over them.
    """
    key = ["len", "s1", "s2", "total"]
    known = chunks.groupBy("conv").agg(F.sum(F.size("ids").cast("long")).alias("len"), F.bit_xor(F.xxhash64(F.lit(1), "chunk", "ids")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(2), "ids", "chunk")).alias("s2"), F.sum("sum").alias("total"))
    every = convs.join(known, "conv", "left").select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in key], "conv")
    fields = ", ".join(f"{k} long" for k in key)
    parts = _streamed(every.repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv"), key, f"{fields}, first long, n long, ids binary", True)
    whole = _streamed(parts.repartition(*key).sortWithinPartitions(*key, "first"), key, f"{fields}, cls long, n long, ends string", False)
    return stash(whole.select("cls", "n", "len", "total", "ends"))


def multikey(ids: list[list[int]], words: list[list[int]], convs: list[int], counts: list[int], ends: list[str]) -> list[list]:
    """Nodes of different sequences: [conv, depth, parent's number, turn id, n, children, leaves, saved, ends]; the first is their common start.

    Multikey quicksort: sequences are parted by one id into less, equal and greater; less and greater go on at the same place, equal
    ones are a node and go on at the next. What is open stands on a stack of our own, however deep.
    """
    nodes = [[min(convs), 0, None, None, sum(counts), 0, 0, 0, NONE]]
    open_ = [(list(range(len(ids))), 0, 0)]
    own = [0]
    while open_:
        part, at, up = open_.pop()
        middle = ids[part[len(part) // 2]]
        pivot = middle[at] if at < len(middle) else None
        equal, less, greater = [], [], []
        for i in part:
            s = ids[i]
            x = s[at] if at < len(s) else None
            if x == pivot:
                equal.append(i)
            elif x is None or (pivot is not None and x < pivot):
                less.append(i)
            else:
                greater.append(i)
        open_ += [(p, at, up) for p in (less, greater) if p]
        if pivot is None:
            nodes[up][8] = ends[equal[0]]
            continue
        n = sum(counts[i] for i in equal)
        nodes.append([min(convs[i] for i in equal), at + 1, up, pivot, n, 0, 0, 0, NONE])
        own.append((n - 1) * words[equal[0]][at])
        open_.append((equal, at + 1, len(nodes) - 1))
    for i in range(len(nodes) - 1, -1, -1):
        node = nodes[i]
        node[6] = node[6] or 1
        node[7] += own[i]
        if i:
            up = nodes[node[2]]
            up[5], up[6], up[7] = up[5] + 1, up[6] + node[6], up[7] + node[7]
    return nodes


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)), pa.array([r[9] for r in rows], pa.bool_())], [f.split()[0] for f in _TOPS.split(", ")])


def _finished(live: DataFrame, chunks: DataFrame) -> DataFrame:
    """Nodes of buckets that are small enough for a task."""
    here = F.greatest(F.lit(0), F.col("d") - F.col("chunk") * CHUNK).cast("int")
    part = chunks.select(F.col("conv").alias("_c"), "chunk", "ids", "words").hint("merge")
    rest = live.join(part, (F.col("cls") == F.col("_c")) & ((F.col("chunk") + 1) * CHUNK > F.col("d")), "left")
    cut = lambda c: F.coalesce(F.slice(c, here + 1, F.lit(CHUNK)), F.array().cast("array<long>")).alias(c)
    rest = rest.select("d", "b", "cls", "n", "ends", "parent", "turn_id", "own", F.coalesce("chunk", F.lit(0)).alias("chunk"), cut("ids"), cut("words"))

    def solve(rows: list[tuple]) -> Iterator[tuple]:
        ids, words, convs, counts, ends = [], [], [], [], []
        for r in rows:
            if not convs or convs[-1] != r[2]:
                convs.append(r[2])
                counts.append(r[3])
                ends.append(r[4])
                ids.append([])
                words.append([])
            ids[-1] += r[9]
            words[-1] += r[10]
        d, parent, turn, own = rows[0][0], *rows[0][5:8]
        nodes = multikey(ids, words, convs, counts, ends)
        for i, (conv, depth, up, turn_id, n, children, leaves, saved, end) in enumerate(nodes):
            if i:
                yield conv, d + depth, nodes[up][0], turn_id, n, children, leaves, saved, end, False
            else:
                yield conv, d, parent, turn, n, children, leaves, saved + (n - 1) * own, end, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:2] != row[:2]:
                    out += solve(held)
                    held = []
                    if len(out) > 8192:
                        yield _emit(out)
                        out = []
                held.append(row)
        if held:
            out += solve(held)
        if out:
            yield _emit(out)

    return rest.repartition("d", "b").sortWithinPartitions("d", "b", "cls", "chunk").mapInArrow(run, _TOPS)


def _alone(live: DataFrame, chunks: DataFrame) -> DataFrame:
    """Nodes of buckets of one sequence: a chain, made of each chunk by itself."""
    n1, ended = F.col("n") - 1, F.col("len") == F.col("d")
    tops = live.select(F.col("cls").alias("conv"), F.col("d").alias("depth"), "parent", "turn_id", F.col("n").alias("n_convs"), F.when(ended, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), (n1 * (F.col("own") + F.col("total") - F.col("done"))).alias("saved_tokens"), F.when(ended, F.col("ends")).otherwise(NONE).alias("ends_sha256"), F.lit(True).alias("top"))
    rest = live.join(chunks.withColumnRenamed("conv", "cls").drop("sum").hint("merge"), "cls").where(F.col("chunk") * CHUNK + F.size("ids") > F.col("d")).select("cls", "n", "len", "total", "ends", "d", "chunk", "ids", "words", "before")

    width = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cls, n, length, total, ends, d, chunk, ids, words, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for pos, (turn, w) in enumerate(zip(ids, words, strict=True), chunk * width):
                    if pos >= d:
                        last = pos + 1 == length
                        out.append((cls, pos + 1, cls, turn, n, int(not last), 1, (n - 1) * (total - before), ends if last else NONE, False))
                    before += w
                if len(out) > 8192:
                    yield _emit(out)
                    out = []
            if out:
                yield _emit(out)

    return tops.unionByName(rest.mapInArrow(run, _TOPS))


def _split(wide: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One round over buckets that are too large for a task: their next sequences, and the path that all of a bucket share.

    A bucket's least and greatest sequences have the common prefix of all, within the chunk of its depth: these nodes are passed at once. After
    them sequences end or part by their next id. Paths: d, b, ids, words, ended (digest of the ids that end there).
    """
    here = F.col("d") % CHUNK
    part = chunks.select(F.col("conv").alias("_c"), "chunk", "ids", "words").hint("merge")
    rows = wide.join(part, (F.col("cls") == F.col("_c")) & (F.floor(F.col("d") / CHUNK) == F.col("chunk")), "left")
    cut = lambda c: F.coalesce(F.slice(c, (here + 1).cast("int"), F.lit(CHUNK)), F.array().cast("array<long>")).alias(c)
    rows = stash(rows.select("cls", "n", "len", "total", "ends", "d", "b", "done", cut("ids"), cut("words")))
    ends = rows.groupBy("d", "b").agg(F.min(F.struct("ids", "words")).alias("lo"), F.max("ids").alias("hi"))
    apart = F.array_position(F.zip_with("lo.ids", "hi", lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    common = F.when(apart == 0, F.size("lo.ids")).otherwise(apart - 1)
    # a path that reaches the end of the chunk leaves its last turn to the next round, where the next chunk is read
    common = F.when((common > 0) & ((F.col("d") + common) % CHUNK == 0), common - 1).otherwise(common).cast("int")
    shared = ends.select("d", "b", common.alias("skip"), F.slice("lo.ids", F.lit(1), common).alias("path"), F.slice("lo.words", F.lit(1), common).alias("path_words"))
    rows = rows.join(shared, ["d", "b"]).withColumn("turn_id", F.get("ids", F.col("skip"))).withColumn("own", F.get("words", F.col("skip")))
    rows = stash(rows.withColumn("done", F.col("done") + F.aggregate("path_words", F.lit(0).cast("long"), lambda a, w: a + w) + F.coalesce("own", F.lit(0))))
    paths = rows.groupBy("d", "b").agg(F.first("path").alias("ids"), F.first("path_words").alias("words"), F.max(F.when(F.col("turn_id").isNull(), F.col("ends"))).alias("ended"))
    on = rows.where("turn_id IS NOT NULL").select("cls", "n", "len", "total", "ends", "done", "turn_id", "own", F.col("d").alias("up_d"), F.col("b").alias("parent"), (F.col("d") + F.col("skip") + 1).alias("d"))
    return on, stash(paths)


def _bucketed(rows: DataFrame, local: int) -> DataFrame:
    """rows with b, the smallest sequence of their bucket (sequences of one parent and turn), its size class and n_convs."""
    key = ["up_d", "parent", "turn_id"]
    sizes = rows.groupBy(*key).agg(F.min("cls").alias("b"), F.count("*").alias("m"), F.sum(F.col("len") - F.col("d")).alias("rest"), F.sum("n").alias("n_convs"))
    kind = F.when(F.col("m") == 1, "alone").when(F.col("rest") <= local, "local").otherwise("wide")
    sizes = sizes.select(*[F.col(k).alias(f"_{k}") for k in key], "b", kind.alias("kind"), "n_convs")
    return stash(rows.join(sizes, (F.col("up_d") == F.col("_up_d")) & (F.col("parent") == F.col("_parent")) & (F.col("turn_id") == F.col("_turn_id"))).drop(*[f"_{k}" for k in key]))


def _kind(sequences: int, rest: int, local: int) -> str:
    return "alone" if sequences == 1 else "local" if rest <= local else "wide"


def trie(rows: DataFrame, convs: DataFrame, local: int = LOCAL) -> tuple[DataFrame, DataFrame]:
    """Nodes and dictionary() of conversations.

    rows: conv, pos (0, 1, ...), digest, words. convs: conv, all conversations, those without turns included. A node is a different sequence of first turns; its
    members are the conversations that start with it. Nodes: conv (smallest member), depth, parent (its conv), turn_id (its last turn), n_convs, n_children,
    n_leaves and saved_tokens (of its subtree: (n_convs - 1) x words of the last turn), ends_sha256 (of the ids of members with no more turns,
    ascending, joined by commas). The root has depth 0 and null parent and turn. No conversations: no nodes.

    Equal sequences are one, with their number, from the start. Buckets of sequences with one start are parted by the next turn's id, round by round,
    until they have `local` turns or fewer; these are finished by a task each, and single sequences where their chunks lie. A round passes all turns
    that a bucket's sequences share within their chunk. Sums over subtrees go back up by round.
    """
    turns = dictionary(rows)
    chunks = _chunks(rows, turns)
    classes = _classes(chunks, convs)
    root = classes.agg(F.min("cls").alias("b"), F.count("*").alias("m"), F.sum("len").alias("rest"), F.sum("n").alias("n_convs")).first()
    whole = {"done": 0, "turn_id": None, "own": 0, "up_d": None, "parent": None, "d": 0, "b": root["b"], "n_convs": root["n_convs"]}
    level = classes.withColumns({k: F.lit(v).cast("long") for k, v in whole.items()}).withColumn("kind", F.lit(_kind(root["m"], root["rest"] or 0, local)))
    rounds = []
    while True:
        single, small = level.where("kind = 'alone'"), level.where("kind = 'local'")
        done = stash(_alone(single, chunks).unionByName(_finished(small, chunks)))
        wide = level.where("kind = 'wide'")
        heads = stash(wide.groupBy("d", "b").agg(*[F.first(c).alias(c) for c in ("parent", "turn_id", "own", "n_convs", "up_d")]))
        # where each finished bucket hangs
        hung = level.where("kind <> 'wide'").groupBy("d", "b").agg(F.first("up_d").alias("up_d"))
        if not heads.limit(1).count():
            rounds.append((done, hung, None))
            break
        on, paths = _split(wide, chunks)
        rounds.append((done, hung, heads.join(paths, ["d", "b"])))
        level = _bucketed(on, local)
    below, out = None, None
    for done, hung, heads in reversed(rounds):
        tops = done.where("top").select(F.col("conv").alias("b"), F.col("depth").alias("d"), "parent", "n_leaves", "saved_tokens").join(hung, ["d", "b"])
        if heads is not None:
            sums = below.groupBy("up_d", "parent").agg(F.count("*").alias("k"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            sums = sums.select(F.col("up_d").alias("_d"), F.col("parent").alias("_b"), "k", "leaves", "saved")
            upper = stash(_upper(heads.join(sums, (F.col("d") == F.col("_d")) & (F.col("b") == F.col("_b")))))
            done = done.unionByName(upper.select(*done.columns))
            tops = tops.unionByName(upper.where("top").select(F.col("conv").alias("b"), F.col("depth").alias("d"), "parent", "n_leaves", "saved_tokens", "up_d"))
        below = tops
        out = done if out is None else out.unionByName(done)
    return out.drop("top"), turns


def _upper(heads: DataFrame) -> DataFrame:
    """The top node of each bucket that was split and the path below it, with what hangs below the path's end."""
    n, steps = F.col("n_convs"), F.size("ids")
    after = lambda j: F.aggregate(F.slice("words", j + 1, F.lit(CHUNK)), F.lit(0).cast("long"), lambda a, w: a + w)
    rows = heads.withColumn("j", F.explode(F.sequence(F.lit(0), steps)))
    top, last = F.col("j") == 0, F.col("j") == steps
    own = F.when(top, F.col("own")).otherwise(F.get("words", F.col("j") - 1))
    return rows.select(
        F.col("b").alias("conv"), (F.col("d") + F.col("j")).alias("depth"), F.when(top, F.col("parent")).otherwise(F.col("b")).alias("parent"),
        F.when(top, F.col("turn_id")).otherwise(F.get("ids", F.col("j") - 1)).alias("turn_id"), n.alias("n_convs"), F.when(last, F.col("k")).otherwise(1).alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") + (n - 1) * (own + after(F.col("j")))).alias("saved_tokens"), F.when(last, F.coalesce("ended", F.lit(NONE))).otherwise(NONE).alias("ends_sha256"), top.alias("top"), "up_d",
    )


SQL_OP12 = """WITH RECURSIVE t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT DISTINCT c, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS bytes FROM t),
crc AS (SELECT c, bytes, 1 AS i, 0 AS bit, 4294967295::BIGINT AS v FROM b
  UNION ALL SELECT c, bytes, i + (bit = 8)::INT, (bit + 1) % 9, CASE WHEN bit = 0 THEN xor(v, bytes[i]) WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM crc WHERE i <= len(bytes)),
h AS (SELECT c, c - c % 20 AS base, xor(v, 4294967295) % 4 AS h FROM crc WHERE i > len(bytes)),
r AS (SELECT h.c, t.pos, g, w FROM h JOIN t ON t.c = h.base AND t.pos < h.h
  UNION ALL SELECT t.c, t.pos + 1000000000, g, w FROM h JOIN t ON t.c = h.c AND t.pos >= h.h),
p AS (SELECT c, row_number() OVER q AS d, string_agg(g, '') OVER q AS k, w FROM r WINDOW q AS (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT c, 0, '', 0 FROM h),
l AS (SELECT c, max(d) AS len FROM p GROUP BY c),
n AS (SELECT d, k, min(c) AS conv, count(*) AS n, any_value(w) AS w, sha256(coalesce(string_agg(CASE WHEN d = len THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends, max(len) AS deepest FROM p JOIN l USING (c) GROUP BY d, k),
u AS (SELECT a.d, a.k, count(*) FILTER (WHERE n.d = a.d + 1) AS kids, count(*) FILTER (WHERE n.deepest = n.d) AS leaves, sum((n.n - 1) * n.w) AS saved FROM n JOIN p a ON a.c = n.conv AND a.d <= n.d GROUP BY a.d, a.k)
SELECT n.conv AS conv_id, n.d AS depth, up.conv AS parent_conv_id, n.n AS n_convs, kids AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN u ON u.d = n.d AND u.k = n.k LEFT JOIN p x ON x.c = n.conv AND x.d = n.d - 1 LEFT JOIN n up ON up.d = x.d AND up.k = x.k"""

"""Tokenising documents and best-fit packing planned on the histogram of lengths."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pow2

#: Words of the cache, and the most characters that a word in it has.
CACHE, LONGEST = 1_000_000, 64
#: Bytes of the texts that are looked up together, words whose ids are fetched, and words that are encoded, together.
TOGETHER, FETCHED, LEARNED = 1 << 24, 1 << 18, 1 << 15
#: Latin letters whose lower case is a letter (U+0130 is left out), and ASCII marks (but the apostrophe) after them.
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Token ids of whole texts, with a cache of words.

    For tokenizers that ignore case, drop white space and split at it and between letters and punctuation, so that
    a text's ids are its words' ids in order, and a word's are those of its lower-case letters, then those of the marks at its
    end. Only marks after Latin letters are split off: others may lower-case to letters with a combining
    mark, which takes the mark with it. Texts are split at ASCII white space and each batch's words numbered by Arrow, so that
    Python sees a word once for each batch; ids lie in one array, and those of a batch are fetched from it by their places.
    The cache is emptied when it passes CACHE words, and words of more than LONGEST
    characters aren't kept beyond their texts, which bounds a worker's memory.

    Where each piece of a word ends with a token that has the vocabulary's end-of-word suffix, new words of letters are
    encoded as one text and cut at those tokens. Each word has one such token at least, so as many as words means one each;
    if there are more, the words are halved, and at last encoded one by one.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder, self.stage = Tokenizer.from_file(path), None
        suffix = getattr(self.encoder.model, "end_of_word_suffix", None)
        vocabulary = self.encoder.get_vocab()
        last = [i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        # every byte must have a token at the end of a word: else a word could go without one
        if sum(len(t) == 1 + len(suffix or "") for t in vocabulary if suffix and t.endswith(suffix)) >= 256:
            self.ends[last] = True
        self._clear()

    def _clear(self) -> None:
        """An empty cache: words' numbers, where each number's ids start and how many they are, and all ids."""
        self.cache: dict[str, int] = {}
        self.starts, self.sizes, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, "<u4")
        self.n_ids = 0

    def begin(self, stage: object) -> None:
        """Empties the cache when another stage begins: tasks of one stage share it, and no stage finds words of an earlier one."""
        if stage != self.stage:
            self._clear()
            self.stage = stage

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, and how many each has."""
        found = [e.ids for e in self.encoder.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def _encode_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _encode(), for words of letters."""
        ids = np.array(self.encoder.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(words) and stops[-1] == len(ids):
            return ids, np.diff(stops, prepend=0)
        if len(words) <= 64:
            return self._encode(words)
        half = len(words) // 2
        parts = self._encode_letters(words[:half]), self._encode_letters(words[half:])
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, n_ids = len(self.cache), self.n_ids
        self.cache.update(zip(words, range(n, n + len(words)), strict=True))
        self.starts, self.sizes = (np.resize(x, max(len(x), 2 * (n + len(words)))) if n + len(words) > len(x) else x for x in (self.starts, self.sizes))
        if n_ids + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (n_ids + len(ids)))
        self.starts[n : n + len(words)], self.sizes[n : n + len(words)] = n_ids + np.cumsum(sizes) - sizes, sizes
        self.ids[n_ids : n_ids + len(ids)] = ids
        self.n_ids += len(ids)

    def _fetch(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words in a row, and how many each has."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[numbers] - ends + sizes, sizes)
        places += np.arange(len(places))
        return self.ids[places], sizes

    def _learn(self, new: list[str]) -> None:
        """Adds words that aren't in the cache, which are all different."""
        cache, letters, others = self.cache, [], []
        marked, cores, marks = [], [], []
        for w in new:
            m = _WORD.fullmatch(w)
            if m is None:
                (letters if w.isalpha() else others).append(w)
                continue
            core = m[1].lower()
            if core == w:
                letters.append(w)
            else:
                marked.append(w)
                cores.append(core)
                marks.append(m[2])
        letters += set(cores).difference(cache, letters)
        others += set(marks).difference(cache, others)
        for encode, part in ((self._encode_letters, letters), (self._encode, others)):
            for at in range(0, len(part), LEARNED):
                some = part[at : at + LEARNED]
                self._add(some, *encode(some))
        if marked:
            pairs = np.stack([np.fromiter(map(cache.__getitem__, x), np.int64, len(x)) for x in (cores, marks)], axis=1)
            ids, sizes = self._fetch(pairs.ravel())
            self._add(marked, ids, sizes.reshape(-1, 2).sum(axis=1))

    def _numbers(self, words: list[str], keep: bool) -> np.ndarray:
        """The numbers of different words; those that are new are learned."""
        look = lambda: np.fromiter(map(self.cache.get, words, repeat(-1)), np.int64, len(words))
        numbers = look()
        new = [words[i] for i in np.flatnonzero(numbers < 0).tolist()]
        if keep and len(self.cache) + 2 * len(new) > CACHE:
            self._clear()
            new = words
        if new:
            self._learn(new)
            numbers = look()
        return numbers

    def _group(self, texts: pa.Array) -> Iterator[np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary
        is_long = pc.greater(pc.utf8_length(words), LONGEST).to_numpy(zero_copy_only=False)
        numbers = np.empty(len(words), np.int64)
        numbers[~is_long] = self._numbers(words.filter(pa.array(~is_long)).to_pylist(), True)
        kept, kept_ids = len(self.cache), self.n_ids
        if is_long.any():
            numbers[is_long] = self._numbers(words.filter(pa.array(is_long)).to_pylist(), False)
        parts = [self._fetch(numbers[codes[at : at + FETCHED]]) for at in range(0, len(codes), FETCHED)]
        while len(self.cache) > kept:
            self.cache.popitem()
        self.n_ids = kept_ids
        ids = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, "<u4")
        ends = np.concatenate([[0], *(p[1] for p in parts)]).cumsum()
        stops = ends[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        for a, b in pairwise(stops):
            yield ids[a:b]

    def arrays(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (null: none), as unsigned 32-bit numbers."""
        texts = pc.fill_null(texts, "")
        sizes, at = pc.binary_length(texts).to_numpy().cumsum(), 0
        while at < len(texts):
            start = at
            at = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + TOGETHER, side="right")))
            yield from self._group(texts.slice(start, at - start))

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian uint32 bytes."""
        return (ids.tobytes() for ids in self.arrays(pa.array(texts, pa.string())))


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One for each Python worker, so that its tasks share the tokenizer and, within a stage, the cache."""
    return WordTokens(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, on demand, ids: each text's tokens and end_id, cut at `limit` tokens.

    Null or empty text: the single token end_id. Only documents of more than `limit` tokens are cut.
    """
    path = path or tokenizer_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step, end = word_tokens(path), 4 * limit, np.array([end_id], "<u4").tobytes()
        task = TaskContext.get()
        encode.begin(task and task.stageId())
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                out = []
                for i, tokens in zip(part.column(0).to_pylist(), encode.arrays(part.column(1)), strict=True):
                    data = memoryview(tokens.tobytes() + end)
                    for k, p in enumerate(range(0, len(data), step)):
                        chunk = data[p : p + step]
                        out.append((i, k, p // 4, len(chunk) // 4, zlib.crc32(chunk), *([bytes(chunk)] if with_ids else [])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, first sequence, pieces a sequence, offset there).

    Sequences with equal content are one class (room left, first sequence, number of sequences). A length's pieces
    go to the fullest class with room for them, as many to each of its sequences as fit; a class that isn't used up
    is split in two or three. The work and the plan depend on the number of lengths (at most `limit`), not on
    the number of pieces.
    """
    classes: list[tuple[int, int, int]] = []
    rows, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(classes, (length, -1, -1))
            if at == len(classes):
                per = limit // length
                insort(classes, (limit, sequences, -(-left // per)))
                sequences += -(-left // per)
                continue
            room, first, n = classes.pop(at)
            per = room // length
            whole, over = divmod(left, per) if left < n * per else (n, 0)
            rows.append((length, rank, first, per, limit - room))
            rank, left = rank + min(left, n * per), left - min(left, n * per)
            for r, f, c in ((room - per * length, first, whole), (room - over * length, first + whole, int(over > 0)), (room, first + whole + int(over > 0), n - whole - int(over > 0))):
                if c and r:
                    insort(classes, (r, f, c))
    return rows


def pack(cut_pieces: DataFrame, limit: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to the rows of pieces().

    The histogram of lengths, at most `limit` rows, goes to the driver, and so does nothing else; the plan goes
    back with the tasks. Each piece gets its rank among those of its length (counts by hash bucket, then a rank
    within the bucket, so that a length that a third of all pieces share is spread), and takes the slot planned
    for that rank. Pieces that are equal in every column take different slots. Empty table: no rows.
    """
    rows = cut(cut_pieces)
    histogram = dict(rows.groupBy("length").count().collect())
    planned = plan(histogram, limit)
    keys = np.array([(length << 40) + rank for length, rank, *_ in planned], np.int64)
    order = np.argsort(keys)
    keys, table = keys[order], np.array(planned, np.int64).reshape(-1, 5)[order]
    buckets = pow2(sum(histogram.values()) / 256, 16, 1 << 20)
    hashed = rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = hashed.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")
    ranked = hashed.withColumn("_r", F.row_number().over(within)).join(counts, ["length", "_b"]).withColumn("_rank", F.col("_before") + F.col("_r") - 1).drop("_b", "_r", "_before")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            at = np.searchsorted(keys, (length << 40) + rank, side="right") - 1
            _, first, sequence, per, offset = table[at].T
            k = rank - first
            new = {"sequence_id": sequence + k // per, "offset": offset + k % per * length}
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(v, pa.int64()) for v in new.values())], [*kept, *new])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank"]
    return ranked.mapInArrow(place, ", ".join([*fields, "sequence_id long", "`offset` long"]))

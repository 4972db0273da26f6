"""Language identification with blended-spectrum presence kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

ORDERS = (1, 2, 3)
SLOTS = 20  # bits
UNKNOWN = "und"
_MULTIPLIER = 0x9E3779B1
#: Characters whose n-grams are gathered at once, and rows of one matrix product.
PIECE, ROWS = 1 << 18, 64


def _slots(text: str, orders: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Hash slots of the n-grams of each order, lower case, over code points."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    code = np.zeros(len(points) + 1, np.uint32)[:0]
    for n in range(1, max(orders) + 1):
        code = points * np.uint32(_MULTIPLIER) if n == 1 else (code[:-1] ^ (code[:-1] >> np.uint32(15))) * np.uint32(_MULTIPLIER) + points[n - 1 :] * np.uint32(0x85EBCA6B)
        if not len(code):
            return
        if n in orders:
            yield ((code ^ (code >> np.uint32(16))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - SLOTS)


def grams(text: str, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """The different slots of a text's n-grams, sorted."""
    found = np.zeros(1 << SLOTS, bool)
    for at in range(0, max(1, len(text)), PIECE):
        for slots in _slots(text[at : at + PIECE + max(orders) - 1], orders):
            found[slots] = True
    return np.flatnonzero(found).astype(np.int32)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """Langs, the column of each n-gram slot that occurs in a landmark (-1: none), and weights by column and language.

    The kernel of two texts is the number of n-grams present in both, over the root of the product of both numbers;
    n-grams count if they occur in a landmark. A score is kernel with landmarks @ K^-1/2 @ ridge solution + bias.
    The three matrices are multiplied once, into `weights`, so that a batch of texts is scored by presence @ weights.
    """

    langs: tuple[str, ...]
    columns: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    orders: tuple[int, ...] = ORDERS

    def presence(self, texts: list[str], width: int) -> np.ndarray:
        found = np.zeros((len(texts), width + 1), bool)  # the last column takes n-grams of no landmark
        for row, text in enumerate(texts):
            for at in range(0, len(text), PIECE):
                for slots in _slots(text[at : at + PIECE + max(self.orders) - 1], self.orders):
                    found[row, self.columns[slots]] = True
        return found[:, :-1]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Margins of the languages for each text: about 1 for its own, -1 for others."""
        out = np.zeros((len(texts), len(self.langs)), np.float32)
        for at in range(0, len(texts), ROWS):
            p = self.presence(texts[at : at + ROWS], len(self.weights)).astype(np.float32)
            out[at : at + ROWS] = p @ self.weights / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1)) + self.bias
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.langs else []
        margins = self.scores([texts[i] for i in known]) if known else []
        for i, m in zip(known, margins, strict=True):
            best = int(np.argmax(m))
            langs[i], scores[i] = self.langs[best], float(min(1.0, max(0.0, (float(m[best]) + 1) / 2)))
        return langs, scores

    def known(self, text: str) -> float:
        """The share of a text's n-grams of the highest order that occur in a landmark."""
        n, total, found = max(self.orders), 0, 0
        for at in range(0, len(text), PIECE):
            for slots in _slots(text[at : at + PIECE + n - 1], (n,)):
                total += len(slots)
                found += int((self.columns[slots] >= 0).sum())
        return found / total if total else 1.0

    def fits(self, texts: list[str | None], langs: list[str], scores: list[float], sure: float, known: float) -> list[bool]:
        """Whether each text is of a learned language: its score is `sure` of the way from 1 / L to 1, or `known` of its n-grams are known.

        Every best score of L languages is 1 / L or more, as margins sum to 2 - L. With one language it's always 1, and each text with a letter fits.
        """
        floor = 1 / max(1, len(self.langs))
        least = floor + sure * (1 - floor) if len(self.langs) > 1 else 0.0
        return [lang != UNKNOWN and (score >= least or self.known(text) >= known) for text, lang, score in zip(texts, langs, scores, strict=True)]


def train(rows: list[tuple[str | np.ndarray, str]], landmarks: int = 64, ridge: float = 1e-3, orders: tuple[int, ...] = ORDERS) -> Model:
    """A model of (text or its grams(), lang) rows; the first `landmarks` texts of each language are landmarks."""
    rows = [(grams(t, orders) if isinstance(t, str) else t, lang) for t, lang in rows]
    langs = tuple(sorted({lang for _, lang in rows}))
    empty = Model(langs, np.full(1 << SLOTS, -1, np.int32), np.zeros((0, len(langs)), np.float32), np.zeros(len(langs), np.float32), orders)
    if not langs:
        return empty
    by = {lang: [t for t, x in rows if x == lang] for lang in langs}
    marks = [t for lang in langs for t in by[lang][:landmarks]]
    slots = np.unique(np.concatenate(marks))
    columns = np.full(1 << SLOTS, -1, np.int32)
    columns[slots] = np.arange(len(slots))

    def unit(texts: list[np.ndarray]) -> np.ndarray:
        p = np.zeros((len(texts), len(slots) + 1), np.float32)
        for row, t in enumerate(texts):
            p[row, columns[t]] = 1
        p = p[:, :-1]
        return p / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))

    at_marks = unit(marks)
    values, vectors = np.linalg.eigh((at_marks @ at_marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # Nyström: kernel with landmarks @ root
    texts = [t for t, _ in rows]
    features = np.concatenate([unit(texts[i : i + 256]) @ at_marks.T for i in range(0, len(texts), 256)]) @ root
    mean = features.mean(axis=0)
    target = np.array([[1.0 if lang == x else -1.0 for x in langs] for _, lang in rows])
    centred = features - mean
    solved = np.linalg.solve(centred.T @ centred + ridge * len(rows) * np.eye(centred.shape[1]), centred.T @ (target - target.mean(axis=0)))
    return Model(langs, columns, (at_marks.T @ (root @ solved)).astype(np.float32), (target.mean(axis=0) - mean @ solved).astype(np.float32), orders)


def sample(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 300, orders: tuple[int, ...] = ORDERS) -> list[tuple[np.ndarray, str]]:
    """The grams() of at most `per_language` whole texts of each language for training, those of smallest hash of the text.

    This is the one thing the classifier learns from, and its size has this bound: a text's n-gram slots take at most
    2 ** SLOTS bits, however long it is. Each language's different texts are counted first, by their hash, as copies pass
    or fail together. Hashes below one that more than twice as many pass, and all of a language with few, are
    ranked on the driver (fewer than min(per_language, different texts) pass with a probability under 1e-9); the texts chosen
    are fetched by their hashes, one copy each, and turned into slots on the executors.
    """
    fine = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    fine = fine.withColumn("_h", F.xxhash64("text"))
    kinds = fine.groupBy("lang", "_h").agg(F.lit(1).alias("n"))
    counts = dict(kinds.groupBy("lang").count().collect())
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, (2 * per_language + 64) / n))])
    hashes: dict[str, list[int]] = {lang: [] for lang in sorted(counts)}
    for r in kinds.where(F.pmod("_h", F.lit(1 << 30)) <= share[F.col("lang")] * (1 << 30)).collect():
        hashes[r["lang"]].append(r["_h"])
    chosen = [(lang, h) for lang, found in hashes.items() for h in sorted(found)[:per_language]]
    few = labelled.sparkSession.createDataFrame(chosen, "lang string, _h long")
    texts = fine.join(F.broadcast(few), ["lang", "_h"]).groupBy("lang", "_h").agg(F.first("text").alias("text"))  # at most per_language rows a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [_packed(grams(t, orders)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("_h"), pa.array(data, pa.binary())], ["lang", "_h", "slots"])

    found = {(r["lang"], r["_h"]): _unpacked(bytes(r["slots"])) for r in texts.mapInArrow(run, "lang string, _h long, slots binary").collect()}
    return [(found[x], x[0]) for x in chosen]


def _packed(slots: np.ndarray) -> bytes:
    """Slots as 32-bit numbers or, where that is shorter, as bits."""
    if 32 * len(slots) < 1 << SLOTS:
        return slots.astype("<i4").tobytes()
    bits = np.zeros(1 << SLOTS, bool)
    bits[slots] = True
    return np.packbits(bits).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return np.flatnonzero(np.unpackbits(raw)).astype(np.int32) if 8 * len(raw) == 1 << SLOTS else np.frombuffer(data, "<i4")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 300, landmarks: int = 64) -> Model:
    return train(sample(labelled, text_col, lang_col, per_language), landmarks)


def identify(docs: DataFrame, model: Model, text_col: str = "text", fits: tuple[float, float] | None = None) -> DataFrame:
    """Adds lang_pred and score (0 to 1) to docs, from the whole text alone.

    `und`, score 0: null, empty and letterless texts, and every text if the model learned no language. Repeated rows:
    each is predicted. Columns of docs named lang_pred or score are replaced. Empty table: no rows. With `fits`, the
    bounds of Model.fits, its verdict is added as a column of that name.
    """
    added = [StructField("lang_pred", StringType()), StructField("score", DoubleType())] + [StructField("fits", BooleanType())] * (fits is not None)
    docs = docs.drop(*[f.name for f in added])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some MB, whatever the input
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(names.index(text_col)).to_pylist()
                langs, scores = shared.value.predict(texts)
                own = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                if fits is not None:
                    own.append(pa.array(shared.value.fits(texts, langs, scores, *fits), pa.bool_()))
                yield pa.RecordBatch.from_arrays([*part.columns, *own], [*names, *(f.name for f in added)])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))


def remainder(id_col: str = "doc_id"):
    """Which of four folds a document is in; fold 2 is held out. A null id is in none (null): it isn't held out, and isn't learned from either."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def held_out(id_col: str = "doc_id"):
    """Whether a document is in fold 2; false for a null id."""
    return F.coalesce(remainder(id_col) == 2, F.lit(False))

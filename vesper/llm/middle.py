"""Fill-in-the-middle: texts cut in three at seeded places and written out in another order, so that a model learns to fill gaps."""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: A unit: one code point of any kind.
UNIT = r"(?s:.)"
FORMS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


@dataclass(frozen=True)
class Middle:
    """unit: the pattern of what is never cut apart. marks: what stands before prefix, suffix and middle. plain and spm: percentages of
    texts that stay as they are, and, of the others, whose suffix comes first. seed: what stands before the id in the digest."""

    unit: str = UNIT
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    plain: int = 10
    spm: int = 20
    seed: str = "1"

    def __post_init__(self):
        # so that a mark is found where it was put, whatever stands beside it: none lies in another, and none begins as one ends
        for i, a in enumerate(self.marks):
            for j, b in enumerate(self.marks):
                if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, len(b)) if (i, k) != (j, len(a))):
                    raise ValueError(f"marks {a!r} and {b!r} overlap")


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """Where each unit ends, in code points, 4 bytes each. What lies between two matches belongs to the later one, what follows the last to no unit."""
    return array("I", (m.end() for m in unit.finditer(text)))


def split(text: str, key: str, unit: regex.Pattern, how: Middle) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle (None if plain), output."""
    ends = unit_ends(text, unit)
    n, digest = len(ends), hashlib.sha256(f"{how.seed}:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in how.marks) or h[2] % 100 >= 100 - how.plain:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    p, s, m = how.marks
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < how.spm:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def join(output: str, form: str, how: Middle) -> str:
    """The text that split() was given, from its output and form."""
    if form == "plain":
        return output
    p, s, m = how.marks
    first, second = (p, s) if form == "psm" else (s, p)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(m)
    return one + middle + two if form == "psm" else two + middle + one


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Middle | None = None, into: str = "fim") -> DataFrame:
    """docs with a struct `into`: n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output, output_sha256.

    Rows are cut one by one in Arrow batches, without a shuffle; the places follow from the id alone, so that rows with the same id and text
    are cut alike. Null text: empty, thus plain with n = 0. Null id: the empty string in the digest. Texts are held whole, with 4 bytes a unit.
    Empty table: no rows. Other columns are kept, also one named like a field of the struct; one named `into` is replaced.
    """
    how = how or Middle()

    @F.pandas_udf(FORMS)
    def cut(key: pd.Series, text: pd.Series) -> pd.DataFrame:
        unit = regex.compile(how.unit)
        rows = [split(t, k, unit, how) for k, t in zip(key, text, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"]).astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})
        out["output_sha256"] = [_hex(t) for t in out["output"]]
        return out

    return docs.withColumn(into, cut(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_or_empty(text_col)))


def restored(output, form, how: Middle | None = None):
    """Column: the text that an output of transform() and its form stand for."""
    how = how or Middle()

    @F.pandas_udf("string")
    def undo(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([join(t, f, how) for t, f in zip(output, form, strict=True)], dtype=object)

    return undo(output, form)


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def hex_digest(text):
    """Column: lowercase hex of the SHA-256 of a text in UTF-8."""

    @F.pandas_udf("string")
    def digest(text: pd.Series) -> pd.Series:
        return pd.Series([_hex(t) for t in text], dtype=object)

    return digest(text)


SQL_OP13 = """WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS d FROM documents),
k AS (SELECT doc_id, t, length(t) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
o AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM o"""

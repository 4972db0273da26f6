"""Quality rules by weak supervision: rules vote or abstain, and expectation-maximisation weighs them."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, cut, text_or_empty, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A word of letters, also joined by - and ', with marks around it. Possessive: no group is repeated by recursion, however long the word.
PLAIN_WORD = r"^[(\[\"'«„“]*+[\p{L}\p{M}]++(?:[-'’][\p{L}\p{M}]++)*+[.,;:!?)\]\"'»“”…]*+$"


def base_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and counts over the whole text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines (lines with a word), n_plain_words (words of letters, marks
    of punctuation around them apart), n_echo_words (equal to the word before), n_ended_lines (lines that end a sentence).

    n_repeat_words: words covered by 8-word windows that occur twice or more in the text. Windows are hashed; only a
    text whose hashes aren't all distinct is sorted to find the repeated ones. Null or empty text: all zero.
    """
    text = text_or_empty(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t"))
    base = base.select("doc_id", "_t", words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    grams = F.when(F.size("_w") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_w") - WINDOW + 1), lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    base = base.select(
        "doc_id", "_w", F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", "[^" + SYMBOLS + "]+", "")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.filter("_w", lambda w: w.rlike(PLAIN_WORD))).cast("long").alias("n_plain_words"),
        F.size(F.filter("_w", lambda w, i: w == F.get("_w", i - 1))).cast("long").alias("n_echo_words"),
        F.size(F.filter("_l", lambda x: x.rlike(r"[.!?][\"')\]]*\s*$"))).cast("long").alias("n_ended_lines"),
        grams.alias("_g"),
    ).drop("_w")
    again = F.size(F.array_distinct("_g")) < F.size("_g")
    base = base.withColumn("_s", F.when(again, F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    n = F.size("_s")
    starts = F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), n - 1), lambda j: ((j > 0) & (F.get("_s", j - 1)["g"] == F.get("_s", j)["g"])) | ((j < n - 1) & (F.get("_s", j + 1)["g"] == F.get("_s", j)["g"]))), lambda j: F.get("_s", j)["i"]))
    base = base.withColumn("_p", F.when(F.col("_s").isNotNull(), starts)).drop("_s", "_g")
    covered = F.aggregate("_p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(i, a["to"])).alias("n"), (i + WINDOW).alias("to")))["n"]
    return base.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")


@dataclass(frozen=True)
class Rule:
    """Votes 1 (good) or -1 (bad) where the text is clearly so, and abstains (0) between and on texts without words."""

    name: str
    value: Column
    good: tuple[float, float]
    bad_below: float = -math.inf
    bad_above: float = math.inf

    def vote(self) -> Column:
        v = self.value
        bad = F.lit(False)
        if self.bad_below > -math.inf:
            bad = bad | (v < self.bad_below)
        if self.bad_above < math.inf:
            bad = bad | (v > self.bad_above)
        return F.when(v.isNull(), 0).when(bad, -1).when(v.between(*self.good), 1).otherwise(0).cast("int").alias(self.name)


def _per(a: str, b: str) -> Column:
    return F.try_divide(F.col(a).cast("double"), F.col(b))


def default_rules() -> list[Rule]:
    return [
        Rule("long_enough", F.col("n_words").cast("double"), (40, 1e12), bad_below=20),
        Rule("word_length", _per("word_chars", "n_words"), (3, 9), bad_below=2, bad_above=14),
        Rule("few_symbols", _per("n_symbols", "n_words"), (0, 0.03), bad_above=0.3),
        Rule("little_symbol_text", _per("n_symbols", "word_chars"), (0, 0.01), bad_above=0.08),
        Rule("plain_words", _per("n_plain_words", "n_words"), (0.85, 1), bad_below=0.55),
        Rule("few_repeated_lines", _per("n_dup_lines", "n_lines"), (0, 0.1), bad_above=0.5),
        Rule("few_repeated_words", _per("n_repeat_words", "n_words"), (0, 0.1), bad_above=0.3),
        Rule("few_echoes", _per("n_echo_words", "n_words"), (0, 0.02), bad_above=0.2),
        Rule("sentences", _per("n_ended_lines", "n_lines"), (0.5, 1), bad_below=0.05),
    ]


def log_odds(params: dict, names: list[str]) -> Column:
    """Sum of the rules' weights of evidence: the vote picks its weight from an array."""
    weights = _weights(params, names)
    prior = math.log(params["prior"] / (1 - params["prior"]))
    return sum((F.get(F.array(*map(F.lit, w)), F.col(n) + 1) for n, w in zip(names, weights, strict=True)), F.lit(prior))


def _weights(params: dict, names: list[str]) -> list[list[float]]:
    """For each rule the evidence of a bad vote, of none, and of a good vote."""
    return [[math.log(false / true), 0.0, math.log((1 - false) / (1 - true))] for false, true in (params[n] for n in names)]


def fit(votes: DataFrame, names: list[str], rounds: int = 25, prior: float = 0.9, false: float = 0.01, true: float = 0.4, strength: float = 0.02, tolerance: float = 1e-6) -> dict:
    """prior (share of good texts) and for each rule (P(votes bad | good), P(votes bad | bad)), by EM.

    A bad text breaks one rule or another, seldom all, so each rule has a rate for either class and its accuracy
    follows from both. The data are the counts of vote patterns, one aggregate over all texts: at most 3 to the number of
    rules rows at any input size, which go to the driver, where the rounds are sums over them. Rates are drawn to their start with the weight of `strength` of all
    texts, P(votes bad | bad) stays at 0.1 or more and P(votes bad | good) at 0.05 or less, so that the classes can't
    change sides and a rule that never votes keeps its start. No texts: the start values.
    """
    counted = sorted(map(tuple, votes.groupBy(*names).agg(F.count("*").alias("_n")).collect()))
    params = {"prior": prior} | {n: (false, true) for n in names}
    if not counted:
        return params
    table = np.array(counted, np.int64)
    vote, n = table[:, :-1], table[:, -1].astype(float)
    rows, total = np.arange(len(names)), n.sum()
    extra = strength * total
    for _ in range(rounds):
        odds = np.array(_weights(params, names))[rows, vote + 1].sum(axis=1) + math.log(params["prior"] / (1 - params["prior"]))
        good = n / (1 + np.exp(-odds))
        bad = n - good
        rate = lambda hit, of, start: float((hit + start * extra) / (of + extra))
        new = {"prior": min(0.99, max(0.5, rate(good.sum(), total, prior)))}
        for i, name in enumerate(names):
            broke, voted = vote[:, i] == -1, vote[:, i] != 0
            new[name] = (min(0.05, max(1e-4, rate(good[broke].sum(), good[voted].sum(), false))), min(0.99, max(0.1, rate(bad[broke].sum(), bad[voted].sum(), true))))
        moved = max(abs(x - y) for k in new for x, y in zip(*(v[k] if k != "prior" else (v[k],) for v in (new, params)), strict=True))
        params = new
        if moved < tolerance:
            break
    return params


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, least: float = 0.5, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """base_stats() with the rules' votes, quality (posterior probability that the text is good), base_failed, kept.

    base_failed: fewer than min_words words, or repeated words over max_repeat percent. kept: not base_failed, and
    quality >= least. Works on DataFrame functions alone. Null, empty and short texts are base_failed. Repeated rows:
    each is judged. Other columns of docs are ignored. Empty table: no rows.
    """
    rules = rules or default_rules()
    stats = cut(base_stats(docs, id_col, text_col))
    names = [r.name for r in rules]
    votes = stats.select("*", *[r.vote() for r in rules])
    quality = 1 / (1 + F.exp(-log_odds(fit(votes, names), names)))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    out = votes.withColumn("quality", quality).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
    return out.withColumnRenamed("doc_id", id_col)

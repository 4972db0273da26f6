"""Null ids in archives, the range of scores, and the size of what the language model learns from."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import docs

from vesper.llm import language, search, warc


def test_archives_of_null_ids(spark, tmp_path):
    same = "s" * 1500
    rows = [(None, "u", same), (5, "v", same), (None, None, None), (3, "w", same)]
    back = warc.read(spark, warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))).collect()
    assert sorted(((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in back), key=str) == sorted([(None, "response", None, 1500), (5, "response", None, 1500), (None, "response", None, 0), (3, "revisit", 5, 1500)], key=str)
    assert all(r["intact"] for r in back)


def test_scores_beyond_the_range_are_refused(spark):
    schema = "vec_id long, embedding array<double>"
    with pytest.raises(ValueError, match="63 bits"):
        search.top_k(spark.createDataFrame([(0, [1e17]), (1, [1.0])], schema), F.col("vec_id") % 5 == 0)
    big = [(i, [(-1.0) ** i * (2**20 + i), 2.0**20 - i]) for i in range(12)]  # products beyond 53 bits
    out = search.top_k(spark.createDataFrame(big, schema), F.col("vec_id") % 5 == 0, k=11).collect()
    exact = {i: [int(256 * x) for x in v] for i, v in big}
    assert len(out) == 33 and all(r["score"] == sum(a * b for a, b in zip(exact[r["query_id"]], exact[r["vec_id"]], strict=True)) for r in out)


def test_search_prunes_exactly_on_sparse_rows():
    rng = np.random.default_rng(2)
    for dims, share in ((40, 0.1), (40, 0.9), (6, 1.0)):
        x = np.floor(rng.normal(size=(400, dims)) * 100 * (rng.random((400, dims)) < share))
        ids, q = np.arange(400), x[:40]
        for qi, found, scores in search.maxscore(ids, x, ids[:40], q, 5):
            every = x @ x[qi]
            order = [i for i in np.lexsort((ids, -every)) if i != qi][:5]
            assert found.tolist() == order and scores.tolist() == every[order].tolist()


def test_learning_texts_are_bounded_in_bytes(spark):
    rng = random.Random(1)
    long_text = "".join(map(chr, rng.choices(range(0x4E00, 0x9000), k=400_000)))
    slots = language.grams(long_text)
    assert len(language._packed(slots)) == (1 << language.SLOTS) // 8 and (language._unpacked(language._packed(slots)) == slots).all()
    short = language.grams("the cat")
    assert (language._unpacked(language._packed(short)) == short).all() and len(language.grams("")) == 0
    rows = [(1, long_text, "zh"), (2, "the cat sat", "en"), (3, "the dog sat", "en"), (4, "the dog sat", "en"), (5, None, "en"), (6, "12", "en")]
    drawn = language.sample(docs(spark, rows))
    assert [(lang, x.tolist()) for x, lang in drawn if lang == "zh"] == [("zh", slots.tolist())]
    assert sorted(x.tolist() for x, lang in drawn if lang == "en") == sorted(language.grams(t).tolist() for t in ("the cat sat", "the dog sat"))


def test_a_null_id_is_in_no_fold(spark, tmp_path):
    from vesper.llm import queries

    rows = [(i, "the cat sat on the mat and slept" if i % 2 else "der hund lief in den wald und kam", "en" if i % 2 else "de") for i in range(40)] + [(None, "le chat dort sur la table", "fr"), (None, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op4_language_id(spark, str(tmp_path)).collect()
    assert len(out) == 42 and {r["held_out"] for r in out} == {True, False} and all(r["held_out"] is False for r in out if r["doc_id"] is None)
    assert {r["lang_pred"] for r in out} == {"en", "de", "und"}  # the text of null id isn't learned from

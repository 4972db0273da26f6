"""The opN queries: each operator over its whole table with production parameters, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cover, html, language, middle, mixing, neardup, packing, quality, search, secrets, substring, trie, warc
from .common import stash, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"), with_kept=False)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(language.remainder() != 2))
    return language.identify(docs.select("doc_id", "text", language.held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op9_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.read(spark, warc.archive(table(spark, sf_dir, "pages")), payloads=False)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", warc.verdict(back).alias("payload_digest"), "record_type", "refers_to")


def op10_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover.deduplicate(table(spark, sf_dir, "documents"), with_kept=False)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, convs = trie.lent(stash(trie.numbered(table(spark, sf_dir, "conversations"))))
    nodes, _ = trie.trie(stash(rows), convs)
    return nodes.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = middle.restored(F.col("fim.output"), F.col("fim.form"))
    return out.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", "fim.output_sha256", middle.hex_digest(text).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_quality_rules": op2_quality_rules,
        "op3_html_extraction": op3_html_extraction,
        "op4_language_id": op4_language_id,
        "op5_minhash_neardup": op5_minhash_neardup,
        "op6_mix_sources": op6_mix_sources,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_secret_scan": op8_secret_scan,
        "op9_warc_roundtrip": op9_warc_roundtrip,
        "op10_maxscore_topk": op10_maxscore_topk,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash_neardup": neardup.SQL_OP5, "op6_mix_sources": mixing.SQL_OP6, "op9_warc_roundtrip": warc.SQL_OP9, "op10_maxscore_topk": search.SQL_OP10, "op11_substring_dedup": cover.SQL_OP11, "op12_conversation_trie": trie.SQL_OP12, "op13_fill_in_middle": middle.SQL_OP13}

"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesper.llm import language, mixing, neardup, packing, secrets
from vesper.llm.common import shared_dir, stash, table
from vesper.session import ship

#: What the stages pass on; other columns of documents are left out.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text is rejected if its best score is less than MIN_SCORE of the way from 1 / L to 1 (with L languages the margins sum to 2 - L, so that no best
#: score is below 1 / L), and less than MIN_KNOWN of its trigrams occur in a landmark: a text between two languages is unsure, but not unknown.
MIN_SCORE, MIN_KNOWN = 0.25, 0.95
#: Near-duplicates share so many percent of their shingles of so many words.
SHINGLE, PERCENT = 5, 80


def stage(function):
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return function(spark, docs, sf_dir)

    return run_stage


def keyed(docs: DataFrame) -> DataFrame:
    """Adds _row, a number of each row's own, written once so that it stays, and _hash; doc_id may be null or repeated."""
    return stash(docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("_hash"), F.monotonically_increasing_id().alias("_row")))


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, have no letter, or fit no language; learns from the folds that aren't held out.

    Where a single language is learned, every text with a letter scores 1 and stays: there is nothing to tell it from.
    """
    model = language.fit(docs.where(language.remainder() != 2))
    return language.identify(docs, model, fits=(MIN_SCORE, MIN_KNOWN)).where("fits").select(*COLUMNS)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates, that of smallest doc_id; null ids are documents of their own, and come last."""
    docs = keyed(docs)
    groups = neardup.near_duplicates(docs, id_col="_row", n=SHINGLE, percent=PERCENT).select("_row", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_hash", "_row")
    kept = docs.select("_row", order.alias("order")).join(groups, "_row").groupBy("component_id").agg(F.min("order").alias("order")).select("order._row")
    return docs.join(kept, "_row", "left_semi").select(*COLUMNS)


@stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; n_chars follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, none to three times; null and repeated ids are documents of their own."""
    docs = keyed(docs)
    copies = mixing.mix(docs, key_col="_row").where("copies > 0").select("_row", F.col("copies").alias("_copies"))
    return docs.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of at most 2048 tokens of each row's text, with its place in a sequence; rows that are equal take places of their own."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]
#: The language model can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, apply) in enumerate(STAGES):
        out = apply(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs

"""Directory summaries, totals, filters and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def dir_summary(store: DataFrame, namespace: str | None = None) -> DataFrame:
    """dir, file_count, total_size, latest for the immediate parent directory; over both namespaces if none is named."""
    rows = store if namespace is None else store.where(F.col("namespace") == namespace)
    return rows.groupBy("dir").agg(F.count("*").alias("file_count"), F.sum("file_size").alias("total_size"), F.max("updated_at").alias("latest"))


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two dir_summary() tables as one."""
    return first.unionByName(second).groupBy("dir").agg(F.sum("file_count").alias("file_count"), F.sum("total_size").alias("total_size"), F.max("latest").alias("latest"))


def newest_first(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.desc("latest"), "dir")


def totals(summary: DataFrame) -> DataFrame:
    return summary.agg(F.count("*").alias("dirs"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("files"), F.coalesce(F.sum("total_size"), F.lit(0)).alias("bytes"))


def filter_dirs(summary: DataFrame, query: str) -> DataFrame:
    return summary.where(paths.contains_ignoring_case("dir", query))


def name_matches(rows: DataFrame, query: str) -> DataFrame:
    """One row: matches of total, by the last path component."""
    return rows.agg(F.count_if(paths.name_matches("path", query)).alias("matches"), F.count("*").alias("total"))


def has_pairs(rows: DataFrame) -> DataFrame:
    """One row: whether some directory has more than one file."""
    return rows.groupBy("dir").count().agg(F.coalesce(F.bool_or(F.col("count") > 1), F.lit(False)).alias("has_pairs"))


def listing_counts(listing: DataFrame) -> DataFrame:
    return listing.agg(F.count("*").alias("files"), F.count_distinct("dir").alias("dirs"))


def walk_errors(errors: DataFrame) -> DataFrame:
    """One row for (ordinal, message) errors: the first message, with their number if there are more."""
    both = errors.agg(F.count("*").alias("n_errors"), F.min_by("message", "ordinal").alias("first"))
    return both.select("n_errors", F.when(F.col("n_errors") > 1, F.concat("first", F.lit(" ("), F.col("n_errors").cast("string"), F.lit(" errors)"))).otherwise(F.col("first")).alias("summary"))


def run_report(outcomes: DataFrame) -> DataFrame:
    """One row: processed, skipped, write_failed. A failed write counts as processed as well."""
    o = F.col("outcome")
    return outcomes.agg(F.count_if(o.isin("processed", "write_failed")).alias("processed"), F.count_if(o == "skipped").alias("skipped"), F.count_if(o == "write_failed").alias("write_failed"))


def run_issues(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome").isin("skipped", "write_failed")).select("path", "outcome", "message")

import pytest
from oracle import same_rows
from pyspark.sql import functions as F

from vesper import queries as q


@pytest.mark.parametrize("name", [n for n in q.queries() if n in q.oracle_sql()])
def test_query_equals_sql(spark, sf_dir, name):
    same_rows(q.queries()[name](spark, sf_dir), q.oracle_sql()[name], sf_dir)


def test_encode_and_pool_gives_unit_vectors(spark, sf_dir):
    rows = q.queries()["encode_and_pool"](spark, sf_dir).groupBy("path").agg(F.count("*").alias("dims"), F.sum(F.pow("value", F.lit(2))).alias("norm")).collect()
    assert rows and all(r["dims"] == 8 and abs(r["norm"] - 1) < 1e-3 for r in rows)


def test_every_query_runs_without_llm(spark):
    import __spark_entry__ as entry

    assert set(q.queries()) <= set(entry.queries()) and set(q.oracle_sql()) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() >= 0

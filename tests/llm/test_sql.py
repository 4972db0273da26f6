import pytest
from oracle import same_rows

from vesper.llm import queries as q


@pytest.mark.parametrize("name", list(q.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    same_rows(q.queries()[name](spark, sf_dir), q.oracle_sql()[name], sf_dir)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in q.queries()) == list(range(1, 14))

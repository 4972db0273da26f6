import pytest
from pyspark.sql import functions as F

from vesper.llm import common


def test_tables_are_released(spark):
    common.release(spark)
    tables = [common.stash(spark.range(5)) for _ in range(2)]
    assert all(t.agg(F.sum("id")).first()[0] == 10 for t in tables)
    assert common.release(spark) == 2 and common.release(spark) == 0


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815
        conf = {}  # noqa: RUF012

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())

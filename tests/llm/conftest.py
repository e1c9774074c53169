import pytest

from ratecraft.session import scratch_path


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table
    and one whose name an operator uses inside."""
    def make(rows, **more):
        rows = [(i, t, "en", "src0", len(t or ""), 7) for i, t in rows]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, shard int").repartition(3)
    return make


@pytest.fixture
def shared(spark):
    return lambda name: scratch_path(spark, name)

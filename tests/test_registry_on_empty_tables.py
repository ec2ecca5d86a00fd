import pyarrow.parquet as pq
import pytest

from loomspan.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in TABLES:
        pq.write_table(pq.read_table(f"{SMALL}/{name}.parquet").slice(0, 0), folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_every_query_runs_on_empty_tables(spark, empty, name):
    assert len(registry.QUERIES[name](spark, empty).collect()) < 20  # totals of nothing, and rows of fixed glossaries

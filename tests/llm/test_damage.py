import pytest

from loomspan.llm.queries import QUERIES
from tests.damage import damaged, emptied


@pytest.fixture(scope="module")
def folders(tiny, tmp_path_factory):
    return damaged(tiny, str(tmp_path_factory.mktemp("damaged"))), emptied(tiny, str(tmp_path_factory.mktemp("emptied")))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_everywhere_and_further_columns(spark, folders, name):
    rows = QUERIES[name](spark, folders[0]).collect()
    assert len(rows) > 0
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folders, name):
    rows = QUERIES[name](spark, folders[1]).collect()
    assert not name.endswith("_found") or rows == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_smallest_tables(spark, tiny, name):
    assert QUERIES[name](spark, tiny).count() > 0

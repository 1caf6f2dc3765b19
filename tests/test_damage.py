import pytest

import __spark_entry__ as entry
from tests.damage import damaged, emptied

DEALT = sorted(k for m in entry.MODULES for k in __import__(m, fromlist=["x"]).QUERIES if k[0] == "p" and k[1].isdigit())


@pytest.fixture(scope="module")
def folders(tiny, tmp_path_factory):
    return damaged(tiny, str(tmp_path_factory.mktemp("damaged"))), emptied(tiny, str(tmp_path_factory.mktemp("emptied")))


@pytest.mark.parametrize("name", DEALT)
def test_nulls_everywhere_and_further_columns(spark, folders, name):
    rows = entry.queries()[name](spark, folders[0]).collect()
    assert len(rows) > 0
    if name.endswith("_found"):
        assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", DEALT)
def test_empty_tables(spark, folders, name):
    rows = entry.queries()[name](spark, folders[1]).collect()
    assert not name.endswith("_found") or rows == []

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import check  # noqa: E402

from tidemark import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, sf_dir, name):
    check(spark, sf_dir, queries.QUERIES[name], queries.SQL[name])


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 17
    assert set(queries.QUERIES) <= set(entry.queries())

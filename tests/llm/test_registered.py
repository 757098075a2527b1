import os
import re

import pytest
from oracle import DATA, compare

from manifoldry.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("name", ["op3_url_filter", "op10_sharding"])
def test_a_row_for_each_input(spark, name):
    table = "pages" if name.startswith("op3") else "documents"
    assert queries.QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()

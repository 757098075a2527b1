import os

import pytest
from oracle import DATA, compare

from manifoldry.plans import catalogue, registry  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(spark, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).limit(1).count() == 1


def test_entry_without_the_llm_folder(spark, monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "manifoldry.llm", None)
    sys.modules.pop("__spark_entry__", None)
    import __spark_entry__

    assert set(__spark_entry__.queries()) == set(registry.QUERIES) and set(__spark_entry__.oracle_sql()) == set(registry.ORACLES)
    assert __spark_entry__.entry(spark).columns == ["label", "n", "purity", "prevalence", "enrichment"]

import pytest

from skeinlake.llm import registry

from ..oracle import check


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, name):
    check(spark, name, registry.QUERIES, registry.ORACLE)

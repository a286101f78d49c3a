import pytest

from skeinlake.queries import audit, build, data_problems, runs, scoring

from .oracle import check

MODULES = (data_problems, scoring, build, audit, runs)
CASES = [(m, n) for m in MODULES for n in m.QUERIES]


@pytest.mark.parametrize("module,name", CASES, ids=[n for _, n in CASES])
def test_query(spark, module, name):
    check(spark, name, module.QUERIES, module.ORACLE)

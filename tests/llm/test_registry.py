import os

import pytest

from palaver.llm import registry
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    assert difference(spark, connect(SF), SF, registry.queries()[name], registry.oracle_sql()[name]) == ""


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))

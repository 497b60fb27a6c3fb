import os

import oracle
import pytest

from foliant.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are absent")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert oracle.compare(QUERIES[name](spark, DATA), oracle.connect(DATA), ORACLE_SQL[name]) == ""

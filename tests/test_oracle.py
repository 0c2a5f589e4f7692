"""Every query of the engine against its SQL at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from compare import duck_rows, same, spark_rows

from variantloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    cols, rows = spark_rows(registry.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert rows
    if name in registry.ORACLE_SQL:
        want_cols, want = duck_rows(duck, registry.ORACLE_SQL[name])
        assert cols == want_cols
        assert same(rows, want)

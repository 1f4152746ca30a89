"""Every registered query with an oracle equals its DuckDB SQL on sf0.001
(the driver repeats this at sf0.01)."""
import pytest

from __spark_entry__ import oracle_sql, queries
from tools.oracle_check import compare

from conftest import SF_SMALL

NAMES = sorted(oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    res = compare(spark, duck, SF_SMALL, name, queries()[name], oracle_sql()[name])
    assert res["cols_match"], res
    assert res["spark_rows"] == res["duck_rows"], res
    assert res["close"], res


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    rows = df.collect()
    assert len(rows) == 2 and {"label", "n"} <= set(df.columns)

import pytest
from helpers import assert_same

import __spark_entry__ as entry
from scriptorium.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    if name in plans.ORACLES:
        assert_same(df, plans.ORACLES[name], sf_dir)
    else:
        assert df.count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["brand", "mean_cer", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

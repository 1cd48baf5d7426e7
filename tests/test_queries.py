"""Every registered query of the library against its DuckDB oracle."""

import pytest

from sparkloom.plans import oracle, registry


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    order = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert order(a).equals(order(b))


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_oracle(spark, sf, duck, name):
    same(registry.QUERIES[name](spark, sf).toPandas(), duck.execute(oracle.SQL[name]).df())


def test_every_query_has_an_oracle_but_training():
    assert set(registry.QUERIES) - set(oracle.SQL) == {"spam_train", "spam_apply_trained"}


def test_entry(spark):
    import __spark_entry__ as e

    assert set(oracle.SQL) <= set(e.oracle_sql()) and set(registry.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0

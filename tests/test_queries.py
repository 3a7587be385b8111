"""Every query of the library against its SQL, or, without SQL, that it runs."""

from __future__ import annotations

import harness
import pytest

from tidewell import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_has_the_rows_of_its_sql(spark, sf_dir, name):
    assert not harness.check(spark, name, registry.QUERIES[name], registry.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).collect() is not None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

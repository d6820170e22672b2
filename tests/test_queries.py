"""Every registered query of the library's own operators against its SQL, over the whole smallest tables."""

import pytest
from conftest import SF

from riskloom import registry

#: At the smallest size these have days without exposure, whose residuals of 1e5 and more leave no six equal digits.
LARGER = {"h2_focus_scan", "h6_chart_summary", "z5_online_focus"}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, same_as_sql, name):
    sf = SF.replace("sf0.001", "sf0.01") if name in LARGER else SF
    same_as_sql(registry.QUERIES[name](spark, sf), registry.ORACLE_SQL[name], sf)


def test_every_sql_has_its_query():
    assert not {*registry.ORACLE_SQL} - {*registry.QUERIES}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

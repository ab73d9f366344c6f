"""Every registered query against its SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from checks.queries import QUERIES
from checks.sql import oracle
from compare import database, difference

SQL = oracle()

@pytest.fixture(scope="module")
def db(folder):
    return database(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, db, folder, name):
    got = QUERIES[name](spark, folder).toPandas()
    assert difference(got, db.execute(SQL[name]).df()) is None
    # No disorder has the support asked for in the smallest tables.
    assert len(got) > 0 or name == "support_filter"


def test_entry(spark):
    found = {row["stratum"]: row["n"] for row in entry_points.entry(spark).collect()}
    assert found["ALL"] == sum(n for stratum, n in found.items() if stratum != "ALL")

"""Every registered query of the library against its SQL, or at least run where SQL can't state it."""

import pytest

from caselens import catalog
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(name, spark):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_counts(spark):
    import __spark_entry__ as e

    found = {(r["deviation_type"], r["severity"]): r["n"] for r in e.entry(spark).collect()}
    assert found == {("missing_step", "high"): 5712, ("wrong_sequence", "high"): 1958}


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

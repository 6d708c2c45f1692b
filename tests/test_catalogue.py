import pytest

from tests.parity import same
from tidemark.plans import actors, bands, catalogue, evidence, exchange, history, sealing, watching, witnesses  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(spark, name):
    got, wanted = same(spark, catalogue.QUERIES[name], catalogue.ORACLE[name])
    assert got == wanted


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

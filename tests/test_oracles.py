import pytest

from tests.compare import difference
import vigil.plans.transcripts  # noqa: F401  registers its queries
from vigil.plans.queries import ORACLES, QUERIES, entry

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, name):
    found = difference(spark, DATA, name, QUERIES[name], ORACLES[name])
    assert found is None, found


def test_entry(spark):
    rows = entry(spark, DATA)
    assert rows.count() > 0 and {r.severity for r in rows.select("severity").collect()} == {"high"}

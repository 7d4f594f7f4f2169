"""Every core query against its SQL, or at least to its end."""

import pytest
from tests.support import SMALL, same_rows

from folio.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    if name in registry.ORACLE:
        same_rows(df, duck, registry.ORACLE[name])
    else:
        df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())

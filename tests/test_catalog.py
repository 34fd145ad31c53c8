"""Every registered query of the engine against its SQL, on the small tables."""

import pytest
from conftest import canonical

from loomspark.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(name, spark, sf_dir, duck):
    df = catalog.QUERIES[name](spark, sf_dir)
    cur = duck.execute(catalog.ORACLE[name])
    want = canonical(cur.fetchall(), [d[0] for d in cur.description])
    assert canonical([tuple(r) for r in df.collect()], df.columns) == want
    assert want[0], "the query is vacuous on these tables"

"""Every registered query against its SQL on the smallest tables."""

from collections import Counter

import pytest

from quire.plans.queries import QUERIES
from quire.plans.reference_sql import SQL


def test_every_sql_has_a_query():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(r[c] for c in cols) for r in df.collect())
    cur = duck.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
    assert got, "a query without rows compares nothing"
    assert got == want

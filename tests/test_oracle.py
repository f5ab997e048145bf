"""Every registered query against its SQL on the small tables."""

import math
from collections import Counter

import pytest
from small_tables import SF_DIR

import __spark_entry__ as entry_points
from quotary.plans.queries import QUERIES as PLANNED

QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()
OWN = sorted(PLANNED)  # the document operators have tests of their own


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def test_every_query_has_sql():
    assert set(OWN) <= set(QUERIES) and set(OWN) <= set(SQL)


@pytest.mark.parametrize("name", OWN)
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(tuple(_value(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    have = Counter(tuple(_value(r[c]) for c in sorted(names)) for r in got.collect())
    assert have == want


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0

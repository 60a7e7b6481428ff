"""Every query against its SQL, and the entry points."""

import math

import pytest

from ledgerlens import catalogue

SF = "/root/testdata/sf0.001"


def plain(rows):
    def one(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "none"
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(df.columns)) for r in df.collect()]
    assert rows
    if name in catalogue.oracle_sql():
        relation = duck.sql(catalogue.oracle_sql()[name])
        assert sorted(relation.columns) == sorted(df.columns)
        wanted = [tuple(dict(zip(relation.columns, r))[c] for c in sorted(relation.columns)) for r in relation.fetchall()]
        assert plain(rows) == plain(wanted)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every query over stated cases gives what is written down beside it; DuckDB reads the written rows."""

import pytest

from folioflow import fixtures

duckdb = pytest.importorskip("duckdb")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(norm(v[i]) for i in order) for v in values), key=repr)


@pytest.mark.parametrize("name", sorted(fixtures.QUERIES))
def test_fixture(spark, name):
    df = fixtures.QUERIES[name](spark, "")
    want = duckdb.sql(fixtures.SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_every_rule_has_a_case():
    assert {rule for _, found in fixtures.SCANNED for rule, _ in found} == {r.id for r in fixtures.RULES}

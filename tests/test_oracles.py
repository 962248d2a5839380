"""Every query with an oracle, row for row against DuckDB; the others just run."""

import pytest

from rillflow.queries import catalogue

SMALL = "/root/testdata/sf0.001"

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    return repr(v) if isinstance(v, (int, bool)) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck):
    df = QUERIES[name](spark, SMALL)
    found = df.collect()
    if name not in ORACLES:
        assert df.columns and found
        return
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, found) == rows(columns, want.fetchall())


def test_flagship_plan_pushes_down(spark):
    from rillflow.operators.transform import explained

    plan = explained(catalogue.flagship(spark, SMALL))
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,1.0)]" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan
    assert "Python" not in plan and "Arrow" not in plan

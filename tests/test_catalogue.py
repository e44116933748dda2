"""Every query with an oracle against DuckDB, at the smallest scale."""

import datetime as dt
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

from shelfsignal.plans.health_catalogue import CAT as HEALTH  # noqa: E402
from shelfsignal.plans.ingest_catalogue import CAT as INGEST  # noqa: E402
from shelfsignal.plans.operations_catalogue import CAT as OPERATIONS  # noqa: E402
from shelfsignal.plans.rules_catalogue import CAT as RULES  # noqa: E402
from shelfsignal.plans.state_catalogue import CAT as STATE  # noqa: E402

CATALOGUES = (RULES, OPERATIONS, HEALTH, INGEST, STATE)
ORACLES = {name: sql for c in CATALOGUES for name, sql in c.oracle().items()}
QUERIES = {name: query for c in CATALOGUES for name, query in c.queries.items()}


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df, want = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    a = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert a == b

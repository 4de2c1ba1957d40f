"""Every registered query against its DuckDB oracle at sf0.01 (the driver's gate),
and every query without an oracle at least runs and yields a stable schema."""

import pytest

from tests.oracle import compare, duck
from ticketlake.plans.registry import oracle_sql, queries

Q = queries()
O = oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(O))
def test_oracle(spark, sf_dir, con, name):
    ok, msg = compare(Q[name](spark, sf_dir), con, O[name])
    assert ok, f"{name}: {msg}"


@pytest.mark.parametrize("name", sorted(set(Q) - set(O)))
def test_rows_only(spark, sf_dir, name):
    df = Q[name](spark, sf_dir)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0 or name == "fuzzy_match"  # no passage is near a whole document at sf0.01

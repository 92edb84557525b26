"""Every query with an oracle gives the oracle's rows; every other one runs."""

import os

import pytest

import __spark_entry__ as entry
import oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["foe_base", "transitions", "longest", "mean_reward", "wins", "win_rate"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, con, name):
    assert oracle.differences(con, entry.queries()[name](spark, SF), entry.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0

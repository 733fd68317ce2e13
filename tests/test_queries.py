"""Every query of the core against its SQL in DuckDB, over the smallest tables."""

import oracle
import pytest

from tessera.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.differences(QUERIES[name](spark, FOLDER), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).collect() is not None


def test_the_loader_gives_all_ticks_in_order(spark, con):
    sql = "select tick_id from tick_events_ext where scope = 'target' and event_type in ('TRADE', 'BID', 'ASK') order by stock_code nulls first, time nulls first, tick_id"
    got = [r["tick_id"] for r in QUERIES["load_ticks_all"](spark, FOLDER).collect()]
    assert len(got) > 500 and got == [r[0] for r in con.execute(sql).fetchall()]


@pytest.mark.parametrize("name, within", [("scan_bars_all", "scan_bars"), ("fundamentals_all", "fundamentals_range")])
def test_whole_tables_are_read_beside_the_ranges(spark, name, within):
    whole, part = ({tuple(r) for r in QUERIES[q](spark, FOLDER).collect()} for q in (name, within))
    assert len(whole) > len(part) and {s[0] for s in whole} > {s[0] for s in part}


def test_names_agree():
    assert set(SQL) <= set(QUERIES)

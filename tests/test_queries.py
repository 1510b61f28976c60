"""The registered queries: complete, well formed and equal to their SQL."""

import duckdb
import pytest
from conftest import SF

import __spark_entry__ as entry
from check import TABLES, compare, rows_of
from counterpane.plans.oracles import ORACLES
from counterpane.plans.queries import QUERIES

WITHOUT_SQL = {"searched_masks", "explain_all", "explain_best", "explain_unweighted", "results_text",
               "explained_count"}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def test_inventory():
    assert set(ORACLES) == set(QUERIES) - WITHOUT_SQL
    assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().keys() >= ORACLES.keys()


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "nun_id", "nun_label", "nun_confidence", "dist"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert compare(rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(cols, cur.fetchall())) is None


def test_jobs_search_with_the_defaults(spark, monkeypatch):
    from counterpane.operators.search import SearchSettings
    from counterpane.plans import queries

    class Called(Exception):
        pass

    def stop(*args, **params):
        raise Called(args, params)

    monkeypatch.setattr(queries, "explain", stop)
    monkeypatch.setattr(queries, "search_masks", stop)
    for name in sorted(WITHOUT_SQL):
        with pytest.raises(Called) as call:
            QUERIES[name](spark, SF)
        args, params = call.value.args
        assert not {"population_size", "maximum_number_of_generations"} & params.keys()
        assert name != "searched_masks" or args[2] == SearchSettings(theta=queries.THETA)

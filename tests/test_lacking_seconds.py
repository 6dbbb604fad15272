"""Queries on seconds against their SQL where clips lack seconds, the first one too."""

import pytest
from test_queries import QUERIES, SQL, rows_of

PLANS = ["b06_equal_budget_plan", "b07_balanced", "b07_bridge", "b07_distance_high", "b07_farthest", "b07_farthest_high", "b07_mixed", "b07_score", "b08_band_plan", "b13_b14_features_by_plan"]


@pytest.fixture(scope="module")
def lacking(sf_dir, tmp_path_factory):
    """The smallest events without the second that a clip's id names; (folder, connection)."""
    import duckdb

    folder, con = tmp_path_factory.mktemp("lacking"), duckdb.connect()
    con.execute(f"copy (select * from '{sf_dir}/events.parquet' where floor((day(ts) - 1) / 3) <> user_id % 10) to '{folder}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", [*PLANS, "f03_random_seconds", "f06_hybrid_long", "p17_repeat_last", "q04_long_plan", "s13_score_cache"])
def test_matches_sql(spark, lacking, name):
    folder, con = lacking
    df, result = QUERIES[name](spark, folder), con.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())

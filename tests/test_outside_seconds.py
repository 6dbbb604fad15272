"""Plans against their SQL where clips have seconds outside 0..9, and seconds whose values are all unknown."""

import pytest
from test_queries import QUERIES, SQL, rows_of

PLANS = ["b06_equal_budget_plan", "b07_balanced", "b07_bridge", "b07_distance_high", "b07_farthest", "b07_farthest_high", "b07_mixed", "b07_score"]


@pytest.fixture(scope="module")
def outside(sf_dir, tmp_path_factory):
    """The smallest events, a few again some months later or earlier, some without a value; (folder, connection)."""
    import duckdb

    folder, con = tmp_path_factory.mktemp("outside"), duckdb.connect()
    con.execute(f"""copy (with e as (select * from '{sf_dir}/events.parquet')
        select * replace (case when floor((day(ts) - 1) / 3) = user_id % 7 then null else value end as value) from e
        union all select * replace (ts + interval 40 day as ts, value * 3 as value) from e where event_id % 5 = 0
        union all select * replace (ts - interval 35 day as ts) from e where event_id % 7 = 0) to '{folder}/events.parquet' (format parquet)""")
    con.execute(f"create view events as select * from '{folder}/events.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", PLANS)
def test_matches_sql(spark, outside, name):
    folder, con = outside
    df, result = QUERIES[name](spark, folder), con.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())

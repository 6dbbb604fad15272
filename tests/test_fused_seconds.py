"""Fused scores against their SQL where clips lack seconds, have some outside 0..9, or ones whose values are all unknown."""

import pytest
from test_queries import QUERIES, SQL, rows_of

ODD = {
    "lacking": "select * from e where floor((day(ts) - 1) / 3) <> user_id % 10",
    "outside": "select * from e union all select * replace (ts + interval 40 day as ts) from e where event_id % 5 = 0 union all select * replace (ts - interval 35 day as ts) from e where event_id % 7 = 0",
    "unknown": "select * replace (case when floor((day(ts) - 1) / 3) = user_id % 7 then null else value end as value) from e",
    "no_key": "select * from e union all select * replace (null as ts) from e where event_id % 5 = 0 union all select * replace (null as user_id) from e where event_id % 7 = 0",
}


@pytest.mark.parametrize("odd", ODD)
def test_matches_sql(spark, sf_dir, tmp_path, odd):
    import duckdb

    con = duckdb.connect()
    con.execute(f"copy (with e as (select * from '{sf_dir}/events.parquet') {ODD[odd]}) to '{tmp_path}/events.parquet' (format parquet)")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    df, result = QUERIES["t22_fused_av"](spark, str(tmp_path)), con.execute(SQL["t22_fused_av"])
    names = [c[0] for c in result.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())

"""The driver tables seen as clips and seconds, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _third_day(ts: str = "ts"):
    return F.floor(F.datediff(F.col(ts).cast("date"), F.lit("2024-01-01").cast("date")) / 3).cast("int")


def seg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, t, score, gt): log-energy of a user's values by tenth of the month; gt: a purchase above 100."""
    from .operators.series import log_energy

    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id"), _third_day().alias("t"), F.col("value").alias("amp"), ((F.col("event_type") == "purchase") & (F.col("value") > 100)).cast("int").alias("hit"))
    return log_energy(events, F.max("hit").alias("gt"))


def seg10b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, t, score): the same from views and clicks alone; seconds without any have 0."""
    from .operators.series import log_energy, pad_to

    events = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    return pad_to(log_energy(events.select(F.col("user_id").alias("clip_id"), _third_day().alias("t"), F.col("value").alias("amp"))), 10, clips=table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_id")).distinct())


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(plan_id, window_id, duration, weight): line items as time windows of an order. They are dealt out by plan, so
    that what works on plans has them together and doesn't shuffle them again."""
    return table(spark, sf_dir, "lineitem").repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("window_id")).agg(F.sum("l_quantity").alias("duration"), F.max("l_discount").alias("weight"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, method, seed, correct): orders as predictions."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("item_id"), F.col("o_orderpriority").alias("method"), (F.col("o_orderkey") % 5).cast("int").alias("seed"), (F.col("o_orderstatus") == "F").cast("int").alias("correct"), F.col("o_totalprice").alias("q_bar"))


SEG = """seg as (select user_id as clip_id, cast(floor(date_diff('day', date '2024-01-01', cast(ts as date)) / 3) as int) as t,
    ln(avg(value * value) + 1e-12) as score, max(case when event_type = 'purchase' and value > 100 then 1 else 0 end) as gt from events group by 1, 2)"""
SEGB = """rawb as (select user_id as clip_id, cast(floor(date_diff('day', date '2024-01-01', cast(ts as date)) / 3) as int) as t, ln(avg(value * value) + 1e-12) as score
    from events where event_type in ('view', 'click') group by 1, 2),
segb as (select c.clip_id, cast(g.t as int) as t, coalesce(r.score, 0) as score from (select distinct user_id as clip_id from events) c cross join range(10) g(t) left join rawb r on r.clip_id = c.clip_id and r.t = g.t)"""
WINDOWS = """win as (select l_orderkey as plan_id, l_linenumber as window_id, sum(l_quantity) as duration, max(l_discount) as weight from lineitem group by 1, 2)"""
RESULTS = """res as (select o_orderkey as row_id, o_custkey as item_id, o_orderpriority as method, cast(o_orderkey % 5 as int) as seed, case when o_orderstatus = 'F' then 1 else 0 end as correct, o_totalprice as q_bar from orders)"""

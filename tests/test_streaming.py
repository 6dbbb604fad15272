"""Selection on clips as they close: late and out-of-order rows, restarts, and state that shrinks."""

import math
import os
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kairolake.operators import anchors as K
from kairolake.streaming import windows as W

SCHEMA = "clip_id long, ts timestamp_ntz, amp double"
START = datetime(1970, 1, 1)
DAY = 86_400


def at(day, clip=1, amp=1.0):
    return (clip, START + timedelta(days=day), amp)


@pytest.fixture
def feed(spark, tmp_path):
    """Adds files of rows in order, and the stream that reads one file a batch."""
    folder, added = tmp_path / "in", []
    folder.mkdir()

    def add(*rows):
        added.append(rows)
        name = folder / f"{len(added)}.parquet"
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.timestamp("us"), pa.float64()))]
        pq.write_table(pa.table(columns, ["clip_id", "ts", "amp"]), name)
        os.utime(name, (len(added) * 100 + 1e9, len(added) * 100 + 1e9))

    def clips():
        rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")
        return W.closing_clips(rows.withColumn("ts", F.col("ts").cast("timestamp")), DAY, 5 * DAY, "1 day")

    def run(select=lambda rows: K.top_k(rows, 2)):
        out, late = W.selected_once(spark, clips(), select, f"file://{tmp_path}/out")
        return sorted((r["clip_id"], (r["start"] - START).days, r["rank"], r["t"]) for r in out.collect()), late

    return add, run, clips


def test_clips_appear_once_when_they_close(feed):
    add, run, _ = feed
    add(at(0.5, amp=2.0), at(1.2, amp=9.0), at(0.1, clip=2), at(3.0, amp=5.0))
    assert run() == ([], 0)  # nothing is a day past its end
    add(at(5.5), at(6.5, clip=2))
    assert run() == ([(1, 0, 1, 1), (1, 0, 2, 3), (2, 0, 1, 0)], 0)
    add(at(12.0, clip=3))  # a clip of its own moves the watermark for all
    assert run()[0] == [(1, 0, 1, 1), (1, 0, 2, 3), (1, 5, 1, 0), (2, 0, 1, 0), (2, 5, 1, 1)]


def test_rows_out_of_order_count_and_late_ones_are_dropped(feed):
    add, run, _ = feed
    add(at(3.9, amp=1.0), at(4.5, amp=2.0))
    add(at(3.6, amp=50.0), at(4.1, amp=3.0))  # the watermark is at 3.5: second 3 is open still
    add(at(8.0, clip=2))
    add(at(1.0, amp=99.0), at(2.0, amp=99.0), at(9.0))  # both seconds closed long ago
    got, late = run()
    assert [r for r in got if r[1] == 0] == [(1, 0, 1, 3), (1, 0, 2, 4)] and late == 2


def test_restart_goes_on_from_the_checkpoint(feed):
    """State of open clips survives between runs; what was appended isn't appended again."""
    add, run, _ = feed
    add(at(0.5, amp=3.0))
    add(at(2.5, amp=4.0))
    assert run() == ([], 0)
    add(at(1.9, amp=7.0))
    add(at(20.0))
    first, late = run()
    assert first == [(1, 0, 1, 1), (1, 0, 2, 2)] and late == 0  # day 1 came with the second run, day 2 with the first
    assert run() == (first, 0)


def test_scores_and_counts(spark, feed, tmp_path):
    add, _, clips = feed
    add(at(0.1, amp=3.0), at(0.2, amp=4.0), at(2.0, amp=None), (None, START, 1.0), (1, None, 1.0))
    add(at(30.0))
    query = W.select_closed(clips(), lambda rows: rows, f"file://{tmp_path}/all", f"file://{tmp_path}/check", availableNow=True)
    query.awaitTermination()
    got = {(r["t"]): r["score"] for r in spark.read.parquet(f"file://{tmp_path}/all").collect()}
    assert got == {0: pytest.approx(math.log(12.5 + 1e-12)), 2: pytest.approx(math.log(1e-12))}


def test_closed_clips_leave_the_state(spark, feed, tmp_path):
    add, _, clips = feed
    for day in range(0, 60, 3):
        add(*[at(day + 0.1 * c, clip=c) for c in range(5)])
    query = W.select_closed(clips(), lambda rows: K.top_k(rows, 1), f"file://{tmp_path}/all", f"file://{tmp_path}/check", availableNow=True)
    query.awaitTermination()
    states = [[op.numRowsTotal for op in p.stateOperators] for p in query.recentProgress if p.stateOperators]
    assert len(states) >= 20 and max(max(s) for s in states) <= 30  # five clips have 100 seconds in all
    assert spark.read.parquet(f"file://{tmp_path}/all").groupBy("clip_id", "start").count().where("count > 1").count() == 0

"""The score windows as Structured Streaming: tumbling and sliding log-energy with a watermark for late events, and
anchor selection on clips as they close."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.shared import scratch


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of (clip_id, ts, amp)."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else f"{sf_dir}/event[s].parquet")
    return rows.select(F.col("user_id").alias("clip_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("amp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(jpath).isDirectory()


def _energy(rows: DataFrame, window, late: str) -> DataFrame:
    by = rows.withWatermark("ts", late).groupBy("clip_id", window.alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.log(F.avg(F.col("amp") * F.col("amp")) + 1e-12).alias("score")).select("clip_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "score")


def tumbling_energy(rows: DataFrame, size: str, late: str = "1 day") -> DataFrame:
    return _energy(rows, F.window("ts", size), late)


def sliding_energy(rows: DataFrame, size: str, stride: str, late: str = "1 day") -> DataFrame:
    return _energy(rows, F.window("ts", size, stride), late)


def run_once(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there, into a table in shared storage, and reads that back.

    Complete mode keeps windows that the watermark hasn't closed yet; a standing job would use append mode."""
    path = scratch(spark, f"stream-{name}")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table")

    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/table")


def closing_clips(rows: DataFrame, second: int, clip: int, late: str = "1 day") -> DataFrame:
    """(clip_id, start, n, seconds) of each clip once it has closed: a clip is what a ``clip_id`` has in ``clip`` seconds
    of event time, ``seconds`` its (t, score) with the log-energy of every ``second`` seconds that have rows.

    Two chained aggregations in append mode. State is a sum and a count for each open second and one row for each second
    of an open clip, never the rows themselves; a clip leaves the state when the watermark, ``late`` behind the latest
    row, has passed its end. Rows in any order count until their second has closed; later ones are dropped and counted
    by ``dropped``. Rows without a time or a clip's id are dropped by the first aggregation's filter."""
    named = rows.where(F.col("ts").isNotNull() & F.col("clip_id").isNotNull()).withWatermark("ts", late)
    energy = F.log(F.coalesce(F.avg(F.col("amp") * F.col("amp")), F.lit(0.0)) + 1e-12).alias("score")
    seconds = named.groupBy("clip_id", F.window("ts", f"{second} seconds").alias("s")).agg(F.count(F.lit(1)).alias("n"), energy)
    at = seconds.select("clip_id", F.window(F.window_time("s"), f"{clip} seconds").alias("w"), F.unix_seconds("s.start").alias("at"), "n", "score")
    clips = at.groupBy("clip_id", "w").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", "score"))).alias("s"))
    place = lambda x: F.struct(F.floor((x["at"] - F.unix_seconds("w.start")) / second).cast("int").alias("t"), x["score"].alias("score"))
    return clips.select("clip_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.transform("s", place).alias("seconds"))


def select_closed(clips: DataFrame, select: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream that sends the clips closed by each batch through ``select``, any selection of (clip_id, t, score),
    and appends what it gives, with the clip's start.

    A batch writes a folder of its own under ``path`` and would write the same one again after a failure, so that each
    clip appears once; ``checkpoint`` holds the progress and the state of open clips, from which a restart goes on."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(F.struct("clip_id", "start").alias("clip_id"), F.inline("seconds"))
        chosen = select(rows)
        chosen.select("clip_id.clip_id", "clip_id.start", *[c for c in chosen.columns if c != "clip_id"]).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return clips.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def dropped(query: StreamingQuery) -> int:
    """Rows that came too late, by the progress reports that the query still has."""
    return sum(int(op.numRowsDroppedByWatermark) for p in query.recentProgress for op in p.stateOperators)


def selected_once(spark: SparkSession, clips: DataFrame, select: Callable[[DataFrame], DataFrame], path: str) -> tuple[DataFrame, int]:
    """Runs ``select_closed`` over what is there and goes on where an earlier run with ``path`` ended: (everything that
    was ever appended, rows that this run dropped as late)."""
    query = select_closed(clips, select, f"{path}/table", f"{path}/checkpoint", availableNow=True)
    query.awaitTermination()
    return spark.read.parquet(f"{path}/table").drop("epoch"), dropped(query)

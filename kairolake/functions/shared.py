"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; only on a single machine, where that may be unset, under a
    temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        root = _LOCAL[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str, group_bytes: int | None = None) -> DataFrame:
    """The rows written once and read back: later uses don't repeat their plan, and lost executors don't lose them.
    Smaller row groups (``group_bytes``) let more tasks read what few tasks wrote."""
    path = scratch(rows.sparkSession, name)
    (rows.write.option("parquet.block.size", group_bytes) if group_bytes else rows.write).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a side of a join that grows with the input: both sides are shuffled. The size of its files or of its
    shuffle may be under the broadcast threshold while its hash table takes thirty times as much of the driver."""
    return rows.hint("merge")

"""Dataset verification: the files that are there against what the annotations ask of them."""

from __future__ import annotations

from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.stats import sizes_summary
from ..sources.readers import file_inventory

STATES = ("ok", "missing", "pointer", "unprobed", "short", "unasked")


def media_files(spark: SparkSession, root: str, pattern: str = "*.mp4") -> DataFrame:
    """(dataset, id, path, length) of the files below ``root``, which must exist: the dataset is the first folder below
    it, the id the file's name without extension. Folders are listed, contents aren't read."""
    base = urlparse(root).path.rstrip("/")
    below = F.regexp_extract("path", rf"\Q{base}\E/(.*)$", 1)
    files = file_inventory(spark, root, pattern)
    return files.select(F.regexp_extract(below, "^([^/]+)/", 1).alias("dataset"), F.regexp_extract(below, r"([^/]+?)(?:\.[^./]*)?$", 1).alias("id"), "path", "length")


def verify_files(required: DataFrame, files: DataFrame, durations: DataFrame, margin_s: float = 0.1, pointer_bytes: int = 1024) -> DataFrame:
    """(dataset, id, need_s, copies, length, have_s, shortfall_s, status) of every id that is asked for or found.

    ``required(dataset, id, stop_s)``: annotations, many an id; ``files(dataset, id, length)``; ``durations(dataset, id,
    have_s)``: probed lengths. The longest stop is what an id needs, its largest file what it has. Status, the first
    that holds: ``unasked``; ``missing``; ``pointer`` (at most ``pointer_bytes``); ``unprobed`` (a stop but no
    duration); ``short`` (by more than ``margin_s``); ``ok``. Ids whose stops are all null are asked for, but can't be
    short. Rows with a null dataset or id count nowhere; a duration alone makes no row. One shuffle for the three."""
    parts = {"stop_s": required, "length": files, "have_s": durations}
    kinds = {"stop_s": "double", "length": "long", "have_s": "double"}
    rows = None
    for own, table in parts.items():
        values = [(F.col(c) if c == own else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
        part = table.where("dataset is not null and id is not null").select("dataset", F.col("id").cast("string").alias("id"), F.lit(own).alias("of"), *values)
        rows = part if rows is None else rows.unionAll(part)
    of = lambda name: F.count_if(F.col("of") == name)
    each = rows.groupBy("dataset", "id").agg(F.max("stop_s").alias("need_s"), of("stop_s").alias("asked"), of("length").alias("copies"), F.max("length").alias("length"), F.max("have_s").alias("have_s")).where("asked > 0 or copies > 0")
    each = each.withColumn("shortfall_s", F.col("need_s") - F.col("have_s") - margin_s)
    status = (
        F.when(F.col("asked") == 0, "unasked")
        .when(F.col("copies") == 0, "missing")
        .when(F.col("length") <= pointer_bytes, "pointer")
        .when(F.col("need_s").isNotNull() & F.col("have_s").isNull(), "unprobed")
        .when(F.col("shortfall_s") > 0, "short")
        .otherwise("ok")
    )
    return each.select("dataset", "id", "need_s", "copies", "length", "have_s", "shortfall_s", status.alias("status"))


def dataset_status(verified: DataFrame, files: DataFrame, small_bytes: int = 5_000_000) -> DataFrame:
    """One row a dataset: ids required and of each status, ids with several files, small files, the sizes of all files,
    and ``ready``: something is required, nothing of it is missing or a pointer. ``advice`` says what to do."""
    asked = F.col("status") != "unasked"
    count = lambda condition, name: F.count_if(condition).alias(name)
    rows = verified.groupBy("dataset").agg(count(asked, "required"), *[count(F.col("status") == s, s) for s in STATES], count(F.col("copies") > 1, "duplicates"), F.round(F.max(F.greatest("shortfall_s", F.lit(0.0))), 6).alias("worst_s"))
    known = files.where("dataset is not null and id is not null").select("dataset", "length")
    sizes = sizes_summary(known, ["dataset"], "length").withColumnRenamed("n", "files").join(known.groupBy("dataset").agg(F.count_if(F.col("length") <= small_bytes).alias("small")), "dataset")
    hints = {"missing": "fetch the missing files", "pointer": "replace pointers by their content", "unprobed": "probe the durations", "short": "import the whole recordings", "duplicates": "keep one file an id"}
    advice = F.array_compact(F.array(*[F.when(F.col(c) > 0, text) for c, text in hints.items()]))
    ready = (F.col("required") > 0) & (F.col("missing") == 0) & (F.col("pointer") == 0)
    return rows.join(sizes, "dataset", "left").withColumns({"files": F.coalesce("files", F.lit(0)), "small": F.coalesce("small", F.lit(0)), "ready": ready, "advice": advice})


def worst_shortfalls(verified: DataFrame, n: int = 20) -> DataFrame:
    """(dataset, place, id, shortfall_s): a report of the ``n`` files of each dataset that lack most, ties by id."""
    order = Window.partitionBy("dataset").orderBy(F.desc("shortfall_s"), "id")
    return verified.where("status = 'short'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select("dataset", "place", "id", "shortfall_s")

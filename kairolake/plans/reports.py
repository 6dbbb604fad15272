"""One long report over the result tables of an evaluation, and the decision on a configuration with its reasons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melted(rows: DataFrame, section: str, keys: list[str], metrics: list[str]) -> DataFrame:
    """(section, item, metric, value): a row for each metric of each row. The item joins the keys by ``|``, null keys
    left out; true and false become 1 and 0, a null metric stays null. One narrow step, nothing is shuffled."""
    kinds = dict(rows.dtypes)
    value = lambda c: (F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c)).cast("double")
    item = F.concat_ws("|", *[F.col(k).cast("string") for k in keys]) if keys else F.lit("")
    return rows.select(F.lit(section).alias("section"), item.alias("item"), F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), value(m).alias("value")) for m in metrics])))


def long_report(sections: dict[str, tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """All sections (rows, keys, metrics) as one table; without sections it raises."""
    if not sections:
        raise ValueError("a report needs a section")
    return reduce(DataFrame.unionAll, [melted(rows, name, keys, metrics) for name, (rows, keys, metrics) in sections.items()])


def gain_over(answers: DataFrame, reference: str) -> DataFrame:
    """(method, item_id, gain) of ``answers(method, item_id, correct)`` against the reference method on the same item;
    items that the reference hasn't answered are left out."""
    base = answers.where(F.col("method") == reference).select("item_id", F.col("correct").alias("base"))
    return answers.where(F.col("method") != reference).join(base, "item_id").select("method", "item_id", (F.col("correct") - F.col("base")).cast("double").alias("gain"))


def decisions(causes: DataFrame, tested: DataFrame, delta: float, p: float) -> DataFrame:
    """(config, promote, delta, p, causes, first): whether a configuration goes on, that is gains at least ``delta``
    with a smaller p than ``p``, beside what speaks against it. A configuration without a test isn't promoted."""
    go = F.coalesce((F.col("delta") >= delta) & (F.col("p") < p), F.lit(False))
    rows = causes.select("config", F.size("reasons").alias("causes"), F.get("reasons", F.lit(0)).alias("first"))
    return rows.join(tested.select("config", "delta", "p"), "config", "left").select("config", go.alias("promote"), "delta", "p", "causes", "first")

"""Reports over several result tables: keys, nulls, decisions."""

import pytest

from kairolake.plans import reports as P


def test_long_report(spark):
    a = spark.createDataFrame([("x", 1, 2, True), ("y", None, None, False)], "method string, bucket int, n long, good boolean")
    b = spark.createDataFrame([(0.5,)], "acc double")
    got = {tuple(r) for r in P.long_report({"a": (a, ["method", "bucket"], ["n", "good"]), "b": (b, [], ["acc"])}).collect()}
    assert got == {("a", "x|1", "n", 2.0), ("a", "x|1", "good", 1.0), ("a", "y", "n", None), ("a", "y", "good", 0.0), ("b", "", "acc", 0.5)}
    with pytest.raises(ValueError):
        P.long_report({})


def test_gain_over(spark):
    rows = spark.createDataFrame([("u", 1, 1), ("u", 2, 0), ("m", 1, 0), ("m", 2, 1), ("m", 3, 1)], "method string, item_id int, correct int")
    assert sorted(tuple(r) for r in P.gain_over(rows, "u").collect()) == [("m", 1, -1.0), ("m", 2, 1.0)]
    assert P.gain_over(rows, "none").count() == 0


def test_decisions(spark):
    causes = spark.createDataFrame([("good", []), ("weak", ["gain_below_target", "not_significant"]), ("untested", ["coverage_low"])], "config string, reasons array<string>")
    tested = spark.createDataFrame([("good", 0.02, 0.01), ("weak", 0.02, 0.2)], "config string, delta double, p double")
    got = {r["config"]: (r["promote"], r["causes"], r["first"]) for r in P.decisions(causes, tested, 0.01, 0.05).collect()}
    assert got == {"good": (True, 0, None), "weak": (False, 2, "gain_below_target"), "untested": (False, 1, "coverage_low")}

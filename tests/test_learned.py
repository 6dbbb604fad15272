"""Heads on rows that they weren't fitted on: what a straight line can't part, several classes, context in time, gates."""

import random

from pyspark.sql import functions as F

from kairolake.operators import learned as M

ROWS = "clip_id int, t int, features array<double>, label int"


def right(rows):
    """Share of right answers on odd clips."""
    return rows.where("clip_id % 2 = 1").agg(F.avg((F.col("label") == F.col("answer")).cast("double"))).first()[0]


def answered(rows, model):
    return M.predict(model, rows).withColumn("answer", (F.col("p") >= 0.5).cast("int"))


def test_perceptron_parts_what_a_line_cannot(spark):
    rng = random.Random(2)
    data = [(c, t, [x := rng.uniform(-1, 1), 50 + 10 * (y := rng.uniform(-1, 1))], int(x * y > 0)) for c in range(40) for t in range(20)]
    rows = spark.createDataFrame(data, ROWS)
    train = rows.where("clip_id % 2 = 0")
    assert right(answered(rows, M.mlp(train, [2, 8, 2], iterations=100))) > 0.9 > 0.7 > right(answered(rows, M.logistic(train)))


def test_segment_head_names_its_class(spark):
    rng = random.Random(3)
    centres = [(0, 0), (4, 0), (0, 4)]
    data = [(c, t, [centres[k][0] + rng.gauss(0, 0.6), centres[k][1] + rng.gauss(0, 0.6)], k) for c in range(30) for t in range(12) for k in [rng.randrange(3)]]
    rows = spark.createDataFrame(data, ROWS)
    seen = M.predict_class(M.mlp(rows.where("clip_id % 2 = 0"), [2, 6, 3], iterations=60), rows)
    assert right(seen.withColumn("answer", F.col("prediction").cast("int"))) > 0.95
    assert seen.where(F.abs(F.aggregate("chance", F.lit(0.0), lambda a, x: a + x) - 1) > 1e-9).count() == 0


def test_temporal_head_sees_its_neighbours(spark):
    """The label is the sign of the second before: nothing in the second itself tells it."""
    rng = random.Random(4)
    data = []
    for c in range(40):
        x = [rng.uniform(-1, 1) for _ in range(20)]
        data += [(c, t, [x[t]], int(t > 0 and x[t - 1] > 0)) for t in range(20)]
    rows = spark.createDataFrame(data, ROWS)
    near = M.with_context(rows, 1)
    assert near.where(F.size("features") != 3).count() == 0
    assert near.where("clip_id = 0").orderBy("t").first()["features"] == [0.0, data[0][2][0], data[1][2][0]]
    head = lambda r, n: right(answered(r, M.mlp(r.where("clip_id % 2 = 0"), [n, 8, 2], iterations=60)))
    assert head(near, 3) > 0.9 > 0.65 > head(rows, 1)


def test_gate_rows_and_gate(spark):
    rng = random.Random(5)
    data = [(c, 0, [x := rng.uniform(-1, 1), rng.uniform(-1, 1)], int(x > 0.3)) for c in range(300)]
    rows = spark.createDataFrame(data, ROWS)
    train = M.gate_rows(rows, F.col("clip_id") % 2 == 0)
    assert train.count() == 150 and right(answered(rows, M.logistic(train))) > 0.9
    assert M.gate_rows(rows, F.col("clip_id") < 63) is None and M.gate_rows(rows, F.col("label") == 1) is None
    assert M.gate_rows(rows.where("false"), F.lit(True)) is None

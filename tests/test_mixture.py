"""The mixture of background, anchors and best scores is settled in a clip's row."""

from kairolake.operators import seconds as S
from kairolake.plans import jobs as Q


def scored(spark):
    """Ties, an unknown score, a second beyond the clip, and a clip of one second."""
    rows = [("a", 1, t, s) for t, s in enumerate([5.0, 1.0, 9.0, 9.0, None, 2.0])] + [("a", 1, 12, 99.0), ("a", 2, 3, 1.0), ("b", 1, 0, 4.0), ("b", 1, 5, None)]
    return spark.createDataFrame(rows, "method string, clip_id long, t int, score double")


def brute(rows, k, budget, alpha, radius, n):
    out = []
    for key in {r[:2] for r in rows}:
        own = [(t, s) for *key_, t, s in rows if tuple(key_) == key]
        top = [t for t, s in sorted(own, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))][:k]
        order = [(t, "background") for t in sorted({round(i * (n - 1) / (round(alpha * budget) - 1)) for i in range(round(alpha * budget))})]
        order += [(a + d, "anchor") for a in top for d in sorted(range(-radius, radius + 1), key=lambda d: (abs(d), d)) if 0 <= a + d < n]
        order += [(t, "score") for t, s in sorted(own, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])) if t < n]
        first = {}
        for t, role in order:
            first.setdefault(t, role)
        out += [(*key, t, role) for t, role in list(first.items())[:budget]]
    return sorted(out)


def test_select_by_method(spark):
    scores = scored(spark)
    rows = [tuple(r) for r in scores.collect()]
    for k, budget in ((2, 6), (1, 9)):
        got = Q.select_by_method(scores, k, budget, 0.5, 1, 10)
        assert sorted(map(tuple, got.collect())) == brute(rows, k, budget, 0.5, 1, 10)


def test_one_shuffle_and_no_window(spark):
    plan = Q.select_by_method(scored(spark), 2, 6, 0.5, 1, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Sort [" not in plan


def test_unknown_scores_come_last(spark):
    scores = scored(spark).where("method = 'a' and clip_id = 1").select("clip_id", "t", "score")
    none = spark.createDataFrame([], "clip_id long, rank int, t int")
    got = [r["t"] for r in S.alpha_mixture(scores, none, 6, 0.0, 1, 10).collect()]
    assert got == [2, 3, 0, 5, 1, 4]


def test_uniform_list(spark):
    clip = spark.createDataFrame([(1,)], "clip_id long")
    for total in (1, 2, 7, 10, 11):
        for n in range(1, total + 2):
            assert S.uniform_list(n, total) == sorted(r["t"] for r in S.uniform_seconds(clip, n, total).collect())

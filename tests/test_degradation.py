"""Degraded energies of a whole grid against the three perturbations cell by cell."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairolake.operators import perturb as D
from kairolake.operators import series as T
from kairolake.plans import head_jobs as Q

CELLS = [(0.0, float("inf"), 0.0), (0.5, 10.0, 0.25), (-1.25, 0.0, 0.0), (2.0, -5.0, 0.5), (0.0, 20.0, 1.0), (30.0, 5.0, 0.1)]
RATE, N, SEED = 4, 6, 3


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(8)
    rows = [(c, i, None if (c, i) == (2, 5) else float(rng.normal() * (1 + i % 5))) for c, size in ((1, 24), (2, 17), (3, 1), (4, 60)) for i in range(size)]
    return spark.createDataFrame(rows, "clip_id long, idx long, amp double")


def test_grid_is_cell_by_cell(spark, samples):
    got = {(r["cell"], r["clip_id"], r["t"]): r["score"] for r in D.degraded_energy(samples, CELLS, RATE, N, SEED).collect()}
    assert len(got) == len(CELLS) * 4 * N
    whole = samples.withColumn("amp", F.coalesce("amp", F.lit(0.0)))
    for i, (shift, snr, ratio) in enumerate(CELLS):
        moved = D.shift_samples(whole, shift, RATE)
        noisy = D.add_noise(moved, snr, SEED) if snr < 1e9 else moved
        want = {(r["clip_id"], r["t"]): r["score"] for r in T.padded_log_energy(D.silence(noisy, ratio, SEED), RATE).collect()}
        for clip in (1, 2, 3, 4):
            for t in range(N):
                assert got[i, clip, t] == pytest.approx(want.get((clip, t), np.log(1e-12)), abs=1e-6), (i, clip, t)


def test_samples_are_read_once_and_combined_before_the_shuffle(samples):
    plan = D.degraded_energy(samples, CELLS, RATE, N, SEED)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan


def test_empty(spark, samples):
    assert D.degraded_energy(samples.limit(0), CELLS, RATE, N, SEED).count() == 0


def test_report(spark):
    """Means, deviation, margin and the failing cells of a few rows."""
    rows = [(0.0, 20.0, 0.0, a, s, 0.8, 0.7, v + s / 10, 0.0, 0.1, 0.5) for a, v in ((0.0, 0.2), (0.5, 0.3), (1.0, 0.75)) for s in (0, 1)]
    report = Q.degradation_report(spark.createDataFrame(rows, "shift double, snr double, silence double, alpha double, seed int, acc_uniform double, acc_random double, acc_anchored double, forced double, fallback double, recall_0 double"))
    got = {r["alpha"]: r for r in report.collect()}
    assert got[0.5]["margin"] == pytest.approx(0.35 - 0.4) and not got[0.5]["ok"] and got[0.0]["ok"] and got[1.0]["ok"]
    assert got[0.5]["std"] == pytest.approx(np.std([0.3, 0.4], ddof=1)) and got[0.5]["recall_0"] == 0.5
    line = Q.floor_summary(report).first()
    assert (line["rows"], line["passes"], line["fails"]) == (3, 2, 1) and line["min_margin"] == pytest.approx(-0.05) and [w["alpha"] for w in line["worst"]] == [0.5]

"""IVF hardness from nearest lists, and the scans that reports need."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from knnhard.operators import ivf, scan
from knnhard.plans import fixtures as fx
from knnhard.plans import results as RS
from knnhard.session import keep


def _rows(df):
    return sorted(map(tuple, df.select("qid", "nprobe", "distcomp", "recall").collect()))


@pytest.mark.parametrize("metric", ["euclidean", "angular"])
@pytest.mark.parametrize("own", [False, True])
def test_hardness_from_lists_equals_the_curve(spark, metric, own):
    """Also for queries whose list ends within the threshold (40 copies of a vector) and for vectors that are no numbers."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:40] = x[0]
    x[77, 2] = np.nan
    v = keep(spark.createDataFrame([(int(i) + 5, [float(a) for a in r]) for i, r in enumerate(x)], "id long, v array<double>"))
    q = v.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    whole = v.where("NOT exists(v, t -> isnan(t))")
    c = ivf.train_lloyd(whole, 9, 2, metric=metric)
    a = keep(ivf.assign(v, c, metric))
    for k in (1, 10):
        curve = ivf.first_satisfying(ivf.sweep(v, q, c, a, k, metric, own), "qid", "nprobe", F.col("recall") >= 0.95)
        got = _rows(ivf.hardness(v, q, c, a, k, 0.95, metric, own))
        assert got == _rows(curve) and len(got) == 299
        lists = keep(scan.profile(v, q, metric, 21, own))
        assert _rows(ivf.hardness(v, q, c, a, k, 0.95, metric, own, lists=lists)) == got


def test_reports_scan_the_pairs_as_often_as_they_need(spark, monkeypatch):
    """Performance rows of both k come from one scan, metric rows from a profile and one count of thresholds."""
    calls = []
    for name in ("nearest_lists", "profile", "within_counts"):
        real = getattr(scan, name)
        monkeypatch.setattr(scan, name, lambda v, q, *a, name=name, real=real, **k: calls.append((name, v.columns)) or real(v, q, *a, **k))
    monkeypatch.setattr(RS, "_WRITTEN", {})
    assert RS.perf_rows(spark, SF).count() == 2 * fx.queries(spark, SF).count()
    assert [c for c, _ in calls] == ["nearest_lists"]
    calls.clear()
    assert RS.metric_rows(spark, SF).count() == fx.queries(spark, SF).count()
    assert [c for c, _ in calls] == ["profile", "within_counts"]

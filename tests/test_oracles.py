"""Registered queries against their DuckDB oracles (driver-style compare) on sf0.001."""

import pytest

import __spark_entry__ as E
from conftest import SF
from oracle_check import canon

FAST = ["nan_repair", "finite_check", "drop_zero", "l2_normalise", "pad8", "ip_lift", "validate_vectors",
        "sample_without", "sample_with", "holdout", "reset_last", "znorm", "knn", "range_join", "lid",
        "relative_contrast", "expansion", "eps_hardness", "eps_calibrate", "diameter", "metric_table",
        "ivf_hardness", "paa", "sax_encode", "bucket_split_once", "lower_bound", "sax_knn", "noise_queries",
        "perturb_angular", "rc_gradient", "gradient_step", "anneal_step", "config_key", "descriptor_parse",
        "group_means", "kendall", "quantile_bins", "correlation_table", "time_table", "verify_roundtrip",
        "load_text", "convert", "layout", "file_workload", "emit_queries", "stack_traces", "ground_truth_saved", "ivf_search"]


def test_every_query_has_an_oracle():
    from knnhard.plans import registry

    registry.load_all()
    q, o = registry.QUERIES, registry.ORACLES
    assert set(o) <= set(q)
    assert set(q) <= set(E.queries())
    assert set(q) == set(o)


@pytest.mark.parametrize("name", FAST)
def test_oracle(spark, duck, name):
    s = E.queries()[name](spark, SF).toPandas()
    d = duck.execute(E.oracle_sql()[name]).df()
    sc, sr = canon(s)
    dc, dr = canon(d)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr

"""Brute-force numpy checks, invariants and plan shape."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF
from knnhard.operators import distance as D
from knnhard.operators import hardness as H


def _np_vectors(spark):
    from knnhard.plans import fixtures as fx

    pdf = fx.vectors(spark, SF).orderBy("id").toPandas()
    return pdf["id"].to_numpy(), np.array(pdf["v"].tolist(), dtype=float)


def test_knn_and_measures_match_numpy(spark):
    from knnhard.operators import distance as D
    from knnhard.operators import hardness as H
    from knnhard.plans import fixtures as fx

    ids, X = _np_vectors(spark)
    v, q = fx.vectors(spark, SF), fx.queries(spark, SF).where("qid < 40")
    k = 5
    knn = D.knn(v, q, k, exclude_self=True).toPandas()
    meas = H.measures(v, q, k=k, exclude_self=True).toPandas().set_index("qid")
    for qi in range(40):
        d = np.sqrt(((X - X[qi]) ** 2).sum(1))
        d[qi] = np.inf
        order = np.lexsort((ids, d))[:k]
        got = knn[knn.qid == qi].sort_values("rank")
        assert list(got.id) == list(ids[order])
        ds = np.sort(d[np.isfinite(d)])
        w = ds[k]
        head = ds[:k + 1][ds[:k + 1] > 1e-5]
        lid = -len(head) / np.log(head / w).sum()
        assert math.isclose(meas.loc[qi, "lid"], lid, rel_tol=1e-9)
        assert math.isclose(meas.loc[qi, "rc"], ds.mean() / ds[k], rel_tol=1e-9)
        assert math.isclose(meas.loc[qi, "expansion"], ds[2 * k] / ds[k], rel_tol=1e-9)


def test_scan_equals_expression_path(spark):
    from knnhard.operators import distance as D
    from knnhard.plans import fixtures as fx

    v, q = fx.vectors(spark, SF), fx.queries(spark, SF).where("qid % 7 = 0")
    a = D.knn(v, q, 8, "angular", exclude_self=True).toPandas().sort_values(["qid", "rank"])
    b = D.knn(v, q, 8, "angular", exclude_self=True, method="pairs").toPandas().sort_values(["qid", "rank"])
    assert list(a.id) == list(b.id)
    assert np.allclose(a.d.to_numpy(), b.d.to_numpy(), atol=1e-12)


def test_kendall_matches_brute_force():
    from knnhard.operators.report import kendall_tau_b

    rng = np.random.default_rng(0)
    for n in (2, 5, 40, 200):
        x = rng.integers(0, 6, n).astype(float)
        y = rng.integers(0, 6, n).astype(float) + 0.5 * x
        i, j = np.triu_indices(n, 1)
        s = np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
        den = math.sqrt(np.abs(np.sign(x[i] - x[j])).sum() * np.abs(np.sign(y[i] - y[j])).sum())
        assert math.isclose(kendall_tau_b(x, y), s.sum() / den, rel_tol=1e-12, abs_tol=1e-12)


def test_exact_quantiles(spark):
    from knnhard.operators.quantiles import exact_quantiles

    df = spark.read.parquet(f"{SF}/lineitem.parquet")
    probs = [0.0, 0.013, 0.5, 0.99, 1.0]
    got = exact_quantiles(df, ["l_returnflag"], "l_extendedprice", probs, max_exact=50).toPandas()
    pdf = df.select("l_returnflag", "l_extendedprice").toPandas()
    for _, r in got.iterrows():
        want = np.quantile(pdf[pdf.l_returnflag == r.l_returnflag].l_extendedprice, r.p)
        assert math.isclose(r.q, want, rel_tol=1e-12)


def test_sax_lower_bound_and_pruned_search(spark):
    from knnhard.operators import distance as D
    from knnhard.operators import sax
    from knnhard.plans import fixtures as fx

    s = sax.summarise(fx.series_walk(spark, SF), 8)
    q = s.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    lb = sax.series_lower_bounds(s, q, 8, sax.segment_lengths(32, 8))
    d = D.pair_distances(s.select("id", "v"), q, "euclidean")
    bad = lb.join(d, ["qid", "id"]).where(F.col("lb") > F.col("d") + 1e-9).count()
    assert bad == 0
    lv = sax.build_leaves(s, 8, 10)
    assert lv.count() == s.count()
    ans, cnt = sax.sax_search(s, lv, q, 3, 8, exclude_self=True)
    exact = D.knn(s.select("id", "v"), q, 3, exclude_self=True)
    a = ans.select("qid", "rank", "id").toPandas().sort_values(["qid", "rank"])
    b = exact.select("qid", "rank", "id").toPandas().sort_values(["qid", "rank"])
    assert list(a.id) == list(b.id)
    h = cnt.toPandas()
    assert (h.hardness <= 1.0).all() and (h.hardness > 0).all()


def test_ivf_recall_monotone(spark):
    from knnhard.operators import ivf
    from knnhard.plans import fixtures as fx

    v, q = fx.vectors(spark, SF), fx.queries(spark, SF).where("qid < 30")
    c, a = ivf.build_index(v, iters=1)
    sw = ivf.sweep(v, q, c, a, 10, exclude_self=True).toPandas().sort_values(["qid", "nprobe"])
    for _, g in sw.groupby("qid"):
        assert (np.diff(g.recall.to_numpy()) >= 0).all()
        assert g.recall.iloc[-1] == 1.0


def test_vecfile_roundtrip_and_limit(spark, tmp_path):
    from knnhard.sources import vecfile as VF
    from knnhard.plans import fixtures as fx

    v = fx.vectors(spark, SF)
    path = str(tmp_path / "emb-angular-64-500.bin")
    VF.write_vectors(v, path, parts=3)
    back = VF.read_vectors(spark, path, rows_per_partition=64)
    assert back.count() == v.count()
    lim = VF.read_vectors(spark, path, limit=100, rows_per_partition=64)
    assert lim.count() == 100 and lim.agg(F.max("id")).first()[0] == 99
    j = v.join(back.withColumnRenamed("v", "w"), "id")
    assert j.where(F.col("v") != F.col("w")).count() == 0


def test_plans_broadcast_query_side(spark):
    from knnhard.operators import distance as D
    from knnhard.plans import fixtures as fx

    v, q = fx.vectors(spark, SF), fx.queries(spark, SF)
    plan = D.pair_distances(v, q.where("qid < 10"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "BuildRight" in plan
    scan_plan = D.knn(v, q.where("qid < 10"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in scan_plan or "PythonMapInArrow" in scan_plan
    pushed = fx.queries(spark, SF).where("qid < 10").select("qid")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(vec_id), LessThan(vec_id,10)]" in pushed


def test_text_vectors_positional_ids(spark, tmp_path):
    from knnhard.sources.tables import read_txt

    rows = [[1.0, 2.0, 3.0], [4.5, -1.0, 0.0], [7.0, 8.0, 9.25]]
    p = tmp_path / "v.txt"
    p.write_text("\n".join(" ".join(str(x) for x in r) for r in rows) + "\n")
    df = read_txt(spark, str(p)).orderBy("id").toPandas()
    assert list(df.id) == [0, 1, 2]
    assert [list(map(float, v)) for v in df.v] == rows


def test_gradient_matches_finite_differences(spark):
    from knnhard.operators import generate as G
    from knnhard.plans import fixtures as fx

    v = fx.vectors(spark, SF)
    q = fx.queries(spark, SF).where("qid = 3")
    g = G.rc_gradient(v, q, 10, exclude_self=True).first()
    x0 = np.array(q.first()["qv"], dtype=float)
    ids, X = _np_vectors(spark)
    keep = ids != 3

    def rc(x):
        d = np.sort(np.sqrt(((X[keep] - x) ** 2).sum(1)))
        return d.mean() / d[10]
    e = np.zeros_like(x0)
    for j in (0, 7, 31):
        e[:] = 0
        e[j] = 1e-6
        fd = (rc(x0 + e) - rc(x0 - e)) / 2e-6
        assert math.isclose(g["grad"][j], fd, rel_tol=1e-4, abs_tol=1e-7)


def test_result_layout_partition_pruning(spark, tmp_path):
    from knnhard.operators import catalog as C
    from knnhard.plans import fixtures as fx
    from knnhard.sources import tables as TB

    cat = C.catalogue(C.dataset_table(fx.table(spark, SF, "embeddings")))
    path = str(tmp_path / "layout")
    TB.write_layout(cat.select("dataset", "workload_key", "description"), path)
    one = cat.select("dataset", "workload_key").first()
    df = TB.read_layout(spark, path, one["dataset"], one["workload_key"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and df.count() == 1


def test_queries_fbin_roundtrip(spark, tmp_path):
    from knnhard.operators import generate as G
    from knnhard.plans import fixtures as fx
    from knnhard.sources import tables as TB

    q = G.noise_queries(fx.vectors(spark, SF), 10, 0.01).select(F.col("qid").alias("id"), F.col("qv").alias("v"))
    r = TB.write_queries_checked(q, str(tmp_path / "q-64-10.fbin")).first()
    assert r["n_a"] == r["n_b"] == 10 and r["n_mismatch"] == 0


def test_bucket_compactness_blocks_are_exact(spark):
    from knnhard.operators import sax
    from knnhard.plans import fixtures as fx

    s = sax.summarise(fx.series_walk(spark, SF), 8)
    lv = sax.build_leaves(s, 8, 40, max_levels=1)
    a = sax.bucket_compactness(s, lv).toPandas().set_index("bucket").sort_index()
    b = sax.bucket_compactness(s, lv, block=3).toPandas().set_index("bucket").sort_index()
    assert list(a.index) == list(b.index)
    assert np.allclose(a.compactness.to_numpy(), b.compactness.to_numpy(), rtol=1e-12, equal_nan=True)


def test_kendall_distributed_path_matches(spark):
    from knnhard.operators import report as R
    from knnhard.operators.report import kendall_tau_b

    rng = np.random.default_rng(3)
    rows = []
    for g in range(3):
        n = [1, 37, 70][g]
        x = rng.integers(0, 9, n).astype(float)
        y = rng.integers(0, 9, n).astype(float) - 0.3 * x
        rows += [(g, i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "g long, i long, a double, b double")
    dist = R.kendall(df, ["g"], [("a", "b")], block=8).toPandas().set_index("g")
    for g in range(3):
        sub = [(a, b) for gg, _, a, b in rows if gg == g]
        want = kendall_tau_b(np.array([t[0] for t in sub]), np.array([t[1] for t in sub]))
        got = dist.loc[g, "tau"]
        if math.isnan(want):
            assert got is None or (isinstance(got, float) and math.isnan(got))
        else:
            assert math.isclose(got, want, rel_tol=1e-12, abs_tol=1e-12)


def test_ground_truth_against_numpy(spark):
    """Lists and bins of every query, also when most tasks hold no row."""
    from knnhard.plans import fixtures as fx

    v, q = fx.vectors(spark, SF), fx.queries(spark, SF).where("qid < 25")
    X = {r["id"]: np.array(r["v"], dtype=float) for r in v.collect()}
    for parts in (2, 150):
        got = H.ground_truth(v.repartition(parts), q, maxk=40, exclude_self=True, bins=50).collect()
        assert len(got) == 25
        for r in got:
            d = np.sort([np.sqrt(((x - X[r["qid"]]) ** 2).sum()) for i, x in X.items() if i != r["qid"]])
            assert np.allclose(r["topk"], d[:40], rtol=1e-12)
            assert sum(r["hist_counts"]) == len(d)
            assert np.abs(np.cumsum(r["hist_counts"]) - np.searchsorted(d, r["hist_edges"][1:], "right")).max() <= 1


def test_ivf_search_plan_has_no_vector_shuffle_join(spark):
    from knnhard.operators import ivf
    from knnhard.plans import fixtures as fx

    v, q = fx.vectors(spark, SF), fx.queries(spark, SF).where("qid < 10")
    c, a = ivf.build_index(v, n_list=8, iters=1)
    plan = ivf.search(v, a, c, q, 2, 5)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan          # vectors are never joined with the assignment by a shuffle
    assert "BroadcastHashJoin" in plan          # probed cells reach the scan as a broadcast
    assert "WindowGroupLimit" in plan           # top-k per query is limited before the shuffle


def test_scan_plan_prunes_columns_and_merges_in_two_levels(spark):
    from knnhard.operators import scan
    from knnhard.plans import fixtures as fx

    v, q = fx.vectors(spark, SF), fx.queries(spark, SF).where("qid < 10")
    plan = scan.profile(v, q, m=3)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan  # label column pruned
    assert plan.count("Exchange hashpartitioning") >= 2                        # salted level, then per query


def test_query_side_size_check_and_batches(spark):
    from knnhard.operators import distance as D
    from knnhard.operators import scan
    from knnhard.plans import fixtures as fx

    v, q = fx.vectors(spark, SF), fx.queries(spark, SF)
    with pytest.raises(ValueError):
        scan.collect_queries(q, max_bytes=1024)          # 500 x 64 doubles > 1 KiB: refused, not broadcast
    a = D.knn_batched(v, q, 3, exclude_self=True, batch_size=64).toPandas().sort_values(["qid", "rank"])
    b = D.knn(v, q, 3, exclude_self=True).toPandas().sort_values(["qid", "rank"])
    assert list(a.id) == list(b.id) and len(a) == 3 * 500


def test_series_month_paa_and_sax_against_numpy(spark):
    from knnhard.operators import sax
    from knnhard.plans import fixtures as fx

    s = sax.summarise(fx.series_month(spark, SF), 16).toPandas()
    bp = np.array(sax.fixed_breakpoints())
    lens = sax.segment_lengths(80, 16)
    offs = np.concatenate([[0], np.cumsum(lens)])
    for _, r in s.head(20).iterrows():
        v = np.asarray(r.v, dtype=float)
        assert len(v) == 80 and abs(v.mean()) < 1e-9 and abs(v.std() - 1) < 1e-9
        paa = np.array([v[offs[i]:offs[i + 1]].sum() / lens[i] for i in range(16)])
        assert np.allclose(np.asarray(r.paa), paa, atol=1e-12)
        assert list(r.sax) == [int((bp <= x).sum()) for x in r.paa]


def test_stack_result_csvs_with_missing_columns(spark, tmp_path):
    from knnhard.sources.tables import read_results_csv

    a = tmp_path / "dataset=a"
    b = tmp_path / "dataset=b"
    a.mkdir()
    b.mkdir()
    (a / "t.csv").write_text("iteration,rc,elapsed_s,query_index,method\n0,1.5,0.1,3,sgd\n1,1.4,0.3,3,sgd\n")
    (b / "t.csv").write_text("iteration,rc,elapsed_s,query_index,data_limit,method\n0,1.2,0.2,7,5000,sgd\n")
    base = "iteration int, rc double, elapsed_s double, query_index long"
    df = read_results_csv(spark, [str(a), str(b)], [base + ", method string",
                                                    base + ", data_limit long, method string"])
    rows = {(r.source, r.iteration): r for r in df.collect()}
    assert rows[("a", 1)].data_limit is None and rows[("a", 1)].method == "sgd"
    assert rows[("b", 0)].data_limit == 5000 and rows[("b", 0)].rc == 1.2


# ------------------------------------------------ verdict of round 1

def test_quantiles_with_infinities_ties_and_heavy_tails(spark):
    from knnhard.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(3)
    for data in ([float(i) for i in range(200)] + [float("inf")], [float(x) for x in rng.standard_cauchy(500) ** 9], [1.0] * 300 + [2.0],
                 [float("-inf")] * 40 + [5e-324, 1e308, -1e308] * 40, [float(x) for x in rng.integers(0, 3, 400)]):
        df = spark.createDataFrame([(x,) for x in data + [float("nan"), None]], "x double")
        probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
        got = {r.p: r.q for r in exact_quantiles(df, [], "x", probs, max_exact=20).collect()}
        assert len(got) == len(probs)
        v = np.sort(np.array(data))
        for p in probs:
            h = (len(v) - 1) * p
            lo, hi = v[int(np.floor(h))], v[int(np.ceil(h))]
            assert lo <= got[p] <= hi and (lo != hi or got[p] == lo)


def test_kendall_sizes_agree(spark):
    from knnhard.operators import report as R

    rng = np.random.default_rng(4)
    rows = [("a", float(x), float(y)) for x, y in rng.integers(0, 6, (40, 2))] + [("b", float("nan"), 1.0)] * 30 + [("c", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    whole = {r.g: r.tau for r in R.kendall(df, ["g"], [("x", "y")]).collect()}
    split = {r.g: r.tau for r in R.kendall(df, ["g"], [("x", "y")], block=3).collect()}
    assert set(whole) == set(split) == {"a", "b", "c"} and whole["b"] is None and split["b"] is None
    assert abs(whole["a"] - split["a"]) < 1e-12


def test_diameter_with_empty_tasks(spark):
    from knnhard.operators import hardness as H

    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "id long, v array<float>")
    one = H.diameter(v.repartition(1), "euclidean").first()["diameter"]
    assert H.diameter(v.repartition(64), "euclidean").first()["diameter"] == one


def test_sax_seeds_hold_k_others(spark):
    from knnhard.operators import sax
    from knnhard.plans import fixtures as fx

    sf = "/root/testdata/sf0.01"
    s = sax.summarise(fx.vectors(spark, sf).select("id", "v"), 8)
    leaves = sax.build_leaves(s, 8, 10)
    q = fx.queries(spark, sf).limit(60)
    assert sax.sax_approx(s, leaves, q, 5, 8, exclude_self=True).groupBy("qid").count().where("count < 5").count() == 0


@pytest.mark.parametrize("name, want", [("a/deep-angular-96-1M.bin", ("deep", 10 ** 6, 96, "angular")), ("sift-128-500k.fbin", ("sift", 500_000, 128, "euclidean")),
                                        ("x-v2-ip-200-77.bin", ("x", 77, 200, "ip"))])
def test_descriptor(name, want):
    from knnhard.sources.vecfile import parse_name

    assert parse_name(name) == want


def test_copies_of_a_vector_go_by_id(spark):
    """More copies at one distance than the list is long: the smaller ids stay, whatever the batches."""
    rows = [(i, [1.0, 0.5, 0.25] if i % 2 else [float(i), 3.0, 1.0]) for i in range(400)][::-1]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    q = spark.createDataFrame([(1, [1.1, 0.5, 0.25]), (2, [1.0, 0.5, 0.25])], "qid long, qv array<double>")
    for parts in (1, 7, 600):
        got = D.knn(v.repartition(parts), q, 5).orderBy("qid", "rank").collect()
        assert [r.id for r in got] == [1, 3, 5, 7, 9] * 2


def test_far_off_data_is_measured_exactly(spark):
    """Vectors far from the origin lose digits in the matrix product; thresholds, lists and bins do not."""
    rng = np.random.default_rng(5)
    X = rng.normal(size=(300, 6)) + 1e6
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    q = spark.createDataFrame([(1000, (X[7] + 0.1).tolist())], "qid long, qv array<double>")
    d = np.sqrt(((X - (X[7] + 0.1)) ** 2).sum(1))
    got = D.knn(v, q, 10).orderBy("rank").collect()
    assert [r.id for r in got] == np.argsort(d, kind="stable")[:10].tolist()
    near = D.range_join(v, q.selectExpr("*", f"{float(np.sort(d)[20])!r} AS r"), "r")
    assert near.count() in (20, 21)
    gt = H.ground_truth(v, q, maxk=50, bins=20).first()
    assert np.allclose(gt["topk"], np.sort(d)[:50])
    assert list(gt["hist_counts"]) == np.histogram(d, bins=np.array(gt["hist_edges"]))[0].tolist()


def test_seeded_search_and_radius_graph(spark):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(60, 3))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>")
    q = spark.createDataFrame([(i, X[i].tolist()) for i in (3, 9)], "qid long, qv array<double>")
    seeds = D.knn(v, q, 4, exclude_self=True).where("rank = 4").selectExpr("qid", "d AS bsf")
    assert D.seeded_knn(v, q, seeds, 10, exclude_self=True).groupBy("qid").count().collect()[0]["count"] == 3
    e = D.neighbour_graph(v, q, 3, mode="radius", exclude_self=True).toPandas()
    dist = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    for qi in (3, 9):
        ds = dist[qi].copy()
        ds[qi] = np.inf
        hop1 = np.argsort(ds, kind="stable")[:3]
        r = ds[hop1[-1]]
        want = {(-1, int(i)) for i in hop1}
        for i in hop1:
            fan = [j for j in range(60) if j != i and dist[i, j] <= r]
            want |= {tuple(sorted((int(i), j))) for j in fan if j not in hop1}
            want |= {(a, b) for a in fan for b in fan if a < b}
        mine = e[e.qid == qi]
        assert set(zip(mine.src, mine.dst)) == want


def test_draws_from_ids_with_gaps(spark):
    from knnhard.operators import vectors as V

    df = spark.createDataFrame([(i * 37 + 5, [float(i)]) for i in range(40)], "id long, v array<double>")
    got = V.sample_with(df, 200, 7).collect()
    assert sorted(r.draw for r in got) == list(range(200))
    dense = V.sample_with(df.selectExpr("(id - 5) DIV 37 AS id", "v"), 200, 7).collect()
    assert {r.draw: r.id for r in got} == {r.draw: r.id * 37 + 5 for r in dense}


def test_workloads_by_type_with_truth(spark):
    from knnhard.operators import generate as G
    from knnhard.plans import fixtures as fx

    v = fx.vectors(spark, SF)
    n = v.count()
    own = v.where("id < 3").selectExpr("id AS qid", "v AS qv")
    rows = [{"workload_type": "synthetic-simulated-annealing", "difficulty": "rc", "target_class": "easy", "num_queries": 3, "max_steps": 1},
            {"workload_type": "empirical-difficulty-based", "index": "faiss_ivf", "target_low": 0.1, "target_high": 0.9, "k": 1, "num_queries": 2, "max_steps": 2},
            {"workload_type": "file-based", "queries": own}]
    for cfg, want in zip(rows, (3, 2, 3)):
        q, gt = G.dispatch_with_truth(v, cfg, maxk=20)
        assert q.select("qid").distinct().count() == q.count() == want
        assert [len(r.topk) for r in gt.collect()] == [min(20, n)] * want
    with pytest.raises(ValueError):
        G.dispatch_workload(v, {"workload_type": "empirical-difficulty-based", "index": "faiss_hnsw", "target_low": 0.1, "target_high": 0.2})


def test_vector_files_of_odd_length_raise(spark, tmp_path):
    from knnhard.sources import vecfile

    np.arange(10, dtype="<f4").tofile(tmp_path / "odd-euclidean-4-3.bin")
    with pytest.raises(Exception, match="whole number of vectors"):
        vecfile.read_vectors(spark, str(tmp_path / "odd-euclidean-4-3.bin"), dim=4).count()
    with open(tmp_path / "short.fbin", "wb") as f:
        np.array([3, 4], "<i4").tofile(f)
        np.arange(10, dtype="<f4").tofile(f)
    with pytest.raises(Exception, match="its header says"):
        vecfile.read_vectors(spark, str(tmp_path / "short.fbin")).count()


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_measures_of_many_copies(spark, ansi):
    """a vector with more than k copies has a k-th distance of zero: an infinite RC, as the SQL has it, and no error."""
    v = spark.createDataFrame([(i, [1.0, 0.0] if i < 12 else [float(i), 1.0]) for i in range(20)], "id long, v array<double>")
    q = v.select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = {r.qid: r for r in H.measures(v, q, k=5, exclude_self=True).collect()}
        wide = H.metric_table(v, q, k=5, exclude_self=True).count()
        eps = {r["eps"] for r in H.eps_calibrate(v, q, exclude_self=True).collect()}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "false")
    assert wide == 20 and eps == {float("inf")}
    assert got[0].rc == float("inf") and np.isnan(got[0].expansion)
    assert 0 < got[19].rc < float("inf")


def test_group_means_keep_groups_with_missing_means(spark):
    from knnhard.operators import report

    df = spark.createDataFrame([("a", 1.0, float("nan")), ("a", 3.0, 2.0), ("b", 4.0, None), ("c", 5.0, 6.0)], "g string, x double, y double")
    got = {r["g"]: (r["x"], r["y"]) for r in report.group_means(df, ["g"], ["x", "y"]).collect()}
    assert got["a"][0] == 2.0 and np.isnan(got["a"][1]) and got["b"] == (4.0, None) and got["c"] == (5.0, 6.0)

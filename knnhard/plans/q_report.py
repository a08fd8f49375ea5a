"""Registered queries I1-I27 and E7 (reports over result tables)."""

from pyspark.sql import functions as F

from knnhard.functions import vec
from knnhard.operators import distance as dist
from knnhard.operators import hardness as H
from knnhard.operators import report as R
from knnhard.operators import sax
from knnhard.plans import fixtures as fx
from knnhard.plans import q_sax
from knnhard.plans import results as RS
from knnhard.plans import sqlgen as S
from knnhard.plans.registry import register

MEASURES = ["lid", "rc", "expansion"] + [H.eps_name(e) for e in H.EPSILONS]
DATASETS = [f"set-{i}" for i in range(10)]
r6 = S.r6
sql = RS.sql


def _m(spark, sf):
    return RS.metric_rows(spark, sf)


def _p(spark, sf):
    return RS.perf_rows(spark, sf)


def _t(spark, sf):
    return RS.trace(spark, sf)


def _rnd(cols):
    return [vec.rnd(c).alias(c) for c in cols]


def _method_sql(w):
    return f"CASE WHEN regexp_replace({w}, '\\(.*', '') = 'File' THEN 'Baseline' ELSE regexp_replace({w}, '\\(.*', '') END"


def _relabel_sql(w):
    return "CASE " + " ".join(f"WHEN {w} = '{a}' THEN '{b}'" for a, b in R.RELABEL.items()) + f" ELSE {w} END"


def _diff_sql(w):
    return f"coalesce(nullif(regexp_extract({w}, '(easy|medium|hard\\+|hard)', 1), ''), '-')"


# --------------------------------------------------------------- I1-I5

@register("group_means", sql("SELECT dataset, workload_description, " + ", ".join(
    f"{r6(f'avg({c})')} AS {c}" for c in MEASURES + ["distcomp"]) + " FROM mrows GROUP BY dataset, workload_description"))
def q_group_means(spark, sf):
    g = R.group_means(_m(spark, sf), ["dataset", "workload_description"], MEASURES + ["distcomp"])
    return g.select("dataset", "workload_description", *_rnd(MEASURES + ["distcomp"]))


@register("max_then_mean", sql(f"""SELECT dataset, method, {r6('avg(mx)')} AS elapsed_s FROM (
  SELECT dataset, method, query_index, max(elapsed_s) AS mx FROM trace GROUP BY ALL) GROUP BY dataset, method""", False))
def q_max_then_mean(spark, sf):
    m = R.max_then_mean(_t(spark, sf), ["dataset", "method", "query_index"], ["dataset", "method"], "elapsed_s")
    return m.select("dataset", "method", vec.rnd("elapsed_s").alias("elapsed_s"))


@register("lag_times", sql(f"""SELECT dataset, method, query_index, iteration,
  {r6('elapsed_s - coalesce(lag(elapsed_s) OVER (PARTITION BY dataset, method, query_index ORDER BY iteration), 0)')} AS iteration_time_s
FROM trace""", False))
def q_lag_times(spark, sf):
    t = R.lag_diff(_t(spark, sf), ["dataset", "method", "query_index"], "iteration", "elapsed_s", "iteration_time_s")
    return t.select("dataset", "method", "query_index", "iteration", vec.rnd("iteration_time_s").alias("iteration_time_s"))


@register("pivot_means", sql("SELECT dataset, " + ", ".join(
    f"{r6(f'avg(distcomp) FILTER (WHERE m = {chr(39)}{x}{chr(39)})')} AS {x}" for x in R.METHOD_ORDER)
    + f" FROM (SELECT *, {_method_sql('workload_description')} AS m FROM mrows) GROUP BY dataset"))
def q_pivot_means(spark, sf):
    m = _m(spark, sf).withColumn("method", R.method_of(F.col("workload_description")))
    p = R.pivot_means(m, ["dataset"], "method", R.METHOD_ORDER, "distcomp")
    return p.select("dataset", *_rnd(R.METHOD_ORDER))


@register("unpivot_measures", sql("SELECT i, dataset, measure, " + r6("value") + " AS value FROM (" + " UNION ALL ".join(
    f"SELECT i, dataset, '{c}' AS measure, {c}::DOUBLE AS value FROM mrows" for c in MEASURES) + ")"))
def q_unpivot_measures(spark, sf):
    m = _m(spark, sf).select("i", "dataset", *[F.col(c).cast("double").alias(c) for c in MEASURES])
    u = R.unpivot(m, ["i", "dataset"], MEASURES)
    return u.select("i", "dataset", "measure", vec.rnd("value").alias("value"))


# --------------------------------------------------------------- I6-I11

def _kendall_sql(src, keys, x, y):
    k = ", ".join(f"a.{c}" for c in keys)
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    den = f"sqrt(sum(abs(sign(a.{x} - b.{x}))) * sum(abs(sign(a.{y} - b.{y}))))"
    return f"""SELECT {k}, CASE WHEN {den} > 0 THEN sum(sign(a.{x} - b.{x}) * sign(a.{y} - b.{y})) / {den} END AS tau
      FROM {src} a JOIN {src} b ON {on} AND a.rid < b.rid GROUP BY {k}"""


_KT_SRC = "(SELECT row_number() OVER () AS rid, * FROM mrows)"
KENDALL_SQL = " UNION ALL ".join(
    f"SELECT dataset, '{c}' AS measure, tau FROM ({_kendall_sql(_KT_SRC, ['dataset'], c, 'distcomp')})" for c in MEASURES)


@register("kendall", sql(f"SELECT dataset, measure, {r6('tau')} AS tau FROM ({KENDALL_SQL})"))
def q_kendall(spark, sf):
    k = R.kendall(_m(spark, sf), ["dataset"], [(c, "distcomp") for c in MEASURES])
    return k.select("dataset", F.col("x").alias("measure"), vec.rnd("tau").alias("tau"))


SP_COLS = ["rc", "expansion", "distcomp", "eps_0_5"]


def _avg_rank_sql(c):
    return f"(rank() OVER (PARTITION BY dataset ORDER BY {c}) + (count(*) OVER (PARTITION BY dataset, {c}) - 1) / 2.0)"


@register("spearman", sql("SELECT dataset, x, y, " + r6("rho") + " AS rho FROM (" + " UNION ALL ".join(
    f"SELECT dataset, '{a}' AS x, '{b}' AS y, corr({a}, {b}) AS rho FROM rk GROUP BY dataset"
    for i, a in enumerate(SP_COLS) for b in SP_COLS[i + 1:]) + ")").replace(
    "FROM rk", "FROM (SELECT dataset, " + ", ".join(f"{_avg_rank_sql(c)} AS {c}" for c in SP_COLS) + " FROM mrows) rk"))
def q_spearman(spark, sf):
    s = R.spearman(_m(spark, sf), ["dataset"], SP_COLS)
    return s.select("dataset", "x", "y", vec.rnd("rho").alias("rho"))


_PROBS100 = "[" + ", ".join(repr(i / 100) for i in range(101)) + "]::DOUBLE[]"


def _edges_sql(src, col, keys=("dataset",), bins=100):
    """Quantile edges per group with numpy's interpolation, from order statistics."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} = hq.{c}" for c in keys)
    on_b = on.replace("a.", "b.")
    return f"""(SELECT {k}, list(e ORDER BY pi) AS qe FROM (
      SELECT {', '.join('hq.' + c for c in keys)}, hq.pi,
        CASE WHEN hq.h - floor(hq.h) >= 0.5 THEN b.x - (b.x - a.x) * (1.0 - (hq.h - floor(hq.h)))
             ELSE a.x + (b.x - a.x) * (hq.h - floor(hq.h)) END AS e
      FROM (SELECT d.*, pr.p, pr.pi, (d.n - 1) * pr.p AS h FROM (SELECT DISTINCT {k}, n FROM rk_{col}) d,
            (SELECT unnest({_PROBS100}) AS p, generate_subscripts({_PROBS100}, 1) AS pi) pr) hq
      JOIN rk_{col} a ON {on} AND a.r = floor(hq.h) JOIN rk_{col} b ON {on_b} AND b.r = ceil(hq.h))
    GROUP BY {k})"""


def _qbins_sql(src, col, vals=("distcomp",), bins=100):
    avgs = ", ".join(f"round(avg({c}), 12) AS {c}" for c in (col,) + tuple(vals))
    fin = f"(SELECT * FROM {src} WHERE {col} IS NOT NULL AND NOT isnan({col}) AND abs({col}) < 'inf'::DOUBLE)"
    rk = (f"rk_{col} AS (SELECT dataset, {col} AS x, row_number() OVER (PARTITION BY dataset ORDER BY {col}) - 1 AS r, "
          f"count(*) OVER (PARTITION BY dataset) AS n FROM {fin})")
    return f"""WITH {rk} SELECT dataset, bin, {avgs} FROM (
      SELECT s.*, len(list_filter(e.edges[2:{bins + 1}], lambda t: t < s.{col})) AS bin FROM {fin} s JOIN (
        SELECT dataset, CASE WHEN len(list_distinct(qe)) < len(qe) THEN
            list_transform(range({bins + 1}), lambda i: CASE WHEN i = 0 THEN mn - (mx - mn) * 0.001 WHEN i = {bins} THEN mx
                                                             ELSE mn + i * ((mx - mn) / {bins}) END)
          ELSE qe END AS edges
        FROM {_edges_sql(src, col)} JOIN (SELECT dataset, min({col}) AS mn, max({col}) AS mx FROM {fin} GROUP BY dataset) USING (dataset)) e
      USING (dataset))
    GROUP BY dataset, bin"""


@register("quantile_bins", sql(f"SELECT dataset, bin::INT AS bin, {r6('rc')} AS rc, {r6('distcomp')} AS distcomp FROM ({_qbins_sql('mrows', 'rc')})"))
def q_quantile_bins(spark, sf):
    b = R.quantile_bins(_m(spark, sf), ["dataset"], "rc", ["distcomp"], digits=12)
    return b.select("dataset", F.col("bin").cast("int"), *_rnd(["rc", "distcomp"]))


@register("equal_bins", sql(f"""SELECT dataset, bin::INT AS bin, count(*)::BIGINT AS n, {r6('avg(distcomp)')} AS distcomp FROM (
  SELECT m.dataset, m.distcomp, least(39, floor((m.rc - x.mn) / (x.mx - x.mn) * 40)) AS bin FROM mrows m
  JOIN (SELECT dataset, min(rc) AS mn, max(rc) AS mx FROM mrows GROUP BY dataset) x USING (dataset)) GROUP BY dataset, bin"""))
def q_equal_bins(spark, sf):
    b = R.equal_bins(_m(spark, sf), ["dataset"], "rc", "distcomp", 40)
    return b.select("dataset", F.col("bin").cast("int"), F.col("n").cast("long"), vec.rnd("distcomp").alias("distcomp"))


@register("outlier_cut", sql("SELECT i FROM mrows WHERE rc < (SELECT quantile_cont(rc, 0.99::DOUBLE) FROM mrows)"))
def q_outlier_cut(spark, sf):
    return R.outlier_cut(_m(spark, sf), "rc", 0.99).select("i")


@register("rank_marks", sql(f"""SELECT dataset, measure, {r6('abs(tau)')} AS abs_value, tau > 0 AS positive,
  CASE dense_rank() OVER (PARTITION BY dataset ORDER BY round(abs(tau), 9) DESC NULLS LAST) WHEN 1 THEN 'best' WHEN 2 THEN 'second' ELSE '' END AS mark
FROM ({KENDALL_SQL})"""))
def q_rank_marks(spark, sf):
    k = R.kendall(_m(spark, sf), ["dataset"], [(c, "distcomp") for c in MEASURES])
    r = R.rank_marks(k.select("dataset", F.col("x").alias("measure"), "tau"), "dataset", "tau", digits=9)
    return r.select("dataset", "measure", vec.rnd("abs_value").alias("abs_value"), "positive", "mark")


# -------------------------------------------------------------- I12-I21

_IDX_SQL = "regexp_replace(regexp_replace(regexp_replace(index_name, 'faiss_ivf', 'FaissIVF'), 'faiss_hnsw', 'FaissHNSW'), 'fashion_mnist', 'fashion-mnist')"


@register("label_clean", sql(f"""SELECT query_index, k, regexp_replace(regexp_replace(dataset, '.*/', ''), '-.*', '') AS dataset,
  {_IDX_SQL} AS "index", {_method_sql('workload')} AS method FROM perf"""))
def q_label_clean(spark, sf):
    p = _p(spark, sf)
    return p.select("query_index", "k", R.clean_dataset(F.col("dataset")).alias("dataset"),
                    R.rename_index(F.col("index_name")).alias("index"), R.method_of(F.col("workload")).alias("method"))


@register("relabel", sql(f"SELECT i, {_relabel_sql('workload_description')} AS workload FROM mrows"))
def q_relabel(spark, sf):
    return _m(spark, sf).select("i", R.relabel(F.col("workload_description")).alias("workload"))


@register("difficulty", sql(f"""SELECT i, {_diff_sql('workload_description')} AS raw_difficulty,
  {_diff_sql(_relabel_sql('workload_description'))} AS difficulty FROM mrows"""))
def q_difficulty(spark, sf):
    w = F.col("workload_description")
    return _m(spark, sf).select("i", R.difficulty(w).alias("raw_difficulty"), R.difficulty(R.relabel(w)).alias("difficulty"))


def _pos_sql(expr, cats):
    return "CASE " + " ".join(f"WHEN {expr} = '{c}' THEN {i + 1}" for i, c in enumerate(cats)) + " ELSE 0 END"


@register("ordered_categories", sql(f"""SELECT i, {_pos_sql(_method_sql('workload_description'), R.METHOD_ORDER)}::INT AS method_order,
  {_pos_sql(_diff_sql(_relabel_sql('workload_description')), R.DIFFICULTY_ORDER)}::INT AS difficulty_order FROM mrows"""))
def q_ordered_categories(spark, sf):
    w = F.col("workload_description")
    return _m(spark, sf).select("i", R.order_of(R.method_of(w), R.METHOD_ORDER).cast("int").alias("method_order"),
                                R.order_of(R.difficulty(R.relabel(w)), R.DIFFICULTY_ORDER).cast("int").alias("difficulty_order"))


@register("family", sql(f"""SELECT i, CASE WHEN starts_with(w, 'Gaussian') THEN 'GaussianNoise'
  WHEN starts_with(w, 'Annealing(faiss_ivf') THEN 'Annealing(faiss_ivf)' WHEN starts_with(w, 'Annealing(rc') THEN 'Annealing(rc)'
  ELSE w END AS family FROM (SELECT i, {_relabel_sql('workload_description')} AS w FROM mrows)"""))
def q_family(spark, sf):
    return _m(spark, sf).select("i", R.family(R.relabel(F.col("workload_description"))).alias("family"))


@register("coalesce_rc", sql(f"""SELECT i, CASE WHEN rc_10 IS NULL THEN 1 ELSE 10 END AS k, {r6('coalesce(rc_10, rc_1)')} AS rc FROM (
  SELECT i, CASE WHEN i % 2 = 0 THEN rc END AS rc_10, CASE WHEN i % 2 = 1 THEN rc END AS rc_1 FROM mrows)"""))
def q_coalesce_rc(spark, sf):
    m = _m(spark, sf).select("i", F.when(F.col("i") % 2 == 0, F.col("rc")).alias("rc_10"),
                             F.when(F.col("i") % 2 == 1, F.col("rc")).alias("rc_1"))
    k, rc = R.coalesce_k(F.col("rc_10"), F.col("rc_1"))
    return m.select("i", k.alias("k"), vec.rnd(rc).alias("rc"))


@register("cap_one", sql(f"SELECT query_index, k, {r6('least(distcomp, 1.0)')} AS distcomp FROM perf"))
def q_cap_one(spark, sf):
    return _p(spark, sf).select("query_index", "k", vec.rnd(R.cap_one(F.col("distcomp"))).alias("distcomp"))


@register("distinct_counts", sql("SELECT count(DISTINCT dataset)::BIGINT AS n_datasets, count(DISTINCT index_name)::BIGINT AS n_indexes FROM perf"))
def q_distinct_counts(spark, sf):
    return _p(spark, sf).agg(F.count_distinct("dataset").alias("n_datasets"), F.count_distinct("index_name").alias("n_indexes"))


RC_HARD, DC_HARD, RC_EASY, DC_EASY = 1.15, 0.999, 1.17, 0.5


@register("extreme_queries", sql(f"""SELECT query_index, {r6('distcomp')} AS distcomp, {r6('rc')} AS rc, label FROM (
  (SELECT p.query_index, p.distcomp, m.rc, 'hard' AS label FROM perf p JOIN mrows m ON m.i = p.query_index AND m.dataset = p.dataset
     AND m.workload_description = p.workload AND m.k = p.k
   WHERE p.distcomp <= {DC_HARD} AND m.rc < {RC_HARD} ORDER BY p.distcomp DESC, p.query_index DESC LIMIT 2)
  UNION ALL
  (SELECT p.query_index, p.distcomp, m.rc, 'easy' AS label FROM perf p JOIN mrows m ON m.i = p.query_index AND m.dataset = p.dataset
     AND m.workload_description = p.workload AND m.k = p.k
   WHERE p.distcomp < {DC_EASY} AND m.rc > {RC_EASY} ORDER BY p.distcomp DESC, p.query_index DESC LIMIT 2))"""))
def q_extreme_queries(spark, sf):
    m = _m(spark, sf)  # first: the performance rows read its nearest lists
    p = _p(spark, sf)
    m = m.select(F.col("i").alias("query_index"), "dataset", F.col("workload_description").alias("workload"), "k", "rc")
    j = p.join(m, ["dataset", "workload", "query_index", "k"])  # C9: equi-join of performance and metrics
    hard = R.last_two(j.where((F.col("distcomp") <= DC_HARD) & (F.col("rc") < RC_HARD)), "distcomp", "hard")
    easy = R.last_two(j.where((F.col("distcomp") < DC_EASY) & (F.col("rc") > RC_EASY)), "distcomp", "easy")
    return hard.unionByName(easy).select("query_index", vec.rnd("distcomp").alias("distcomp"), vec.rnd("rc").alias("rc"), "label")


@register("in_target_share", sql(f"""SELECT dataset, {r6('avg(CASE WHEN distcomp BETWEEN 0.1 AND 0.2 THEN 1.0 ELSE 0.0 END)')} AS in_target,
  count(*)::BIGINT AS n FROM perf WHERE k = 1 GROUP BY dataset"""))
def q_in_target_share(spark, sf):
    s = R.in_target_share(_p(spark, sf).where("k = 1"), ["dataset"], "distcomp", 0.1, 0.2)
    return s.select("dataset", vec.rnd("in_target").alias("in_target"), F.col("n").cast("long"))


# -------------------------------------------------------------- I22-I27

def _corr_sql():
    parts = []
    for c in MEASURES:
        src = "mrows"
        if c in ("rc", "expansion"):
            src = f"(SELECT * FROM mrows WHERE {c} < (SELECT quantile_cont({c}, 0.99::DOUBLE) FROM mrows))"
        binned = f"(SELECT row_number() OVER () AS rid, * FROM ({_qbins_sql(src, c)}))"
        parts.append(f"SELECT dataset, '{c}' AS measure, abs(tau) AS correlation FROM ({_kendall_sql(binned, ['dataset'], c, 'distcomp')})")
    return " UNION ALL ".join(parts)


@register("correlation_table", sql("SELECT measure, " + ", ".join(
    f"{r6(f'max(correlation) FILTER (WHERE dataset = {chr(39)}{d}{chr(39)})')} AS \"{d}\"" for d in DATASETS)
    + f" FROM ({_corr_sql()}) GROUP BY measure"))
def q_correlation_table(spark, sf):
    """One pipeline over the unpivoted measures (I22): outlier cut for rc
    and expansion (one quantile pass keyed by measure), quantile bins per
    (measure, dataset), Kendall tau per (measure, dataset), pivot."""
    from knnhard.operators.quantiles import exact_quantiles

    m = _m(spark, sf).select("i", "dataset", "distcomp", *[F.col(c).cast("double").alias(c) for c in MEASURES])
    long = R.unpivot(m, ["i", "dataset", "distcomp"], MEASURES, "measure", "value")
    cut = exact_quantiles(long.where(F.col("measure").isin("rc", "expansion")), ["measure"], "value", [0.99])
    long = (long.join(F.broadcast(cut.select("measure", F.col("q").alias("cut"))), "measure", "left")  # two rows
            .where(F.col("cut").isNull() | (F.col("value") < F.col("cut"))))
    b = R.quantile_bins(long, ["measure", "dataset"], "value", ["distcomp"], digits=12)
    k = R.kendall(b, ["measure", "dataset"], [("value", "distcomp")])
    out = k.select("measure", "dataset", F.abs("tau").alias("correlation")).where(F.col("correlation").isNotNull())
    names = sorted(r["dataset"] for r in m.select("dataset").distinct().collect())  # one row per dataset
    p = out.groupBy("measure").pivot("dataset", names).agg(F.first("correlation"))  # C10: datasets side by side
    return p.select("measure", *[vec.rnd(F.col(f"`{d}`")).alias(d) for d in names])


@register("hardness_table", sql("SELECT \"index\", dataset, k, difficulty, " + ", ".join(
    f"{r6(f'avg(distcomp) FILTER (WHERE method = {chr(39)}{x}{chr(39)})')} AS {x}" for x in R.METHOD_ORDER) + f""" FROM (
  SELECT {_IDX_SQL} AS "index", regexp_replace(regexp_replace(dataset, '.*/', ''), '-.*', '') AS dataset, k, distcomp,
    {_method_sql(_relabel_sql('workload'))} AS method, replace({_diff_sql(_relabel_sql('workload'))}, '+', '') AS difficulty,
    {_diff_sql(_relabel_sql('workload'))} AS d0 FROM perf) WHERE d0 <> 'hard+' GROUP BY ALL"""))
def q_hardness_table(spark, sf):
    p = _p(spark, sf)
    w = R.relabel(F.col("workload"))
    p = p.select(R.rename_index(F.col("index_name")).alias("index"), R.clean_dataset(F.col("dataset")).alias("dataset"), "k",
                 "distcomp", R.method_of(w).alias("method"), R.difficulty(w).alias("d0"))
    p = p.where(F.col("d0") != "hard+").withColumn("difficulty", F.regexp_replace("d0", r"\+", ""))
    t = R.pivot_means(p, ["index", "dataset", "k", "difficulty"], "method", R.METHOD_ORDER, "distcomp")
    return t.select("index", "dataset", "k", "difficulty", *_rnd(R.METHOD_ORDER))


_METHODS = ["sgd", "annealing"]


@register("time_table", sql("SELECT dataset, " + ", ".join(
    f"{r6(f'max(it) FILTER (WHERE method = {chr(39)}{x}{chr(39)})')} AS {x}_iteration_time_s, "
    f"{r6(f'max(el) FILTER (WHERE method = {chr(39)}{x}{chr(39)})')} AS {x}_elapsed_s" for x in _METHODS) + """ FROM (
  SELECT a.dataset, a.method, a.it, b.el FROM
    (SELECT dataset, method, avg(d) AS it FROM (SELECT dataset, method,
        elapsed_s - coalesce(lag(elapsed_s) OVER (PARTITION BY dataset, method, query_index ORDER BY iteration), 0) AS d FROM trace)
     GROUP BY ALL) a
  JOIN (SELECT dataset, method, avg(mx) AS el FROM (SELECT dataset, method, query_index, max(elapsed_s) AS mx FROM trace GROUP BY ALL)
        GROUP BY ALL) b USING (dataset, method)) GROUP BY dataset""", False))
def q_time_table(spark, sf):
    t = _t(spark, sf)
    it = R.lag_diff(t, ["dataset", "method", "query_index"], "iteration", "elapsed_s", "d").groupBy("dataset", "method").agg(
        F.avg("d").alias("it"))
    el = R.max_then_mean(t, ["dataset", "method", "query_index"], ["dataset", "method"], "elapsed_s").withColumnRenamed("elapsed_s", "el")
    j = it.join(el, ["dataset", "method"])
    p = j.groupBy("dataset").pivot("method", _METHODS).agg(F.first("it").alias("it"), F.first("el").alias("el"))
    cols = []
    for x in _METHODS:
        cols += [vec.rnd(F.col(f"{x}_it")).alias(f"{x}_iteration_time_s"), vec.rnd(F.col(f"{x}_el")).alias(f"{x}_elapsed_s")]
    return p.select("dataset", *cols)


@register("actual_hardness", sql(f"""SELECT dataset, method, difficulty, {r6('avg(rc)')} AS rc, {r6('avg(distcomp)')} AS distcomp,
  count(*)::BIGINT AS n FROM (SELECT dataset, rc, distcomp,
    regexp_replace(workload_description, '\\(.*', '') AS method, {_diff_sql('workload_description')} AS difficulty
    FROM mrows WHERE rc < 100) WHERE method <> 'File' GROUP BY ALL"""))
def q_actual_hardness(spark, sf):
    m = _m(spark, sf).where(F.col("rc") < 100)
    w = F.col("workload_description")
    m = m.select("dataset", "rc", "distcomp", F.regexp_replace(w, r"\(.*", "").alias("method"), R.difficulty(w).alias("difficulty"))
    g = m.where(F.col("method") != "File").groupBy("dataset", "method", "difficulty").agg(
        F.avg("rc").alias("rc"), F.avg("distcomp").alias("distcomp"), F.count(F.lit(1)).alias("n"))
    return g.select("dataset", "method", "difficulty", *_rnd(["rc", "distcomp"]), F.col("n").cast("long"))


_FLOATS = ["lid", "rc", "expansion", "distcomp"] + [H.eps_name(e) for e in H.EPSILONS]


@register("float_columns", sql("SELECT " + ", ".join(f"{r6(c)} AS {c}" for c in _FLOATS) + " FROM mrows"))
def q_float_columns(spark, sf):
    m = _m(spark, sf)
    cols = R.float_columns(m)
    return m.select(*_rnd(cols))


@register("drop_null_means", sql(f"""SELECT dataset, difficulty, {r6('avg(distcomp)')} AS distcomp FROM (
  SELECT dataset, distcomp, {_diff_sql('workload_description')} AS difficulty FROM mrows)
WHERE difficulty <> 'hard+' GROUP BY dataset, difficulty"""))
def q_drop_null_means(spark, sf):
    m = _m(spark, sf).withColumn("difficulty", R.difficulty(F.col("workload_description"))).where("difficulty <> 'hard+'")
    p = R.pivot_means(m, ["dataset"], "difficulty", R.DIFFICULTY_ORDER, "distcomp")  # 'hard+' column is all NULL
    u = R.unpivot(p, ["dataset"], R.DIFFICULTY_ORDER, "difficulty", "distcomp").na.drop(subset=["distcomp"])
    return u.select("dataset", "difficulty", vec.rnd("distcomp").alias("distcomp"))


def _index_sql():
    rows = " UNION ALL ".join(
        f"""SELECT 'set-' || em.label::VARCHAR, {RS._wl_sql('c.qid')}, c.qid, 'sax', '{{"segments":8,"leaf_size":10}}', NULL::DOUBLE,
  c.hardness, 1.0, {k}, NULL::DOUBLE FROM sax{k} c JOIN embeddings em ON em.vec_id = c.qid""" for k in (10, 1))
    cols = ", ".join(f"{r6(c)} AS {c}" if c in ("distcomp", "recall") else c for c in R.PERF_COLS)
    ctes = {**RS.result_ctes(), **q_sax.index_ctes(64, (10, 1))}
    return fx.with_fixtures(["vectors", "queries"], f"SELECT {cols} FROM perf UNION ALL {rows}", ctes).replace("WITH ", "WITH RECURSIVE ", 1)


@register("index_performance", _index_sql())
def q_index_performance(spark, sf):
    """IVF rows plus SAX (pruned exact search) rows in the fixed schema."""
    ivf_rows = _p(spark, sf)
    v = fx.vectors(spark, sf)
    s = sax.summarise(v.select("id", "v"), 8)
    lv = sax.build_leaves(s, 8, 10)
    q = fx.queries(spark, sf)
    lab = fx.labelled(spark, sf).select(F.col("id").alias("qid"), "label")
    out = ivf_rows
    for k in (10, 1):
        ans, c = sax.sax_search(s, lv, q, k, 8, exclude_self=True)
        recall = dist.recall_at_k(dist.knn(v, q, k, exclude_self=True), ans, k)  # measured, not assumed
        c = c.join(lab, "qid").join(recall, "qid").withColumn("distcomp", F.col("hardness"))
        out = out.unionByName(R.perf_rows(
            c, F.concat(F.lit("set-"), F.col("label").cast("string")), RS._workload_col("qid"), "sax",
            F.to_json(F.struct(F.lit(8).alias("segments"), F.lit(10).alias("leaf_size"))), k, None))
    return out.select(*[vec.rnd(c_).alias(c_) if c_ in ("distcomp", "recall") else F.col(c_) for c_ in R.PERF_COLS])

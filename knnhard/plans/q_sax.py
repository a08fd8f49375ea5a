"""Registered queries F1-F16 and D14 (SAX summaries, buckets, pruned search).

Series fixture: ``series_walk`` (one z-normalised random-walk series per
user over the whole events table), w = 8 segments (6 for the uneven PAA
check), leaf size 10, every series queried against all others.
"""

from pyspark.sql import functions as F

from knnhard.functions import vec
from knnhard.operators import sax
from knnhard.plans import fixtures as fx
from knnhard.plans import sqlgen as S
from knnhard.plans.registry import register

W = 8
W_UNEVEN = 6
LEN = fx.SERIES_WALK_LEN
LEAF = 10
K = 5
BUDGET = 20
BP = sax.fixed_breakpoints()


def _series(spark, sf):
    return fx.series_walk(spark, sf)


def _summary(spark, sf, w=W):
    return sax.summarise(_series(spark, sf), w)


def _summary_kept(spark, sf, w=W):
    """Summary read by a loop and several search branches: materialised once
    in the shared checkpoint folder."""
    return _summary(spark, sf, w).checkpoint(eager=True)


def _queries(s):
    return s.select(F.col("id").alias("qid"), F.col("v").alias("qv"))


# ----------------------------------------------------------------- SQL

def _bp_sql():
    return "[" + ", ".join(repr(float(b)) for b in BP) + "]::DOUBLE[]"


def _paa_sql(col="v", w=W, length=LEN):
    parts, off = [], 0
    for ln in sax.segment_lengths(length, w):
        parts.append(f"list_sum({col}[{off + 1}:{off + ln}]) / {ln}")
        off += ln
    return "[" + ", ".join(parts) + "]"


def _sax_sql(paa="paa"):
    return f"list_transform({paa}, lambda x: len(list_filter({_bp_sql()}, lambda b: b <= x)))"


def _ctes(w=W, extra=None, series="SELECT id, v FROM series_walk", length=LEN):
    c = {"series": series,
         "pa": f"SELECT id, v, {_paa_sql('v', w, length)} AS paa FROM series",
         "summ": f"SELECT id, v, paa, {_sax_sql('paa')} AS sax FROM pa",
         "ex": "SELECT id, unnest(paa) AS x, generate_subscripts(paa, 1) - 1 AS seg FROM summ",
         "exs": "SELECT id, unnest(sax) AS s, generate_subscripts(sax, 1) - 1 AS seg FROM summ"}
    c.update(extra or {})
    return c


def _sql(body, w=W, extra=None):
    return fx.with_fixtures(["series_walk"], body, _ctes(w, extra))


def _bucket_sql(bits: str, sax_col="sax", w=W):
    """'b:p,...' from a DuckDB list of bits."""
    items = [f"({bits})[{i + 1}]::VARCHAR || ':' || (({sax_col})[{i + 1}] >> (8 - ({bits})[{i + 1}]))::VARCHAR" for i in range(w)]
    return " || ',' || ".join(items)


def _lb_sql(qpaa: str, sx: str, w=W, length=LEN):
    lens = sax.segment_lengths(length, w)
    terms = []
    for i in range(w):
        s_ = f"({sx})[{i + 1}]"
        x = f"({qpaa})[{i + 1}]"
        lo = f"CASE WHEN {s_} = 0 THEN '-inf'::DOUBLE ELSE bp[{s_}] END"
        hi = f"CASE WHEN {s_} = 255 THEN 'inf'::DOUBLE ELSE bp[{s_} + 1] END"
        g = f"greatest(({lo}) - {x}, {x} - ({hi}), 0.0)"
        terms.append(f"{float(lens[i])} * {g} * {g}")
    return "(" + " + ".join(terms) + ")"


# --------------------------------------------------------------- F1-F7

@register("paa", _sql("SELECT id, seg::BIGINT AS seg, " + S.r6("x") + " AS x FROM ex", W_UNEVEN))
def q_paa(spark, sf):
    s = sax.paa(_series(spark, sf), W_UNEVEN)
    return sax.exploded_paa(s).select("id", F.col("seg").cast("long"), vec.rnd("x").alias("x"))


@register("bp_fixed", _sql(f"""
, lv AS (SELECT b.range::INT AS bits, s.sym >> (8 - b.range) AS cell FROM exs s (id, sym, seg), range(1, 9) b)
SELECT bits, cell::BIGINT AS cell, count(*)::BIGINT AS n_values,
  {S.r6("CASE WHEN (cell << (8 - bits)) = 0 THEN NULL ELSE bp[cell << (8 - bits)] END")} AS lo,
  {S.r6("CASE WHEN ((cell + 1) << (8 - bits)) >= 256 THEN NULL ELSE bp[(cell + 1) << (8 - bits)] END")} AS hi
FROM lv, (SELECT {_bp_sql()} AS bp) GROUP BY bits, cell, bp""".replace("\n, lv AS", ",\nlv AS")))
def q_bp_fixed(spark, sf):
    """Fixed breakpoints at every resolution, applied to the data: per level
    and cell the cell bounds and the number of segment values in it (F2)."""
    s = _summary(spark, sf)
    e = s.select(F.explode("sax").alias("sym"))
    lv = e.select(F.explode(F.sequence(F.lit(1), F.lit(8))).alias("bits"), "sym")
    lv = lv.select("bits", sax._shr(F.col("sym"), F.lit(8) - F.col("bits")).alias("cell"))
    g = lv.groupBy("bits", "cell").agg(F.count(F.lit(1)).alias("n_values"))
    B = F.array(*[F.lit(float(b)) for b in BP])
    lo_pos = sax._shl(F.col("cell"), F.lit(8) - F.col("bits"))
    hi_pos = sax._shl(F.col("cell") + 1, F.lit(8) - F.col("bits"))
    return g.select(F.col("bits").cast("int"), F.col("cell").cast("long"), F.col("n_values").cast("long"),
                    vec.rnd(F.when(lo_pos > 0, F.element_at(B, F.greatest(lo_pos, F.lit(1))))).alias("lo"),
                    vec.rnd(F.when(hi_pos < 256, F.element_at(B, F.least(hi_pos, F.lit(255))))).alias("hi"))


_PROBS = "[" + ", ".join(repr(j / 256) for j in range(1, 256)) + "]::DOUBLE[]"


@register("bp_adhoc", _sql(f"""SELECT seg::BIGINT AS seg, j::INT AS j, {S.r6('bp')} AS bp FROM (
  SELECT seg, unnest(q) AS bp, generate_subscripts(q, 1) AS j FROM (
    SELECT seg, quantile_cont(x, {_PROBS}) AS q FROM ex GROUP BY seg))"""))
def q_bp_adhoc(spark, sf):
    b = sax.breakpoints_adhoc(_summary(spark, sf), W)
    return b.select(F.col("seg").cast("long"), F.col("j").cast("int"), vec.rnd("bp").alias("bp"))


@register("bp_shared", _sql(f"""SELECT j::INT AS j, {S.r6('bp')} AS bp FROM (
  SELECT unnest(q) AS bp, generate_subscripts(q, 1) AS j FROM (SELECT quantile_cont(x, {_PROBS}) AS q FROM ex))"""))
def q_bp_shared(spark, sf):
    b = sax.breakpoints_shared(_summary(spark, sf))
    return b.select(F.col("j").cast("int"), vec.rnd("bp").alias("bp"))


@register("bp_profile", _sql(f"SELECT seg::BIGINT AS seg, {S.r6('avg(x)')} AS mean, {S.r6('var_pop(x)')} AS var FROM ex GROUP BY seg"))
def q_bp_profile(spark, sf):
    p = sax.breakpoint_profile(_summary(spark, sf))
    return p.select(F.col("seg").cast("long"), vec.rnd("mean").alias("mean"), vec.rnd("var").alias("var"))


@register("sax_encode", _sql("SELECT id, seg::BIGINT AS seg, s::BIGINT AS sym FROM exs"))
def q_sax_encode(spark, sf):
    s = _summary(spark, sf)
    return s.select("id", F.posexplode("sax").alias("seg", "sym")).select(
        "id", F.col("seg").cast("long"), F.col("sym").cast("long"))


@register("sax_root", _sql("SELECT id, list_reduce(list_prepend(0, list_transform(sax, lambda s: s >> 7)), lambda a, b: a * 2 + b)::BIGINT AS root FROM summ"))
def q_sax_root(spark, sf):
    s = _summary(spark, sf)
    return s.select("id", sax.root_key().cast("long").alias("root"))


# ----------------------------------------------------- F8-F11, D14

def _split_once_sql(policy):
    ones = ", ".join(f"sum((sax[{i + 1}] >> 6) & 1) AS o{i}" for i in range(W))
    sx = ", ".join(f"sum(paa[{i + 1}]) AS s{i}, sum(paa[{i + 1}] * paa[{i + 1}]) AS q{i}" for i in range(W))
    node = "list_transform(sax, lambda s: s >> 7)"
    if policy == "next_bit":
        cand = " UNION ALL ".join(f"SELECT node, size, {i} AS seg, abs(2 * o{i} - size) AS score FROM nst" for i in range(W))
        stats = f"SELECT {node} AS node, count(*) AS size, {ones} FROM summ GROUP BY 1"
    else:
        cand = " UNION ALL ".join(
            f"""SELECT node, size, {i} AS seg, CASE WHEN sd{i} > 0 THEN abs(bp[(2 * node[{i + 1}] + 1) * 64] - m{i}) / sd{i}
                ELSE 'inf'::DOUBLE END AS score FROM (SELECT *, s{i} / size AS m{i},
                sqrt(greatest(0.0, q{i} / size - (s{i} / size) * (s{i} / size))) AS sd{i} FROM nst), (SELECT {_bp_sql()} AS bp)"""
            for i in range(W))
        stats = f"SELECT {node} AS node, count(*) AS size, {sx} FROM summ GROUP BY 1"
    bits = f"list_transform(range({W}), lambda i: CASE WHEN d.seg IS NOT NULL AND i = d.seg THEN 2 ELSE 1 END)"
    return {
        "nst": stats,
        "dec": f"SELECT node, seg FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score, seg) AS rn FROM ({cand}) WHERE size > {LEAF}) WHERE rn = 1",
        "lv": f"SELECT s.id, {bits} AS bits, s.sax, s.paa, s.v FROM summ s LEFT JOIN dec d ON d.node = {node.replace('sax', 's.sax')}",
        "leaves": f"SELECT id, v, sax, paa, {_bucket_sql('bits')} AS bucket FROM lv",
    }


def _tree_sql(policy="next_bit"):
    """The full bucket tree: a row of an over-full bucket takes one more bit, until every bucket rests. All
    rows of a bucket meet the same choice, so each level holds whole buckets."""
    node = "list_transform(range(%d), lambda i: sax[i + 1] >> (8 - bits[i + 1]))" % W
    if policy == "next_bit":
        def score(i):
            return f"abs(2 * sum((sax[{i + 1}] >> greatest(7 - bits[{i + 1}], 0)) & 1) OVER b - count(*) OVER b)"
    else:
        def score(i):
            m, n = f"(sum(paa[{i + 1}]) OVER b / count(*) OVER b)", "count(*) OVER b"
            sd = f"sqrt(greatest(0.0, sum(paa[{i + 1}] * paa[{i + 1}]) OVER b / {n} - {m} * {m}))"
            at = f"({_bp_sql()})[(2 * (sax[{i + 1}] >> (8 - bits[{i + 1}])) + 1) << greatest(7 - bits[{i + 1}], 0)]"
            return f"CASE WHEN {sd} > 0 THEN abs({at} - {m}) / {sd} ELSE 'inf'::DOUBLE END"
    cands = ", ".join(f"CASE WHEN bits[{i + 1}] < 8 THEN [({score(i)})::DOUBLE, bits[{i + 1}]::DOUBLE, {i}::DOUBLE] END" for i in range(W))
    return {
        "tree(level, id, v, paa, sax, bits)": f"""
  SELECT 0, id, v, paa, sax, list_transform(range({W}), lambda i: 1) FROM summ
  UNION ALL
  SELECT level + 1, id, v, paa, sax, list_transform(range({W}), lambda i: bits[i + 1] + CASE WHEN i = pick THEN 1 ELSE 0 END)
  FROM (SELECT *, list_min([{cands}])[3]::INT AS pick, count(*) OVER b AS size FROM (SELECT *, {node} AS node FROM tree)
        WINDOW b AS (PARTITION BY bits, node))
  WHERE size > {LEAF} AND pick IS NOT NULL""",
        "full_leaves": f"""SELECT id, v, sax, paa, bits, {_bucket_sql('bits')} AS bucket
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level DESC) AS rn FROM tree) WHERE rn = 1""",
    }


def _tree(body, policy="next_bit", extra=None):
    sql = _sql(body, extra={**_tree_sql(policy), **(extra or {})})
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _once(spark, sf, policy="next_bit"):
    s = _summary(spark, sf)
    return s, sax.build_leaves(s, W, LEAF, policy, max_levels=1)


def _full(spark, sf):
    s = _summary_kept(spark, sf)
    return s, sax.build_leaves(s, W, LEAF)


@register("bucket_split_once", _sql("SELECT bucket, count(*)::BIGINT AS size FROM leaves GROUP BY bucket", extra=_split_once_sql("next_bit")))
def q_bucket_split_once(spark, sf):
    _, lv = _once(spark, sf)
    return lv.groupBy("bucket").agg(F.count(F.lit(1)).cast("long").alias("size"))


@register("bucket_split_dist", _sql("SELECT bucket, count(*)::BIGINT AS size FROM leaves GROUP BY bucket", extra=_split_once_sql("distribution")))
def q_bucket_split_dist(spark, sf):
    _, lv = _once(spark, sf, "distribution")
    return lv.groupBy("bucket").agg(F.count(F.lit(1)).cast("long").alias("size"))


@register("bucket_envelope", _tree(f"""SELECT l.bucket, e.seg::BIGINT AS seg, {S.r6('min(e.x)')} AS lo, {S.r6('max(e.x)')} AS hi
FROM full_leaves l JOIN ex e USING (id) GROUP BY l.bucket, e.seg"""))
def q_bucket_envelope(spark, sf):
    s, lv = _full(spark, sf)
    e = sax.bucket_envelope(s, lv)
    return e.select("bucket", F.col("seg").cast("long"), vec.rnd("lo").alias("lo"), vec.rnd("hi").alias("hi"))


@register("bucket_prefix", _tree("""SELECT bucket, seg::BIGINT AS seg,
  (8 - CASE WHEN xor(a, o) = 0 THEN 0 ELSE floor(log2(xor(a, o)))::INT + 1 END)::INT AS common_bits
FROM (SELECT l.bucket, e.seg, bit_and(e.s) AS a, bit_or(e.s) AS o FROM full_leaves l JOIN exs e USING (id) GROUP BY l.bucket, e.seg)"""))
def q_bucket_prefix(spark, sf):
    s, lv = _full(spark, sf)
    return sax.bucket_prefix(s, lv).select("bucket", F.col("seg").cast("long"), "common_bits")


@register("bucket_compactness", _tree(f"""SELECT b.bucket, b.size, {S.r6('CASE WHEN b.size = 1 THEN 0.0 ELSE c.m END')} AS compactness
FROM (SELECT bucket, count(*)::BIGINT AS size FROM full_leaves GROUP BY bucket) b LEFT JOIN (
  SELECT x.bucket, avg({S.dist('euclidean', 'x.v', 'y.v')}) AS m FROM full_leaves x JOIN full_leaves y ON x.bucket = y.bucket AND x.id < y.id
  GROUP BY x.bucket) c USING (bucket)"""))
def q_bucket_compactness(spark, sf):
    s, lv = _full(spark, sf)
    c = sax.bucket_compactness(s, lv)
    return c.select("bucket", F.col("size").cast("long"), vec.rnd("compactness").alias("compactness"))


_SIZES_SQL = "SELECT bucket, count(*)::BIGINT AS size FROM full_leaves GROUP BY bucket"


@register("bucket_tree", _tree(_SIZES_SQL))
def q_bucket_tree(spark, sf):
    """Every bucket of the full tree (F8)."""
    lv = sax.build_leaves(_summary_kept(spark, sf), W, LEAF)
    return lv.groupBy("bucket").agg(F.count(F.lit(1)).cast("long").alias("size"))


@register("bucket_tree_dist", _tree(_SIZES_SQL, "distribution"))
def q_bucket_tree_dist(spark, sf):
    """Every bucket of the full tree split by distribution."""
    lv = sax.build_leaves(_summary_kept(spark, sf), W, LEAF, "distribution")
    return lv.groupBy("bucket").agg(F.count(F.lit(1)).cast("long").alias("size"))


@register("bucket_stats", _tree("""SELECT count(*)::BIGINT AS n_leaves, sum(size)::BIGINT AS n_series, max(size)::BIGINT AS max_leaf,
  min(size)::BIGINT AS min_leaf, max(deep)::INT AS max_total_bits, count(DISTINCT root)::BIGINT AS n_roots
FROM (SELECT bucket, count(*) AS size, any_value(list_sum(bits)) AS deep, any_value(list_transform(sax, lambda x: x >> 7)) AS root
      FROM full_leaves GROUP BY bucket)"""))
def q_bucket_stats(spark, sf):
    s = _summary_kept(spark, sf)
    lv = sax.build_leaves(s, W, LEAF)
    return sax.bucket_stats(lv)


# ------------------------------------------------------------ F12-F16

_PAIRS_LB = {"qs": f"SELECT id AS qid, {_paa_sql('v')} AS qpaa, v AS qv FROM series",
             "lbs": f"SELECT q.qid, s.id, sqrt({_lb_sql('q.qpaa', 's.sax')}) AS lb FROM qs q JOIN summ s ON q.qid <> s.id, (SELECT {_bp_sql()} AS bp)"}


@register("lower_bound", _sql(f"SELECT qid, id, {S.r6('lb')} AS lb FROM lbs", extra=_PAIRS_LB))
def q_lower_bound(spark, sf):
    s = _summary_kept(spark, sf)
    lb = sax.series_lower_bounds(s, _queries(s), W, sax.segment_lengths(LEN, W), exclude_self=True)
    return lb.select("qid", "id", vec.rnd("lb").alias("lb"))


_KNN_SERIES = {"pairs": f"SELECT q.id AS qid, x.id, {S.dist('euclidean', 'q.v', 'x.v')} AS d FROM series q JOIN series x ON q.id <> x.id"}


@register("sax_knn", _sql(f"""SELECT qid, rank::BIGINT AS rank, id, {S.r6('d')} AS d FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM pairs) WHERE rank <= {K}""", extra=_KNN_SERIES))
def q_sax_knn(spark, sf):
    s = _summary_kept(spark, sf)
    lv = sax.build_leaves(s, W, LEAF)
    ans, _ = sax.sax_search(s, lv, _queries(s), K, W, exclude_self=True)
    return ans.select("qid", F.col("rank").cast("long"), "id", vec.rnd("d").alias("d"))


def _env_lb_sql(lo: str, hi: str, length=LEN):
    gap = [f"greatest(({lo})[{i + 1}] - q.qpaa[{i + 1}], q.qpaa[{i + 1}] - ({hi})[{i + 1}], 0.0)" for i in range(W)]
    return "sqrt(" + " + ".join(f"{float(n)} * {g} * {g}" for n, g in zip(sax.segment_lengths(length, W), gap)) + ")"


def _search_ctes(k=K, length=LEN, sfx=""):
    """The search by its definition, on all pairs of queries and buckets: seeds, best so far, what is entered and compared."""
    return {
        "qs": f"SELECT id AS qid, {_paa_sql('v', W, length)} AS qpaa, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x))) AS norm FROM series",
        "env": "SELECT bucket, count(*) AS size, " + ", ".join(
            f"[{', '.join(f'{f}(paa[{i + 1}])' for i in range(W))}] AS {c}" for c, f in (("lo", "min"), ("hi", "max"))) + " FROM full_leaves GROUP BY bucket",
        "qb": f"SELECT q.qid, e.bucket, e.size, {_env_lb_sql('e.lo', 'e.hi', length)} AS blb FROM qs q CROSS JOIN env e",
        f"seeds{sfx}": f"""SELECT qid, bucket FROM (SELECT *, sum(size) OVER (PARTITION BY qid ORDER BY blb, bucket ROWS UNBOUNDED PRECEDING) AS cum FROM qb)
  WHERE cum - size < {k + 1}""",
        **_KNN_SERIES,
        f"first{sfx}": "SELECT p.qid, p.id, p.d, row_number() OVER (PARTITION BY p.qid ORDER BY p.d, p.id) AS r FROM pairs p "
                       f"JOIN full_leaves l ON l.id = p.id JOIN seeds{sfx} s ON s.qid = p.qid AND s.bucket = l.bucket",
        f"best{sfx}": f"SELECT q.qid, q.qpaa, coalesce(f.d + 1e-12 * (f.d + q.norm), 'inf'::DOUBLE) AS reach FROM qs q "
                      f"LEFT JOIN (SELECT qid, d FROM first{sfx} WHERE r = {k}) f USING (qid)",
        f"entered{sfx}": f"SELECT b.qid, b.bucket FROM qb b JOIN best{sfx} best USING (qid) WHERE b.blb <= best.reach",
    }


_SEARCH = _search_ctes()


def _counters_sql(length=LEN, sfx=""):
    return f"""SELECT q.qid, n.n_buckets, coalesce(c.n_lb, 0)::BIGINT AS n_lb, (coalesce(f.n, 0) + coalesce(c.n_new, 0))::BIGINT AS n_dist,
  {S.r6('(coalesce(f.n, 0) + coalesce(c.n_new, 0)) / (SELECT count(*) - 1.0 FROM series)')} AS hardness
FROM qs q
LEFT JOIN (SELECT qid, count(*)::BIGINT AS n_buckets FROM (SELECT * FROM seeds{sfx} UNION SELECT * FROM entered{sfx}) GROUP BY qid) n USING (qid)
LEFT JOIN (SELECT qid, count(*) AS n FROM first{sfx} GROUP BY qid) f USING (qid)
LEFT JOIN (
  SELECT e.qid, count(*) AS n_lb, count(*) FILTER (s.bucket IS NULL AND sqrt({_lb_sql('q.qpaa', 'l.sax', W, length)}) <= q.reach) AS n_new
  FROM entered{sfx} e JOIN full_leaves l ON l.bucket = e.bucket AND l.id <> e.qid JOIN best{sfx} q ON q.qid = e.qid
  LEFT JOIN seeds{sfx} s ON s.qid = e.qid AND s.bucket = e.bucket, (SELECT {_bp_sql()} AS bp) GROUP BY e.qid) c USING (qid)"""


def index_ctes(length: int, ks: tuple[int, ...]) -> dict[str, str]:
    """The search over the ``embeddings`` (E7): tables ``sax<k>`` of its counters for each k."""
    ctes = _ctes(series="SELECT vec_id AS id, embedding AS v FROM embeddings", length=length)
    ctes.update(_tree_sql())
    for k in ks:
        ctes.update(_search_ctes(k, length, f"_{k}"))
        ctes[f"sax{k}"] = _counters_sql(length, f"_{k}")
    del ctes["pairs"]  # the result tables have it: all pairs of the embeddings
    return ctes


@register("sax_counters", _tree(_counters_sql(), extra=_SEARCH))
def q_sax_counters(spark, sf):
    s = _summary_kept(spark, sf)
    lv = sax.build_leaves(s, W, LEAF)
    _, c = sax.sax_search(s, lv, _queries(s), K, W, exclude_self=True)
    return c.select("qid", "n_buckets", "n_lb", "n_dist", vec.rnd("hardness").alias("hardness"))


@register("sax_approx", _tree(f"SELECT qid, r::BIGINT AS rank, id, {S.r6('d')} AS d FROM first WHERE r <= {K}", extra=_SEARCH))
def q_sax_approx(spark, sf):
    s = _summary_kept(spark, sf)
    lv = sax.build_leaves(s, W, LEAF)
    a = sax.sax_approx(s, lv, _queries(s), K, W, exclude_self=True)
    return a.select("qid", F.col("rank").cast("long"), "id", vec.rnd("d").alias("d"))


@register("sax_unpruned", _sql(f"""SELECT qid, rank::BIGINT AS rank, id, {S.r6('d')} AS d FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM pairs) WHERE rank <= {K}""", extra=_KNN_SERIES))
def q_sax_unpruned(spark, sf):
    """The search without lower bounds: every series is compared."""
    s = _summary_kept(spark, sf)
    ans, _ = sax.sax_search(s, sax.build_leaves(s, W, LEAF), _queries(s), K, W, lower_bounding=False, exclude_self=True)
    return ans.select("qid", F.col("rank").cast("long"), "id", vec.rnd("d").alias("d"))


@register("sax_budget", _sql(f"""SELECT qid, rank::BIGINT AS rank, id, {S.r6('d')} AS d FROM (
  SELECT p.qid, p.id, p.d, row_number() OVER (PARTITION BY p.qid ORDER BY p.d, p.id) AS rank
  FROM pairs p JOIN (SELECT qid, id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY lb, id) AS o FROM lbs) WHERE o <= {BUDGET}) b
  USING (qid, id)) WHERE rank <= {K}""", extra={**_PAIRS_LB, **_KNN_SERIES}))
def q_sax_budget(spark, sf):
    s = _summary_kept(spark, sf)
    b = sax.sax_budget(s, _queries(s), K, W, BUDGET, exclude_self=True)
    return b.select("qid", F.col("rank").cast("long"), "id", vec.rnd("d").alias("d"))

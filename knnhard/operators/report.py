"""Reporting over result tables.

Result tables (metric rows, index-performance rows, convergence traces) are
plain DataFrames; reports are grouped aggregates, windows, pivots and
rank statistics over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knnhard.operators.quantiles import exact_quantiles
from knnhard.operators.ranks import average_ranks, kendall, kendall_tau_b, spearman  # noqa: F401  (I6, I7)

# Category orders used for sorting report rows
DIFFICULTY_ORDER = ["-", "easy", "medium", "hard", "hard+"]
METHOD_ORDER = ["Baseline", "GaussianNoise", "Annealing", "SGD"]
# Exact-match relabelling of workload descriptions
RELABEL = {
    "GaussianNoise(0.1)": "GaussianNoise(easy)",
    "GaussianNoise(1.0)": "GaussianNoise(medium)",
    "GaussianNoise(10.0)": "GaussianNoise(difficult)",
    "Annealing(rc, 2.10, 1.90)": "Annealing(rc, easy)",
    "Annealing(rc, 1.80, 1.70)": "Annealing(rc, medium)",
    "Annealing(rc, 1.50, 1.30)": "Annealing(rc, difficult)",
    "Annealing(rc, 1.05, 1.03)": "Annealing(rc, medium)",
    "Annealing(rc, 1.01, 1.00)": "Annealing(rc, difficult)",
    "Annealing(faiss_ivf, 0.04, 0.06)": "Annealing(faiss_ivf, easy)",
    "Annealing(faiss_ivf, 0.19, 0.21)": "Annealing(faiss_ivf, medium)",
}
# Index display names
INDEX_NAMES = {"faiss_ivf": "FaissIVF", "faiss_hnsw": "FaissHNSW", "fashion_mnist": "fashion-mnist"}


# --------------------------------------------------------- aggregation

def group_means(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Means per group (I1). A group with a NULL or NaN mean stays, as in the SQL: the others of its means count."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])


def max_then_mean(df: DataFrame, inner: list[str], outer: list[str], col: str) -> DataFrame:
    """Max per inner group, then mean per outer group."""
    m = df.groupBy(*inner).agg(F.max(col).alias(col))
    return m.groupBy(*outer).agg(F.avg(col).alias(col))


def lag_diff(df: DataFrame, keys: list[str], order: str, col: str, out: str) -> DataFrame:
    """``col - lag(col)`` per group, the first row minus 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.col(col) - F.lag(col, 1, 0).over(w))


def pivot_means(df: DataFrame, keys: list[str], pivot_col: str, values: list, col: str) -> DataFrame:
    """One value x pivot keys, explicit pivot values (I4)."""
    return df.groupBy(*keys).pivot(pivot_col, values).agg(F.avg(col))


def unpivot(df: DataFrame, ids: list[str], cols: list[str], name="measure", value="value") -> DataFrame:
    """Wide measures to long rows."""
    return df.unpivot(ids, cols, name, value)


def float_columns(df: DataFrame) -> list[str]:
    """Columns of floating type, i.e. the measures."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


# ------------------------------------------------------------ binning

def quantile_bins(df: DataFrame, keys: list[str], col: str, value_cols: list[str], bins: int = 100,
                  digits: int | None = None) -> DataFrame:
    """Equal-frequency bins per group (right-closed, lowest included); when
    edges repeat, equal-width bins with the lower edge extended by 0.1 %
    of the range; mean of ``col`` and ``value_cols`` per non-empty bin (I8)."""
    fin = df.where(F.col(col).isNotNull() & ~F.isnan(col) & (F.abs(col) < float("inf")))
    probs = [i / bins for i in range(bins + 1)]
    q = exact_quantiles(fin, keys, col, probs)
    qe = q.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("p", "q"))).alias("pq"))  # bins+1 values per group
    qe = qe.select(*keys, F.transform("pq", lambda t: t.getField("q")).alias("qe"))
    mm = fin.groupBy(*keys).agg(F.min(col).alias("mn"), F.max(col).alias("mx"))
    width = F.transform(F.sequence(F.lit(0), F.lit(bins)),
                        lambda i: F.when(i == 0, F.col("mn") - (F.col("mx") - F.col("mn")) * 0.001)
                        .when(i == bins, F.col("mx")).otherwise(F.col("mn") + i * ((F.col("mx") - F.col("mn")) / bins)))
    dup = F.size(F.array_distinct("qe")) < F.size("qe")
    edges = qe.join(mm, keys).select(*keys, F.when(dup, width).otherwise(F.col("qe")).alias("edges"))
    j = fin.join(F.broadcast(edges), keys)
    b = F.size(F.filter(F.slice("edges", 2, bins), lambda e: e < F.col(col)))
    mean = F.avg if digits is None else (lambda c: F.round(F.avg(c), digits))  # digits: to compare between engines
    return j.groupBy(*keys, b.alias("bin")).agg(*[mean(c).alias(c) for c in [col] + value_cols]).na.drop()


def equal_bins(df: DataFrame, keys: list[str], col: str, value_col: str, bins: int = 40) -> DataFrame:
    """Equal-width bins between min and max (last bin closed), mean per bin."""
    mm = df.groupBy(*keys).agg(F.min(col).alias("mn"), F.max(col).alias("mx"))
    j = df.join(F.broadcast(mm), keys)
    b = F.least(F.lit(bins - 1), F.floor((F.col(col) - F.col("mn")) / (F.col("mx") - F.col("mn")) * bins)).cast("int")
    return j.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(value_col).alias(value_col))


def outlier_cut(df: DataFrame, col: str, q: float = 0.99) -> DataFrame:
    """Rows with ``col`` strictly below its q-quantile."""
    thr = exact_quantiles(df, [], col, [q]).first()["q"]
    return df.where(F.col(col) < F.lit(thr))


def rank_marks(df: DataFrame, group: str, value: str, digits: int | None = None) -> DataFrame:
    """Abs value, sign and best/second marks per group (I11); ``digits`` rounds
    the compared values."""
    compared = F.col("abs_value") if digits is None else F.round("abs_value", digits)
    w = Window.partitionBy(group).orderBy(compared.desc_nulls_last())
    d = df.withColumn("abs_value", F.abs(value)).withColumn("positive", F.col(value) > 0)
    d = d.withColumn("_r", F.dense_rank().over(w))
    return d.withColumn("mark", F.when(F.col("_r") == 1, "best").when(F.col("_r") == 2, "second").otherwise("")).drop("_r")


# ------------------------------------------------------------- labels

def clean_dataset(c: Column) -> Column:
    """Path strip and dataset prefix (I12): ``'.*/'`` and ``'-.*'`` removed."""
    return F.regexp_replace(F.regexp_replace(c, ".*/", ""), "-.*", "")


def rename_index(c: Column) -> Column:
    out = c
    for a, b in INDEX_NAMES.items():
        out = F.regexp_replace(out, a, b)
    return out


def method_of(workload: Column) -> Column:
    """Method = description before '(' with File -> Baseline."""
    m = F.regexp_replace(workload, r"\(.*", "")
    return F.when(m == "File", F.lit("Baseline")).otherwise(m)


def relabel(c: Column) -> Column:
    """Exact-match relabel dictionary."""
    m = F.create_map(*[F.lit(x) for kv in RELABEL.items() for x in kv])
    return F.coalesce(F.element_at(m, c), c)


def difficulty(workload: Column) -> Column:
    """First of easy, medium, hard+, hard, else '-' (I14)."""
    return F.coalesce(F.nullif(F.regexp_extract(workload, r"(easy|medium|hard\+|hard)", 1), F.lit("")), F.lit("-"))


def order_of(c: Column, categories: list[str]) -> Column:
    """Ordered category position (1-based, 0 = not listed)."""
    return F.array_position(F.array(*[F.lit(x) for x in categories]), c)


def family(workload: Column) -> Column:
    """Workload family (I16)."""
    return (F.when(workload.startswith("Gaussian"), F.lit("GaussianNoise"))
            .when(workload.startswith("Annealing(faiss_ivf"), F.lit("Annealing(faiss_ivf)"))
            .when(workload.startswith("Annealing(rc"), F.lit("Annealing(rc)")).otherwise(workload))


def coalesce_k(rc10: Column, rc1: Column) -> tuple[Column, Column]:
    """(k, rc) from the two wide columns."""
    return F.when(rc10.isNull(), F.lit(1)).otherwise(F.lit(10)), F.coalesce(rc10, rc1)


def cap_one(c: Column) -> Column:
    """Hardness capped at 1."""
    return F.least(c, F.lit(1.0))


def in_target_share(df: DataFrame, keys: list[str], col: str, lo: float, hi: float) -> DataFrame:
    """Share of rows whose value lies in [lo, hi]."""
    return df.groupBy(*keys).agg(F.avg(F.col(col).between(lo, hi).cast("double")).alias("in_target"),
                                 F.count(F.lit(1)).alias("n"))


def last_two(df: DataFrame, order: str, label: str) -> DataFrame:
    """The two rows with the largest ``order`` value, labelled (I20): a
    distributed top-2 (per-partition top-2, then merge)."""
    return df.orderBy(F.desc(order), F.desc("query_index")).limit(2).withColumn("label", F.lit(label))


# ---------------------------------------------------- index performance

PERF_COLS = ["dataset", "workload", "query_index", "index_name", "index_params", "time_s", "distcomp", "recall", "k",
             "target_recall"]


def perf_rows(h: DataFrame, dataset: Column, workload: Column, index_name: str, params: Column, k: int,
              target_recall: float | None) -> DataFrame:
    """Index-performance rows with the fixed schema (E7); ``time_s`` is NULL
    (wall time is not a result column)."""
    return h.select(dataset.alias("dataset"), workload.alias("workload"), F.col("qid").alias("query_index"),
                    F.lit(index_name).alias("index_name"), params.alias("index_params"),
                    F.lit(None).cast("double").alias("time_s"), F.col("distcomp").cast("double").alias("distcomp"),
                    F.col("recall").cast("double").alias("recall"), F.lit(k).alias("k"),
                    F.lit(target_recall).cast("double").alias("target_recall"))

"""Soft-membership mixing: document rates whose expected domain token totals match targets.

A classifier learned from a labelled table gives every document a posterior over the domains. With
t the tokens and p the posterior of a document, its rate r adds r t p to the domains' expected
token totals. The rates minimise the squared distance of those totals to the targets (in the
metric of the inverse second moments, which makes the step length 1) subject to r >= 0 by
projected gradient, starting at 1. The gradient of a document is a product of its own posterior and
one vector for all, so an iteration is one distributed sum over the documents, the driver keeps
one short vector per iteration, and rates are recomputed from these vectors where they are needed.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knnhard.llm import textmodel
from knnhard.llm._common import col, fresh, materialise, table

#: Shares of the mix by domain of the registered query and the pipeline.
TARGETS = {"clean": 0.90, "low": 0.08, "toxic": 0.02}


def rates(p: np.ndarray, path: list[np.ndarray], ahead: bool = False, whole: int | None = None) -> np.ndarray:
    """Rates of documents with posteriors ``p`` after the projected steps of ``path``, each taken from a point
    ahead along the last change (Nesterov); ``ahead`` gives the point of the next step. Rates are 0 or more, and 1
    or more for documents whose most likely domain is ``whole``."""
    r = before = np.ones(len(p))
    least = np.zeros(len(p)) if whole is None else (p.argmax(axis=1) == whole).astype(float)
    t = 1.0
    for step in [*path, None]:
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = r if r is before else np.maximum(least, r + (t - 1) / grown * (r - before))
        if step is None:
            return y if ahead else r
        before, r, t = r, np.maximum(least, y - p @ step), grown
    return r


def _matrix(cells: pa.Array, k: int) -> np.ndarray:
    return np.asarray(cells.flatten(), np.float64).reshape(-1, k)


def _sum_over(members: DataFrame, k: int, width: int, part) -> np.ndarray:
    """Sum of ``part(tokens, posteriors)``, an array of ``width`` numbers, over all documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += part(b.column(0).to_numpy(zero_copy_only=False).astype(np.float64), _matrix(b.column(1), k))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=[f"s{i}" for i in range(width)])

    got = members.select("n_words", "p").mapInArrow(run, ", ".join(f"s{i} double" for i in range(width)))
    row = got.agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)]).first()
    return np.array([x or 0.0 for x in row])


def fit_rates(members: DataFrame, targets: np.ndarray, total: float | None = None, rounds: int = 200,
              tol: float = 1e-6, whole: int | None = None) -> list[np.ndarray]:
    """Steps of the projected gradient for ``members`` (n_words, p), a table read once per round.

    ``targets`` are the domains' shares; ``total`` the tokens of the mix (the corpus's own if None). With a domain
    ``whole``, all of whose documents are read at least once, the total is at least that domain's expected tokens, over
    all documents, divided by its share.
    It ends when the totals are within ``tol`` of the targets, or the objective has settled for three rounds,
    as it does at targets that no nonnegative rates can meet. Where neither holds after ``rounds``, a warning says how
    far the totals are off.
    """
    k = len(targets)
    moments = _sum_over(members, k, k * k, lambda t, p: ((p * t[:, None]).T @ p).ravel()).reshape(k, k)
    tokens = float(moments.sum())  # posteriors sum to 1
    shares = np.asarray(targets, float) / np.sum(targets)
    total = tokens if total is None else total
    if whole is not None and shares[whole] > 0:
        total = max(total, float(moments[whole].sum()) / shares[whole])
    goal = shares * total
    metric = np.linalg.pinv(moments, rcond=1e-10)

    def totals(t: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.concatenate([(t * rates(p, path, whole=whole)) @ p, (t * rates(p, path, ahead=True, whole=whole)) @ p])

    path: list[np.ndarray] = []
    before, settled = np.inf, 0
    for _ in range(rounds):
        both = _sum_over(members, k, 2 * k, totals)
        miss, miss_ahead = both[:k] - goal, both[k:] - goal
        far = float(miss @ metric @ miss)
        settled = settled + 1 if abs(before - far) <= 1e-4 * far else 0
        if np.abs(miss).sum() <= tol * max(goal.sum(), 1.0) or settled == 3:
            break
        before = far
        path.append(metric @ miss_ahead)
    else:
        if rounds:
            off = np.abs(miss).sum() / max(goal.sum(), 1.0)
            warnings.warn(f"after {rounds} rounds the mix's totals are still {off:.2g} of the whole off their targets", stacklevel=2)
    return path


def copies(rate: Column, *key: Column) -> Column:
    """How often a document is read: the rate rounded up or down by a digest of its key, so that the
    expected number is the rate."""
    u = F.pmod(F.xxhash64(*key), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return F.floor(rate + u).cast("int")


def domain_labels(labels: DataFrame) -> DataFrame:
    """(id, y) of the labelled table: toxic, else clean or low by quality; rows with a null label are left out."""
    return labels.where("toxic IS NOT NULL AND quality IS NOT NULL").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("low").alias("y"))


def _at(model: textmodel.TextModel, domain: str | None) -> int | None:
    return model.classes.index(domain) if domain in model.classes else None


def _fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float], total: float | None, id_col: str, text_col: str,
         whole: str | None = None):
    model = textmodel.train(docs, labels, id_col, text_col)
    members = materialise(textmodel.score_table(docs, model, id_col, text_col), "members")
    path = fit_rates(members, np.array([targets.get(c, 0.0) for c in model.classes]), total,
                     whole=_at(model, whole)) if model.classes else []
    return model, members, path


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], total: float | None = None,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, domains, posteriors, rate (>= 0), copies.

    ``labels`` has (id, y); a domain without target has target 0. Null and empty texts have no tokens
    and the rate of their posterior; repeated rows have equal rates; an empty table gives an empty result,
    and without any label every rate is 1. Other columns are not read.
    """
    model, members, path = _fit(docs, labels, targets, total, id_col, text_col)
    k = max(1, len(model.classes))
    kind = members.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = rates(_matrix(b.column(2), k), path)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r)], names=["id", "n_words", "p", "rate"])

    out = members.mapInArrow(run, f"id {kind}, n_words long, p array<double>, rate double")
    return out.select(F.col("id").alias(id_col), F.col("n_words").alias("n_tokens"),
                      F.array(*[F.lit(c) for c in model.classes]).cast("array<string>").alias("domains"),
                      F.col("p").alias("posteriors"), "rate", copies(F.col("rate"), F.col("id")).alias("copies"))


def apply_mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float], total: float | None = None,
              id_col: str = "doc_id", text_col: str = "text", whole: str | None = None) -> DataFrame:
    """The rows of ``docs`` that the mix reads at least once, with all their columns, and rate and copies
    (under other names if taken). Every document whose most likely domain is ``whole`` stays: the mix repeats or
    thins the others."""
    model, _, path = _fit(docs, labels, targets, total, id_col, text_col, whole)
    least = _at(model, whole)
    rate, times = fresh(docs, "rate"), fresh(docs, "copies")
    at = docs.columns.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = rates(sent.value.posteriors(b.column(at).to_pylist()), path, whole=least)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(r, pa.float64())], names=[*b.schema.names, rate])

    out = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(rate, T.DoubleType())]))
    return out.withColumn(times, copies(col(rate), col(id_col))).where(col(times) > 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), domain_labels(table(spark, sf_dir, "labels")), TARGETS)

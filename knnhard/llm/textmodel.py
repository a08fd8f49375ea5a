"""Softmax classifier over word, word-beginning and style features of whole texts.

Feature statistics and encoding run as Spark jobs; only the fit, on a bounded sample of labelled
rows encoded as feature positions, runs on the driver.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knnhard.llm._common import col, few, materialise
from knnhard.llm._common import top as first_rows
from knnhard.llm.decontaminate import _TO_WORDS

BEGINNINGS = range(4, 10)
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOL = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_SPACE = bytes([*range(9, 14), 32])


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_TO_WORDS).split()


def _step(share: float) -> int:
    return int(min(9, share * 20))


def style(text: str | None) -> set[bytes]:
    """How the text is written, as a few features: shares of upper case, digits, symbols, repeated words and lines, sizes."""
    raw = (text or "").encode("utf-8", "replace")
    n = max(1, len(raw.translate(None, _SPACE)))
    tokens, lines = raw.split(), raw.split(b"\n")
    shares = {
        "upper": 1 - len(raw.translate(None, _UPPER)) / max(1, len(raw)), "digit": (len(raw) - len(raw.translate(None, _DIGIT))) / n,
        "symbol": (len(raw) - len(raw.translate(None, _SYMBOL))) / n, "same": 1 - len(set(tokens)) / max(1, len(tokens)),
        "lines": 1 - len(set(lines)) / len(lines)}
    out = {f"\x00{k}{_step(v)}".encode() for k, v in shares.items()}
    out.add(b"\x00length%d" % min(9, len(tokens).bit_length() // 2))
    out.add(b"\x00word%d" % min(9, n // max(1, len(tokens)) // 2))
    return out


def features(text: str | None, with_style: bool) -> set[bytes]:
    """Distinct words, their beginnings of 4 to 9 bytes (marked by a star), and the style."""
    ws = set(words(text))
    out = set(ws)
    for k in BEGINNINGS:
        out.update(w[:k] + b"*" for w in ws if len(w) > k)
    return out | style(text) if with_style else out


@dataclass(frozen=True)
class TextModel:
    classes: tuple[str, ...]
    vocab: dict[bytes, int]
    weights: np.ndarray
    with_style: bool

    @cached_property
    def _plain(self) -> frozenset[bytes]:
        return frozenset(self.vocab)

    @cached_property
    def _starts(self) -> dict[int, tuple[frozenset[bytes], dict[bytes, int]]]:
        by: dict[int, dict[bytes, int]] = {}
        for f, i in self.vocab.items():
            if f.endswith(b"*"):
                by.setdefault(len(f) - 1, {})[f[:-1]] = i
        return {k: (frozenset(v), v) for k, v in by.items()}

    def positions(self, text: str | None) -> list[int]:
        """Positions of the text's features; the last position is the constant."""
        ws = set(words(text))
        found = [self.vocab[w] for w in ws & self._plain]
        for k, (known, at) in self._starts.items():
            found += [at[p] for p in {w[:k] for w in ws if len(w) > k} & known]
        if self.with_style:
            found += [self.vocab[f] for f in style(text) & self._plain]
        return found + [len(self.vocab)]

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        z = np.array([self.weights[self.positions(t)].sum(axis=0) for t in texts]).reshape(len(texts), -1)
        return softmax(z)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True, initial=-np.inf))
    return e / e.sum(axis=1, keepdims=True)


def sample_labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_class: int) -> tuple[DataFrame, dict[str, int]]:
    """(y, t) of at most ``per_class`` ids of each class, by smallest digest of the id, one row per id, and the
    classes' numbers of labelled ids. ``labels`` has (id, y); of several labels of an id the largest counts, of several
    texts the smallest."""
    one = labels.where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max(F.col("y").cast("string")).alias("y"))
    one = materialise(one, "labels")
    per = one.groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["y"]: r["n"] for r in per.orderBy("y").collect()}
    h = F.xxhash64("id")
    # ids whose digest cannot be among a class's smallest go before they are ranked
    likely = one.join(per, "y").where((F.col("n") <= 4 * per_class) | (
        h.cast("double") <= F.lit(2.0 ** 64) * (4.0 * per_class / F.col("n")) - F.lit(2.0 ** 63)))
    nth = F.row_number().over(Window.partitionBy("y").orderBy(h, "id"))
    picked = likely.withColumn("nth", nth).where(F.col("nth") <= per_class).select("id", "y")
    texts = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("t"))
    # the sample is bounded by its limits, so it is the side to send
    rows = texts.join(F.broadcast(materialise(picked, "picked")), "id").groupBy("id", "y").agg(F.min("t").alias("t"))
    return materialise(rows.select("y", "t"), "labelled"), sizes


def select_features(sample: DataFrame, classes: tuple[str, ...], with_style: bool, top: int, min_rows: int) -> list[bytes]:
    """The ``top`` features by chi-square against the classes, each in ``min_rows`` sampled texts."""
    at = {y: i for i, y in enumerate(classes)}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Counter] = [Counter() for _ in classes]
        for f in frames:
            for y, t in zip(f["y"], f["t"]):
                held[at[y]].update(features(t, with_style))
            if sum(map(len, held)) > 1 << 20:
                for i, h in enumerate(held):
                    yield pd.DataFrame({"f": list(h.keys()), "y": i, "n": list(h.values())})
                held = [Counter() for _ in classes]
        for i, h in enumerate(held):
            yield pd.DataFrame({"f": list(h.keys()), "y": i, "n": list(h.values())})

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = max(1, sum(sizes.values()))
    per = [F.sum(F.when(F.col("y") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(classes))]
    counts = sample.mapInPandas(count, "f binary, y int, n long").groupBy("f").agg(F.sum("n").alias("n"), *per)
    chi = F.lit(0.0)
    for i, y in enumerate(classes):
        want = F.col("n") * F.lit(sizes.get(y, 0) / total)
        chi = chi + (F.col(f"n{i}") - want) ** 2 / F.greatest(want, F.lit(1e-9))
    best = first_rows(counts.where(F.col("n") >= min_rows).select("f", chi.alias("chi")), top, F.desc("chi"), "f")
    return sorted(bytes(r["f"]) for r in best)


def encode(sample: DataFrame, model: TextModel, make: Callable[[str | None], list[list[bytes]]] | None = None) -> pd.DataFrame:
    """The bounded sample as positions on the driver; ``make`` may give further feature lists of a row,
    returned as column ``pairs`` (two lists each)."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for f in frames:
            pairs = [[[m.vocab[x] for x in fs if x in m.vocab] + [len(m.vocab)] for fs in make(t)] if make else [] for t in f["t"]]
            yield pd.DataFrame({"y": f["y"], "x": [m.positions(t) for t in f["t"]], "pairs": pairs})

    return sample.mapInPandas(run, "y string, x array<int>, pairs array<array<int>>").toPandas()


def _csr(rows: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    return flat, np.concatenate(([0], np.cumsum(sizes)))[:-1]


def fit(rows: list, y: np.ndarray, row_weight: np.ndarray, n_features: int, n_classes: int, l2: float = 1e-4,
        pairs: list | None = None, pair_weight: float = 0.0, steps: int = 400, rate: float = 0.05) -> np.ndarray:
    """Weights (features + constant, classes) by Adam on the weighted cross-entropy, an L2 term, and
    ``pair_weight`` times the mean squared change of the posteriors between the two texts of each pair."""
    w = np.zeros((n_features + 1, n_classes))
    if not len(rows):
        return w
    goal = np.eye(n_classes)[y]
    flat, at = _csr(rows)
    owner = np.repeat(np.arange(len(rows)), np.diff(np.append(at, len(flat))))
    share = (row_weight / row_weight.sum())[:, None]
    both = [p for pair in pairs or [] for p in pair]
    pflat, pat = _csr(both)
    powner = np.repeat(np.arange(len(both)), np.diff(np.append(pat, len(pflat))))
    m1, m2 = np.zeros_like(w), np.zeros_like(w)

    def back(g: np.ndarray, who: np.ndarray, cols: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(cols, weights=g[who, c], minlength=n_features + 1) for c in range(n_classes)], axis=1)

    for step in range(1, steps + 1):
        p = softmax(np.add.reduceat(w[flat], at, axis=0))
        grad = back(share * (p - goal), owner, flat) + l2 * np.vstack([w[:-1], np.zeros(n_classes)])
        if both and pair_weight:
            q = softmax(np.add.reduceat(w[pflat], pat, axis=0))
            d = q[0::2] - q[1::2]
            v = np.empty_like(q)
            v[0::2], v[1::2] = 2 * d, -2 * d
            g = q * (v - (q * v).sum(axis=1, keepdims=True)) * (pair_weight / (len(both) / 2))
            grad += back(g, powner, pflat)
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.999 * m2 + 0.001 * grad ** 2
        w -= rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_style: bool = True,
          per_class: int = 4000, top: int = 4096, min_rows: int = 5, l2: float = 1e-4,
          forced: tuple[bytes, ...] = (), make_pairs: Callable[[str | None], list[list[bytes]]] | None = None,
          pair_weight: float = 0.0, balance: float = 0.0) -> TextModel:
    """Fit on at most ``per_class`` labelled rows of each class (documented bound); rows are weighted
    back to the classes' shares among all labelled ids, to the power 1 - ``balance``. No labels give a
    model without classes."""
    sample, sizes = sample_labelled(docs, labels, id_col, text_col, per_class)
    classes = tuple(sorted(sizes))
    chosen = select_features(sample, classes, with_style, top, min_rows)
    vocab = {f: i for i, f in enumerate(sorted({*chosen, *forced}))}
    blank = TextModel(classes, vocab, np.zeros((len(vocab) + 1, max(1, len(classes)))), with_style)
    got = encode(sample, blank, make_pairs)
    y = np.array([classes.index(k) for k in got["y"]], np.int64)
    held = np.bincount(y, minlength=len(classes)) if len(y) else np.zeros(len(classes))
    weight = np.array([sizes[classes[k]] ** (1 - balance) / held[k] for k in y])
    pairs = [ps[i:i + 2] for ps in got["pairs"] for i in range(0, len(ps), 2)]
    w = fit(list(got["x"]), y, weight, len(vocab), max(1, len(classes)), l2, pairs, pair_weight)
    return TextModel(classes, vocab, w, with_style)


def score_table(docs: DataFrame, model: TextModel, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, p): the posterior of every class for every whole text."""
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            n = [len((t or "").split()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(list(sent.value.posteriors(texts)), pa.list_(pa.float64()))],
                names=["id", "n_words", "p"])

    return rows.mapInArrow(run, f"id {kind}, n_words long, p array<double>")

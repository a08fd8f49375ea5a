"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts the n-grams of every labelled text; an n-gram belongs to each language in which it
is frequent enough, both absolutely and against the language where it is most frequent. All
languages share one Bloom filter whose cells are bit masks with one bit per language, so one
lookup (the AND of an n-gram's cells) returns all languages that contain it. A text's n-grams are
looked up once, the masks' bits are counted per language, each count is corrected for the false
positives expected from that language's share of set cells, and the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knnhard.llm._common import col, crc_mod, materialise, table

UNKNOWN = "und"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BLOCK = 1 << 18


@dataclass(frozen=True)
class LanguageFilters:
    """``cells`` holds a mask per cell; bit i stands for ``languages[i]``, by descending training size. With over 64
    languages a cell is a row of 64-bit words, and bit i is bit i % 64 of word i // 64."""

    languages: tuple[str, ...]
    cells: np.ndarray
    fill: np.ndarray
    n: int
    hashes: int


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _letters_only(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters as one space, framed by spaces."""
    cp = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = _letters()[cp]
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]
    return np.where(is_letter, cp, np.uint32(32))[keep]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def ngrams(texts: list[str | None], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (64-bit n-gram, position of its text in ``texts``); n-grams do not span texts.

    A block holds a bounded number of n-grams, however long the texts are.
    """
    parts: list[np.ndarray] = []
    who: list[int] = []
    held = 0
    for i, t in enumerate(texts):
        cp = _letters_only(t) if t else np.zeros(0, np.uint32)
        for a in range(0, max(len(cp) - n + 1, 0), _BLOCK):
            parts.append(cp[a:a + _BLOCK + n - 1])
            who.append(i)
            held += len(parts[-1])
            if held >= _BLOCK:
                yield _grams(parts, who, n)
                parts, who, held = [], [], 0
    if parts:
        yield _grams(parts, who, n)


def _grams(parts: list[np.ndarray], who: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    cp = np.concatenate(parts).astype(np.uint64)
    g = cp[:len(cp) - n + 1].copy()
    for k in range(1, n):
        g = _mix(g) ^ cp[k:len(cp) - n + 1 + k]
    sizes = np.array([len(p) for p in parts])
    owner = np.repeat(np.array(who), sizes)[:len(g)]
    ends = np.cumsum(sizes)
    inside = np.ones(len(g), bool)
    for k in range(1, n):
        at = ends[:-1] - k
        inside[at[at < len(g)]] = False
    return g[inside], owner[inside]


def count_ngrams(labelled: DataFrame, n: int, keep: int = 1 << 20) -> DataFrame:
    """(gram, lang, n) over all rows of ``labelled`` (lang, t); tasks add up before the shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[pd.Series]] = {}
        size = 0

        def out() -> Iterator[pd.DataFrame]:
            for lang, parts in held.items():
                s = pd.concat(parts).groupby(level=0).sum()
                yield pd.DataFrame({"gram": s.index.to_numpy(), "lang": lang, "n": s.to_numpy()})

        for f in frames:
            for lang, rows in f.groupby("lang"):
                for g, _ in ngrams(rows["t"].tolist(), n):
                    u, c = np.unique(g, return_counts=True)
                    held.setdefault(lang, []).append(pd.Series(c, index=u.view(np.int64)))
                    size += len(u)
            if size > keep:  # compact; if still large, hand over and start anew
                held = {k: [pd.concat(v).groupby(level=0).sum()] for k, v in held.items()}
                size = sum(len(v[0]) for v in held.values())
                if size > keep // 2:
                    yield from out()
                    held, size = {}, 0
        yield from out()

    rows = labelled.mapInPandas(run, "gram long, lang string, n long")
    return rows.groupBy("gram", "lang").agg(F.sum("n").alias("n"))


def train(labelled: DataFrame, n: int = 4, cells: int | None = None, hashes: int = 3, min_rate: float = 1e-6,
          min_share: float = 0.2) -> LanguageFilters:
    """Filters from ``labelled`` (lang, t), any number of languages.

    An n-gram is put in for a language, of any size, if it makes up ``min_rate`` of the language's n-grams and its
    rate is ``min_share`` of its rate in the language where it is most frequent, so a language has at most ``1 / min_rate``
    of them. Every labelled row counts. There are 8 cells for every n-gram of the largest language (2^20 at least) unless
    ``cells`` says how many; the driver gets one row per language and at most ``cells`` set cells for every 64 languages.
    """
    counts = count_ngrams(labelled.where("lang IS NOT NULL AND t IS NOT NULL"), n).persist()
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = tuple(sorted(sizes, key=lambda k: (-sizes[k], k)))
    words = -(-len(langs) // 64)
    dtype = next((d for d in (np.uint8, np.uint16, np.uint32) if len(langs) <= np.iinfo(d).bits), np.uint64)
    got = None
    if langs:
        of = labelled.sparkSession.createDataFrame([(k, i // 64, i % 64, float(sizes[k])) for i, k in enumerate(langs)],
                                                   "lang string, word int, bit int, size double")
        rated = counts.join(F.broadcast(of), "lang").withColumn("rate", F.col("n") / F.col("size"))
        most = F.max("rate").over(Window.partitionBy("gram"))
        member = rated.withColumn("most", most).where(
            (F.col("rate") >= min_share * F.col("most")) & (F.col("rate") >= min_rate))
        member = materialise(member.select("gram", "word", "bit"), "lang-grams")
        if cells is None:
            largest = member.groupBy("word", "bit").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
            cells = max(1 << 20, 1 << (8 * largest - 1).bit_length()) if largest else 1 << 20
        masks = member.groupBy("gram", "word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"))

        def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                g = b.column(0).to_numpy()
                for p in _positions(g.view(np.uint64), cells, hashes):
                    yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), b.column(1), b.column(2)], names=["cell", "word", "mask"])

        got = masks.mapInArrow(positions, "cell long, word int, mask long").groupBy("cell", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    cells = cells or 1 << 20
    table_ = np.zeros((cells, words) if words > 1 else cells, dtype)
    if got is not None:
        at = got["cell"].to_numpy(np.int64)
        table_[(at, got["word"].to_numpy(np.int64)) if words > 1 else at] = got["mask"].to_numpy(np.int64).view(np.uint64).astype(dtype)
    counts.unpersist()
    fill = np.array([np.count_nonzero(_bit(table_, i)) / cells for i in range(len(langs))])
    return LanguageFilters(langs, table_, fill, n, hashes)


def _bit(masks: np.ndarray, i: int) -> np.ndarray:
    """Bit of language i in masks of cells."""
    word = masks[:, i // 64] if masks.ndim == 2 else masks
    return (word >> word.dtype.type(i % 64)) & word.dtype.type(1)


def _positions(g: np.ndarray, cells: int, hashes: int) -> Iterator[np.ndarray]:
    h = _mix(g)
    step = _mix(h) | np.uint64(1)
    for k in range(hashes):
        yield (h + np.uint64(k) * step) % np.uint64(cells)


def lookup(model: LanguageFilters, g: np.ndarray) -> np.ndarray:
    """Mask of all languages that contain each n-gram."""
    cells = iter(_positions(g, len(model.cells), model.hashes))
    mask = model.cells[next(cells)]
    for p in cells:
        mask = mask & model.cells[p]
    return mask


def classify(model: LanguageFilters, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text; the score is the share of n-grams that its language holds,
    corrected for false positives."""
    total = np.zeros(len(texts))
    hits = np.zeros((len(texts), len(model.languages)))
    for g, who in ngrams(texts, model.n):
        total += np.bincount(who, minlength=len(texts))
        if model.languages:
            mask = lookup(model, g)
            for i in range(len(model.languages)):
                hits[:, i] += np.bincount(who, weights=_bit(mask, i), minlength=len(texts))
    out = [UNKNOWN] * len(texts)
    score = np.zeros(len(texts))
    if model.languages:
        false = model.fill ** model.hashes
        real = np.clip((hits - np.outer(total, false)) / (1 - np.minimum(false, 0.999)), 0, total[:, None])
        best = np.argmax(real, axis=1)
        for i, t in enumerate(texts):
            if total[i] > 0 or has_letter(t):
                out[i] = model.languages[best[i]]
        score = np.divide(real[np.arange(len(texts)), best], total, out=score, where=total > 0)
    return out, score


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def identify(docs: DataFrame, model: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (0 to 1).

    ``und`` with score 0 for null, empty and letterless texts, and for all if nothing was learned.
    Texts with letters too short for an n-gram, or with no known one, get the language with the most training
    text and score 0; ties go to the larger language as well. Other columns are not read.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = classify(sent.value, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)],
                                             names=["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(docs: DataFrame, model: LanguageFilters, text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language is known with ``min_score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score = classify(sent.value, b.column(at).to_pylist())
            yield b.filter(pa.array([k != UNKNOWN and s >= min_score for k, s in zip(lang, score)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, t) of the rows to learn from: crc32 of the id as text modulo 3 is not 1; an id of null
    is not learned from."""
    return docs.where(crc_mod(col(id_col), 3) != 1).select(
        col(lang_col).cast("string").alias("lang"), col(text_col).cast("string").alias("t"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(training_rows(docs)))
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")

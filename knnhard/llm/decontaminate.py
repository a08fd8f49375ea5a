"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

An item's windows (``window`` consecutive words; a shorter item is one window) are the patterns.
A text is normalised byte by byte (A-Z lower-cased, every separator byte to a space), so positions
in it are byte offsets of the original; its words, joined by single spaces, are scanned once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knnhard.llm._common import col, table

# word bytes: 0-9, a-z and everything above ASCII
_TO_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32
                  for b in range(256))

RESULT = ("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
          "items array<string>, spans array<struct<start:int,end:int>>")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TO_WORDS).split()


def _windows(words: list[bytes], window: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))}


def build_automaton(items: list[tuple[str, bytes | None]], window: int = 10) -> tuple[Any, list[str]]:
    """(automaton, item ids): each pattern's value is (words, characters, positions of its items)."""
    owners: dict[bytes, set[int]] = {}
    ids = sorted({i for i, _ in items})
    at = {i: n for n, i in enumerate(ids)}
    for i, text in items:
        for w in _windows(words_of(text), window):
            owners.setdefault(w, set()).add(at[i])
    auto = ahocorasick.Automaton()
    for w, own in owners.items():
        # bytes as Latin-1 characters: one character is one byte; the spaces hold word boundaries
        auto.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, len(w) + 2, tuple(own)))
    if owners:
        auto.make_automaton()
    return auto, ids


def scan(text: bytes | None, auto: Any) -> tuple[int, np.ndarray, set[int]]:
    """(number of words, mask of the words hit, positions of the items found) of one text."""
    words = words_of(text)
    if not words or not len(auto):
        return len(words), np.zeros(0, bool), set()
    found: set[int] = set()
    spans: list[tuple[int, int]] = []
    for end, (n, chars, own) in auto.iter(f" {b' '.join(words).decode('latin-1')} "):
        found.update(own)
        spans.append((end - chars + 2, n))
    if not spans:
        return len(words), np.zeros(0, bool), found
    starts = np.cumsum([1, *(len(w) + 1 for w in words[:-1])])
    first = np.searchsorted(starts, [s for s, _ in spans])
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + [n for _, n in spans], -1)
    return len(words), np.cumsum(edge[:-1]) > 0, found


def spans_of(text: bytes, hit: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words as offsets of characters in the original text."""
    raw = np.frombuffer(text, np.uint8)
    is_word = np.frombuffer(text.translate(_TO_WORDS), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], is_word.view(np.int8), [0]))))
    begin, end = edges[::2], edges[1::2]
    runs = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [{"start": int(chars[begin[a]]), "end": int(chars[end[b - 1]])} for a, b in zip(runs[::2], runs[1::2])]


def load_items(items: DataFrame, id_col: str, text_col: str, max_bytes: int) -> list[tuple[str, bytes | None]]:
    """The items on the driver, after their size is checked: the automaton goes to every task."""
    rows = items.select(col(id_col).cast("string").alias("i"), col(text_col).cast("binary").alias("t")).where("i IS NOT NULL")
    size = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + F.octet_length("i")), F.lit(0))).first()[0]
    if size > max_bytes:
        raise ValueError(f"benchmark items hold {size} bytes, more than max_bytes={max_bytes}: scan them in several parts")
    return [(r["i"], None if r["t"] is None else bytes(r["t"])) for r in rows.collect()]


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window: int = 10,
                  max_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: id, number of words, words hit, items with an occurring window, SHA-256
    of those item ids (sorted as strings, comma-joined), contaminated (any word hit), the item ids,
    and the hit passages as character offsets of the original text.

    Null and empty texts have no words and are clean; items without words or id never match; repeated
    rows and items give repeated results and count once. Other columns are not read. Test sets of
    up to ``max_bytes`` go into one automaton (about 60 bytes of memory a byte); larger ones are refused.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("binary").alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(load_items(items, item_id_col, item_text_col, max_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, ids = build_automaton(sent.value, window)
        for b in batches:
            out: dict[str, list] = {k.split()[0]: [] for k in RESULT.replace("start:int,end", "").split(", ")}
            for cell in b.column(1):
                text = cell.as_py()
                n, hit, found = scan(text, auto)
                who = sorted(ids[i] for i in found)
                out["n_words"].append(n)
                out["n_hit"].append(int(hit.sum()))
                out["n_items"].append(len(who))
                out["items_sha256"].append(hashlib.sha256(",".join(who).encode()).hexdigest())
                out["contaminated"].append(bool(who))
                out["items"].append(who)
                out["spans"].append(spans_of(text, hit) if who else [])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()),
                 pa.array(out["n_items"], pa.int64()), pa.array(out["items_sha256"], pa.string()),
                 pa.array(out["contaminated"], pa.bool_()), pa.array(out["items"], pa.list_(pa.string())),
                 pa.array(out["spans"], span)],
                names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"])

    found = rows.mapInArrow(run, f"id {kind}, {RESULT}")
    return found.withColumnRenamed("id", id_col)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text", window: int = 10, max_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns, by the same scan."""
    sent = docs.sparkSession.sparkContext.broadcast(load_items(items, item_id_col, item_text_col, max_bytes))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, _ = build_automaton(sent.value, window)
        for b in batches:
            text = b.column(at).cast(pa.large_binary())
            yield b.filter(pa.array([not scan(t.as_py(), auto)[2] for t in text], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL = f"""
WITH docs AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, coalesce({_WORDS}, []) AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT item, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
grams AS (
  SELECT r, n, p, array_to_string(ws[p:p + n - 1], ' ') AS w
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n)),
hits AS MATERIALIZED (SELECT r, p, g.n, item FROM grams g JOIN windows x ON g.n = x.n AND g.w = x.w),
hit_words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS who FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(who, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""

"""Alignment of two tokenizers by pointer jumping, with corpus-wide counts of the linked ids.

A text is encoded by a byte-level BPE (A) and by a piece BPE (B); their tokens cover the same bytes. Every
token points to the farthest-right token of the other side that overlaps it; doubling the
pointers of a whole block of texts at once (``next = next[next]``) brings every token to the last token of its
component, which names its group. All A-B pairs of a group are links.

A block of texts holds its own distinct pairs in the order of a bijective hash; slices of that hash
range are counted over all blocks, and every block gets the counts of exactly its own pairs back, so neither a table
of all pairs nor a row per link is ever in one place.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knnhard.llm._common import col, materialise, table

FOLDER = "/opt/tokenizers"
#: fixed value: the pre-tokenisation pattern of byte-level BPE
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ODD = 0x9E3779B97F4A7C15


# ---- tokenizers

def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as itself where it is printable, the others as letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """The two tokenizers, with the bytes of every id. ``a`` and ``b`` encode a text to ids."""

    def __init__(self, byte_file: str, piece_file: str):
        import sentencepiece

        with open(byte_file, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*vocab.values(), *added.values()]) + 1
        self.bytes_a = [b""] * size
        for text, i in vocab.items():
            if text not in added:
                self.bytes_a[i] = bytes(letters[c] for c in text)
        self.a = self._encoder(spec, byte_file, vocab, added)
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self._pieces.is_byte(i) else p.replace("▁", " ").encode()
                        for i in range(self._pieces.vocab_size()) for p in [self._pieces.id_to_piece(i)]]
        self.len_a = np.array([len(t) for t in self.bytes_a])
        self.len_b = np.array([len(t) for t in self.bytes_b])

    def _encoder(self, spec: dict, file: str, vocab: dict[str, int], added: dict[str, int]):
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        plain = (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
                 and not spec.get("normalizer") and not any(spec["model"].get(k) for k in ("dropout", "ignore_merges"))
                 and all(vocab[m] == 256 + i for i, m in enumerate(merges)))
        if plain:  # ids are merge ranks, so the faster library gives the same ids
            import tiktoken

            ranks = {self.bytes_a[i]: i for t, i in vocab.items() if t not in added}
            return tiktoken.Encoding("byte", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        import tokenizers

        made = tokenizers.Tokenizer.from_file(file)
        made.encode_special_tokens = True
        return lambda text: made.encode(text, add_special_tokens=False).ids

    def b(self, text: str) -> list[int]:
        return self._pieces.encode(text)

    def both(self, text: str | None) -> tuple[list[int], list[int]] | None:
        """Ids of a text (A reads a space before it, B adds one), None where there are none or the bytes differ."""
        if not text:
            return None
        a, b, whole = self.a(" " + text), self.b(text), b" " + text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
            return None
        return a, b


@functools.lru_cache(maxsize=2)
def tokenizers_of(byte_file: str, piece_file: str) -> Tokenizers:
    return Tokenizers(byte_file, piece_file)


# ---- alignment

def pointer_groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the tokens of A and of B, from their last byte offsets, by pointer jumping."""
    n = len(end_a)
    to_b = np.searchsorted(end_b, end_a)  # the token of B over the last byte: the farthest right that overlaps
    to_a = np.searchsorted(end_a, end_b)
    stays = end_a[to_a] == end_b
    succ = np.concatenate([n + to_b, np.where(stays, n + np.arange(len(end_b)), to_a)])
    while True:
        jump = succ[succ]
        if np.array_equal(jump, succ):
            break
        succ = jump
    number = np.cumsum(stays) - 1
    return number[succ[:n] - n], number[succ[n:] - n]


def _links(a: np.ndarray, b: np.ndarray, g_a: np.ndarray, g_b: np.ndarray, doc_a: np.ndarray,
           v_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id pair, how often) of all links; a pair may come in several parts."""
    n_b = np.bincount(g_b)
    first_b = np.cumsum(n_b) - n_b
    large = (np.bincount(g_a) * n_b) > 4096
    some = ~large[g_a]
    at = np.nonzero(some)[0]
    n = n_b[g_a[at]]
    left = np.repeat(at, n)
    right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + first_b[g_a[left]]
    doc, pair = doc_a[left], a[left] * v_b + b[right]
    parts = [(doc, pair, np.ones(len(pair), "i8"))]
    for g in np.nonzero(large)[0]:  # a long group: by its distinct ids
        of_a = slice(*np.searchsorted(g_a, [g, g + 1]))
        ids_a, k_a = np.unique(a[of_a], return_counts=True)
        ids_b, k_b = np.unique(b[first_b[g]:first_b[g] + n_b[g]], return_counts=True)
        parts.append((np.full(len(ids_a) * len(ids_b), doc_a[of_a.start]), (ids_a[:, None] * v_b + ids_b).ravel(),
                      (k_a[:, None] * k_b).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _group_texts(a: np.ndarray, b: np.ndarray, g_a: np.ndarray, g_b: np.ndarray, docs: np.ndarray, words: list[bytes],
                 v_a: int, v_b: int) -> Iterator[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of every document; ``docs`` are the numbers of tokens (A and B) of each."""
    cut_a = np.searchsorted(g_a, np.arange(g_a[-1] + 2))
    cut_b = np.searchsorted(g_b, np.arange(g_b[-1] + 2))
    merged = np.empty(len(a) + len(b), "i8")
    n = np.arange(len(a))
    merged[n + cut_b[g_a]] = a + np.where(n + 1 == cut_a[g_a + 1], v_a, 0)
    n = np.arange(len(b))
    merged[n + cut_a[g_b + 1]] = 2 * v_a + b + np.where(n + 1 == cut_b[g_b + 1], v_b, 0)
    lo = 0
    for n_tokens in docs:
        yield b"".join(map(words.__getitem__, merged[lo:lo + n_tokens].tolist()))[:-1]
        lo += n_tokens


# ---- packed whole numbers

def pack(x: np.ndarray) -> bytes:
    """Whole numbers of 0 or more, byte plane by byte plane, compressed."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view("u1").reshape(-1, 8)[:, :width].T).tobytes()
    head = len(x).to_bytes(8, "little") + bytes([width])
    return head + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    planes = np.frombuffer(pa.Codec("zstd").decompress(data[9:], n * width, asbytes=True), "u1").reshape(width, n)
    out = np.zeros((n, 8), "u1")
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype("i8")


class PairHash:
    """Bijection of the id pairs to ``bits`` bits, whose upper part spreads them over slices."""

    def __init__(self, v_a: int, v_b: int, slices: int):
        self.v_b, self.slices = v_b, slices
        self.bits = max(1, (v_a * v_b - 1).bit_length())
        self.mask = (1 << self.bits) - 1
        self.odd = _ODD & self.mask | 1
        self.back = pow(self.odd, -1, 1 << self.bits)

    def _times(self, x: np.ndarray, k: int) -> np.ndarray:
        return ((x.astype("u8") * np.uint64(k)) & np.uint64(self.mask)).astype("i8")

    def scramble(self, pair: np.ndarray) -> np.ndarray:
        return self._times(pair, self.odd)

    def id_a(self, h: np.ndarray) -> np.ndarray:
        return self._times(h, self.back) // self.v_b

    def slice_of(self, h: np.ndarray) -> np.ndarray:
        return (h.astype("f8") * (self.slices / (1 << self.bits))).astype("i8").clip(0, self.slices - 1)


# ---- the job

def _block(tok: Tokenizers, words: list[bytes], hash_: PairHash, block: int, ids: pa.Array, encoded: list,
           keep_groups: bool) -> tuple[dict[str, Any], list[dict[str, Any]]]:
    v_a, v_b = len(tok.bytes_a), len(tok.bytes_b)
    held = np.array([e is not None for e in encoded])
    n_a = np.array([len(e[0]) if e else 0 for e in encoded], "i8")
    n_b = np.array([len(e[1]) if e else 0 for e in encoded], "i8")
    n_groups, n_links, entries = (np.zeros(len(encoded), "i8") for _ in range(3))
    digest, groups = [""] * len(encoded), [None] * len(encoded)
    keys = index = times = df = np.zeros(0, "i8")
    if held.any():
        a = np.concatenate([e[0] for e in encoded if e])
        b = np.concatenate([e[1] for e in encoded if e])
        g_a, g_b = pointer_groups(np.cumsum(tok.len_a[a]), np.cumsum(tok.len_b[b]))
        doc_a = np.repeat(np.arange(len(encoded)), n_a)
        first = np.searchsorted(g_a, np.arange(g_a[-1] + 1))
        n_groups = np.bincount(doc_a[first], minlength=len(encoded))
        np.add.at(n_links, doc_a[first], np.bincount(g_a) * np.bincount(g_b))
        doc, pair, n = _links(a, b, g_a, g_b, doc_a, v_b)
        both = (doc << hash_.bits) | hash_.scramble(pair)
        if (n == 1).all():
            both.sort()
            cut = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            both, times = both[cut], np.diff(np.append(cut, len(n)))
        else:
            both, at = np.unique(both, return_inverse=True)
            times = np.zeros(len(both), "i8")
            np.add.at(times, at, n)
        owner = both >> hash_.bits
        keys, index = np.unique(both & hash_.mask, return_inverse=True)
        df = np.bincount(index)
        entries = np.bincount(owner, minlength=len(encoded))
        index = np.where(np.concatenate([[True], owner[1:] != owner[:-1]]), index, np.diff(index, prepend=0))
        texts = _group_texts(a, b, g_a, g_b, (n_a + n_b)[held], words, v_a, v_b)
        for d, text in zip(np.nonzero(held)[0], texts):
            digest[d] = hashlib.sha256(text).hexdigest()
            groups[d] = text.decode() if keep_groups else None
    row = {"block": block, "id": ids, "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "digest": digest,
           "groups": groups, "entries": entries, "keys": pack(keys), "index": pack(index), "times": pack(times)}
    of = hash_.slice_of(keys)
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else []
    chunks = [{"block": block, "slice": int(of[s]), "keys": pack(np.diff(keys[s:e], prepend=0)), "df": pack(df[s:e])}
              for s, e in zip(cuts, np.append(cuts, len(of))[1:].astype(int))]
    return row, chunks


_FIELDS = "n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, digest array<string>, groups array<string>, " \
          "entries array<long>, keys binary, index binary, times binary, slice long, df binary"


def _encode(byte_file: str, piece_file: str, slices: int, block_bytes: int, keep_groups: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = tokenizers_of(byte_file, piece_file)
        words = [b"%d%s" % (i, end) for n, ends in ((len(tok.bytes_a), b",|"), (len(tok.bytes_b), b",;"))
                 for end in (ends[:1], ends[1:]) for i in range(n)]
        hash_ = PairHash(len(tok.bytes_a), len(tok.bytes_b), slices)
        block = TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        held, size, kind = [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block, ids, held, size
            row, chunks = _block(tok, words, hash_, block, pa.concat_arrays(ids), held, keep_groups)
            block, ids, held, size = block + 1, [], [], 0
            rows = [row, *chunks]
            types = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "digest": pa.string(),
                     "groups": pa.string(), "entries": pa.int64()}
            cols = [pa.array([r["block"] for r in rows], pa.int64()),
                    _lists([row["id"]] + [None] * len(chunks), kind)]
            cols += [_lists([pa.array(row[k], t)] + [None] * len(chunks), t) for k, t in types.items()]
            cols += [pa.array([r.get(k) for r in rows], t) for k, t in
                     (("keys", pa.binary()), ("index", pa.binary()), ("times", pa.binary()), ("slice", pa.int64()), ("df", pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "id", *types, "keys", "index", "times", "slice", "df"])

        for batch in batches:
            kind = batch.column(0).type
            for r in range(batch.num_rows):
                text = batch.column(1)[r].as_py()
                both = tok.both(text)
                held.append(both and tuple(np.array(x, "i8") for x in both))
                ids.append(batch.column(0).slice(r, 1))
                size += len(text or "") + 64
                if size >= block_bytes:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _lists(parts: list, kind: pa.DataType) -> pa.Array:
    """One list per part, None for none."""
    ends = np.cumsum([0, *(0 if p is None else len(p) for p in parts)])
    values = pa.concat_arrays([p for p in parts if p is not None] or [pa.array([], kind)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([p is None for p in parts]))


def _count(hash_args: tuple[int, int, int]):
    def run(chunks: pa.Table) -> pa.Table:
        """Counts of one slice of the pairs over all blocks, handed back to each block; the highest one of every A id."""
        hash_ = PairHash(*hash_args)
        keys = [np.cumsum(unpack(k.as_py())) for k in chunks.column("keys")]
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.zeros(len(every), "i8")
        np.add.at(n, at, np.concatenate([unpack(d.as_py()) for d in chunks.column("df")]))
        cuts = np.cumsum([0, *map(len, keys)])
        back = [pack(n[at[s:e]]) for s, e in zip(cuts, cuts[1:])]
        a = hash_.id_a(every)
        order = np.argsort(a, kind="stable")
        ids, first = np.unique(a[order], return_index=True)
        most = np.maximum.reduceat(n[order], first)
        return pa.table({"block": pa.array([*chunks.column("block").to_pylist(), None], pa.int64()),
                         "slice": pa.array([*chunks.column("slice").to_pylist(), None], pa.int64()),
                         "n": pa.array([*back, pack(most)], pa.binary()),
                         "a": pa.array([None] * len(back) + [pack(ids)], pa.binary())})

    return run


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for a, n in zip(b.column("a"), b.column("n")):
            yield pa.RecordBatch.from_arrays([pa.array(unpack(a.as_py())), pa.array(unpack(n.as_py()))], names=["a", "n"])


def _finish(hash_args: tuple[int, int, int], top: Any):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_ = PairHash(*hash_args)
        for b in batches:
            for r in range(b.num_rows):
                get = lambda name: b.column(name)[r].values  # noqa: B023, E731
                parts = sorted(b.column("parts")[r].as_py() or [], key=lambda p: p["slice"])
                n = np.concatenate([np.zeros(0, "i8"), *(unpack(p["n"]) for p in parts)])
                entries = get("entries").to_numpy()
                keys, step, times = (unpack(b.column(k)[r].as_py()) for k in ("keys", "index", "times"))
                cuts = np.concatenate([[0], np.cumsum(entries)])
                # steps restart with every document
                run_ = np.cumsum(step)
                base = np.concatenate([[0], run_])[cuts[:-1]]
                index = run_ - np.repeat(base, entries)
                best = n == top.value[hash_.id_a(keys)] if len(keys) else np.zeros(0, bool)
                sums = [np.concatenate([[0], np.cumsum(times * x[index])]) for x in (n, best.astype("i8"))]
                count_sum, n_best = (s[cuts[1:]] - s[cuts[:-1]] for s in sums)
                yield pa.RecordBatch.from_arrays(
                    [get("id"), get("n_a"), get("n_b"), get("n_groups"), get("n_links"), pa.array(n_best), pa.array(count_sum),
                     get("digest"), get("groups")],
                    names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"])

    return run


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_file: str = f"{FOLDER}/byte_bpe_50k.json",
                     piece_file: str = f"{FOLDER}/piece_bpe_32k.model", keep_groups: bool = True, block_bytes: int = 4_000_000,
                     slice_bytes: int = 16_000_000) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups.

    Groups end where a token of both sides ends; links are all A-B token occurrence pairs of a group. A pair of ids
    counts the rows of ``docs`` that hold it linked; n_best are the links whose count is the highest of
    their A id (ties included), count_sum adds the counts of all links. ``groups`` is ``a1,a2|b1;a3|b2,b3``; with
    ``keep_groups`` false it is null and only its digest is kept. Texts that are null or empty, or whose
    tokens do not give the text back, have zeros, and '' for the digest. Rows are rows: repeated ones
    count again, ids are handed through. An empty table gives an empty result; other columns are not read.

    A task holds the tokens of one block of texts (``block_bytes``, or one longer text). The highest count of
    every A id, one number per entry of A's vocabulary, is the only thing that goes to all tasks.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-size // slice_bytes))
    kind = rows.schema["id"].dataType.simpleString()
    blocks = materialise(rows.mapInArrow(_encode(byte_file, piece_file, slices, block_bytes, keep_groups),
                                         f"block long, id array<{kind}>, {_FIELDS}"), "align-blocks")
    tok = tokenizers_of(byte_file, piece_file)
    hash_args = len(tok.bytes_a), len(tok.bytes_b), slices
    chunks = blocks.where("slice is not null").select("block", "slice", "keys", "df")
    counts = materialise(chunks.groupBy("slice").applyInArrow(_count(hash_args), "block long, slice long, n binary, a binary"),
                         "align-counts")
    top = np.zeros(len(tok.bytes_a), "i8")
    most = counts.where("a is not null").select("a", "n").mapInArrow(_tops, "a long, n long").groupBy("a").agg(F.max("n").alias("n"))
    for r in materialise(most, "align-tops").toLocalIterator():  # at most one row per entry of A's vocabulary
        top[r["a"]] = r["n"]
    shared = spark.sparkContext.broadcast(top)
    back = counts.where("a is null").groupBy("block").agg(F.collect_list(F.struct("slice", "n")).alias("parts"))
    joined = blocks.where("slice is null").drop("slice", "df").join(back, "block", "left")
    return joined.mapInArrow(_finish(hash_args, shared), f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                             "count_sum long, groups_sha256 string, groups string").withColumnRenamed("id", id_col)


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents``: tokens, groups and links of every text, with the digest of its groups."""
    return align_tokenizers(table(spark, sf_dir, "documents"), keep_groups=False).drop("groups")

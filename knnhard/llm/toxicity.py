"""Counterfactual-regularised toxicity classifier.

A labelled text that names a group is paired with the same text naming another group of the same kind; the
fit penalises the squared change of the score between the two, so that what a text says and not
whom it names decides. A part of the texts without a group name is paired after adding one, so
that the names are held in check even where the labelled rows hardly have any.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knnhard.llm import textmodel
from knnhard.llm._common import crc_mod, table

#: Group names by kind; a name is swapped within its kind.
IDENTITY_TERMS = {
    "gender": ("women", "men", "woman", "man", "girls", "boys", "female", "male", "transgender"),
    "belief": ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslim", "christian", "jewish"),
    "origin": ("african", "asian", "european", "american", "mexican", "arab", "indian", "immigrants", "refugees"),
    "colour": ("black", "white", "brown"),
    "love": ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual"),
    "body": ("disabled", "blind", "deaf", "autistic"),
    "age": ("old", "young", "elderly", "teenage"),
}


def _word_features(words: set[bytes]) -> set[bytes]:
    out = set(words)
    for k in textmodel.BEGINNINGS:
        out.update(w[:k] + b"*" for w in words if len(w) > k)
    return out


def counterfactuals(text: str | None, terms: dict[str, tuple[str, ...]], added_every: int = 4) -> list[list[bytes]]:
    """Feature lists, two for each pair: the text, and the text with one kind's names swapped."""
    words = set(textmodel.words(text))
    pick = zlib.crc32((text or "").encode("utf-8", "replace"))
    out: list[list[bytes]] = []
    for kind in sorted(terms):
        names = [n.encode() for n in terms[kind]]
        present = [n for n in names if n in words]
        if present:
            turn = 1 + pick % (len(names) - 1)
            other = {names[(names.index(n) + turn) % len(names)] for n in present}
            out += [sorted(_word_features(words)), sorted(_word_features(words - set(present) | other))]
    if not out and pick % added_every == 0:
        names = [n.encode() for n in terms[sorted(terms)[pick // added_every % len(terms)]]]
        a = pick // 64 % len(names)
        b = (a + 1 + pick // 4096 % (len(names) - 1)) % len(names)
        out = [sorted(_word_features(words | {names[a]})), sorted(_word_features(words | {names[b]}))]
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = 4000,
          pair_weight: float = 5.0, terms: dict[str, tuple[str, ...]] = IDENTITY_TERMS) -> textmodel.TextModel:
    """Fit from ``labels`` (id, y in 0/1) on at most ``per_class`` rows of each class (the documented bound)."""
    names = tuple(n.encode() for group in terms.values() for n in group)
    return textmodel.train(docs, labels, id_col, text_col, with_style=False, per_class=per_class, l2=1e-3, forced=names,
                           balance=1.0, make_pairs=lambda t: counterfactuals(t, terms), pair_weight=pair_weight)


def score(docs: DataFrame, model: textmodel.TextModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score (0 to 1), predicted (1 if score >= 0.5).

    Null and empty texts are scored by the constant alone; repeated rows give repeated results; an
    empty table gives an empty result; if there were no labels every score is 0, if all
    labels agree it is that label. Other columns are not read.
    """
    got = textmodel.score_table(docs, model, id_col, text_col)
    s = F.lit(0.0)
    if "1" in model.classes:
        s = F.element_at("p", model.classes.index("1") + 1)
    return got.select(F.col("id").alias(id_col), s.alias("score"), F.when(s >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labelled rows whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0).select(
        F.col("doc_id").alias("id"), F.col("toxic").alias("y"))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, train(docs, labels)).select("doc_id", held.alias("held_out"), "score", "predicted")

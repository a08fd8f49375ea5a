"""Multi-party perspective rotation of dialogues (DataFrame functions only).

Every speaker of a dialogue is the assistant of one rendering of it; the other speakers are users that
carry their names, and only the assistant's words are in the loss mask. A dialogue of any length
is rendered in parts of a bounded span of turns: the parts of one rendering, in order, are the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knnhard.llm._common import col, materialise, table


@dataclass(frozen=True)
class Template:
    """A message is start + role + between + content + end; a named user's role is ``named`` with the
    name in the place of {name}."""

    start: str = "<|im_start|>"
    between: str = "\n"
    end: str = "<|im_end|>\n"
    assistant: str = "assistant"
    system: str = "system"
    named: str = "user name={name}"


def _header(t: Template, speaker: Column, me: Column, system: Column) -> Column:
    before, _, after = t.named.partition("{name}")
    # a name is one word without the template's own signs
    name = F.regexp_replace(speaker, r"[^\p{L}\p{N}_.-]+", "_")
    role = F.when(system, F.lit(t.system)).when(speaker == me, F.lit(t.assistant)).otherwise(F.concat(F.lit(before), name, F.lit(after)))
    return F.concat(F.lit(t.start), role, F.lit(t.between))


def _sizes(msgs: str) -> Column:
    """Per speaker of a part: whether a system speaker, messages and characters."""
    def of(who: Column) -> Column:
        own = F.filter(msgs, lambda m: m["who"] == who)
        chars = F.aggregate(own, F.lit(0).cast("long"), lambda acc, m: acc + F.length(m["words"]))
        return F.struct(who.alias("who"), own[0]["system"].alias("system"), F.size(own).alias("n"), chars.alias("chars"))

    return F.transform(F.array_distinct(F.transform(msgs, lambda m: m["who"])), of)


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text",
           system_speakers: tuple[str, ...] = ("system",), span: int = 64, template: Template = Template()) -> DataFrame:
    """One row per dialogue, participant and part: conv_id, perspective, part, n_messages, text, mask, char_start.

    ``mask`` holds the (start, end) character offsets in ``text`` of the participant's own words with their
    closing sign; ``char_start`` is where the part begins in the whole rendering. Messages stand in the order of
    (turn, speaker, text). A part holds ``span`` consecutive turn numbers, so a dialogue that has a third of
    all rows is spread over tasks. Speakers in ``system_speakers`` take no perspective.

    Rows that repeat dialogue, turn, speaker and text are one message. A null speaker is the participant
    ``unknown``; a null text is empty; a null dialogue id is a dialogue of its own; messages without turn come
    first, in parts by a digest of their words. A dialogue of system messages alone gives no
    rows, nor does an empty table; other columns are not read.
    """
    t = template
    base = turns.select(
        col(conv_col).alias("conv"), col(turn_col).alias("turn"), F.coalesce(col(speaker_col).cast("string"), F.lit("unknown")).alias("who"),
        F.coalesce(col(text_col).cast("string"), F.lit("")).alias("words"))
    adrift = F.pmod(F.xxhash64("who", "words"), F.lit(1024)) - F.lit(1 << 40)
    base = base.withColumn("part", F.coalesce(F.floor(F.col("turn") / span).cast("long"), adrift)).withColumn(
        "system", F.col("who").isin(*system_speakers) if system_speakers else F.lit(False))
    # the words travel once, by dialogue and part
    told = materialise(base.groupBy("conv", "part").agg(
        F.sort_array(F.collect_set(F.struct("turn", "who", "words", "system"))).alias("msgs")), "told")

    # where each part begins: from sizes by speaker, without the words
    parts = told.select("conv", "part", _sizes("msgs").alias("by"))
    people = (parts.select("conv", F.explode("by").alias("x")).where("NOT x.system").groupBy(F.col("conv").alias("of"))
              .agg(F.sort_array(F.collect_set("x.who")).alias("people")))
    seen = parts.join(people, F.col("conv").eqNullSafe(F.col("of"))).select("conv", "part", "by", F.explode("people").alias("me"))
    length = F.aggregate("by", F.lit(0).cast("long"), lambda acc, x: acc + x["chars"] + x["n"] * (
        len(t.end) + F.length(_header(t, x["who"], F.col("me"), x["system"]))))
    order = Window.partitionBy("conv", "me").orderBy("part")
    before = F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = seen.select("conv", "part", "me", length.alias("len")).select(
        F.col("conv").alias("of"), F.col("part").alias("at"), "me", F.coalesce(before, F.lit(0)).alias("char_start"),
        (F.row_number().over(order) - 1).alias("nth"))

    both = told.join(placed, F.col("conv").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    shown = F.transform("msgs", lambda m: F.struct(
        _header(t, m["who"], F.col("me"), m["system"]).alias("head"), F.concat(m["words"], F.lit(t.end)).alias("body"),
        ((m["who"] == F.col("me")) & ~m["system"]).alias("own")))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")

    def add(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["head"])
        end = start + F.length(m["body"])
        own = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(m["own"], F.array_append(acc["mask"], own)).otherwise(acc["mask"]).alias("mask"))

    mask = F.aggregate("shown", F.struct(F.lit(0).cast("long").alias("at"), none.alias("mask")), add, lambda acc: acc["mask"])
    return both.withColumn("shown", shown).select(
        F.col("conv").alias(conv_col), F.col("me").alias("perspective"), F.col("nth").alias("part"), F.size("msgs").alias("n_messages"),
        F.array_join(F.transform("shown", lambda m: F.concat(m["head"], m["body"])), "").alias("text"), mask.alias("mask"), "char_start")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every perspective of ``conversations``; the mask as text, ``start-end`` joined by commas."""
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return rotate(table(spark, sf_dir, "conversations")).withColumn("mask", spans)


SQL = r"""
WITH m AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS who, coalesce(text, '') AS words FROM conversations),
people AS (SELECT DISTINCT conv_id, who AS me FROM m WHERE who <> 'system'),
r AS (SELECT m.*, me, CAST(floor(turn / 64) AS BIGINT) AS p, '<|im_start|>' || CASE WHEN who = 'system' THEN 'system' WHEN who = me THEN 'assistant'
        ELSE 'user name=' || regexp_replace(who, '[^\pL\pN_.-]+', '_', 'g') END || chr(10) AS head, words || '<|im_end|>' || chr(10) AS body
      FROM m JOIN people USING (conv_id)),
s AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, me, p ORDER BY turn, who, words
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM r),
g AS (SELECT conv_id, me, p, count(*) AS n, string_agg(head || body, '' ORDER BY turn, who, words) AS text,
        coalesce(string_agg(CASE WHEN who = me THEN CAST(pos + length(head) AS VARCHAR) || '-' || CAST(pos + length(head) + length(body) AS VARCHAR) END,
                            ',' ORDER BY turn, who, words), '') AS mask, sum(length(head) + length(body)) AS size
      FROM s GROUP BY conv_id, me, p)
SELECT conv_id, me AS perspective, CAST(row_number() OVER (PARTITION BY conv_id, me ORDER BY p) - 1 AS INTEGER) AS part,
       CAST(n AS INTEGER) AS n_messages, text, mask,
       CAST(coalesce(sum(size) OVER (PARTITION BY conv_id, me ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start
FROM g
"""

"""Conversation repair: the cheapest edits, found by depth-first branch-and-bound.

A conversation's rows, by turn, become one that opens with at most one system row and then alternates
user and assistant rows, ending on an assistant row (or is empty). Edits: keep (0), give the
row the role user or assistant (1), delete (2; the only edit of blank and repeated rows), insert an
empty user or assistant row (5); a truncated row that stays costs 5 more. Of all cheapest edits the one
whose initials (D, I, K, R in row order) come first in ASCII order is taken.

The rows are sorted over the cluster and cut into segments of bounded length. In each segment the
search goes from every state of the pattern to every other one: an explicit stack, a lower bound of
every suffix (the pattern without its end), the incumbent, and for each (row, state) the
cheapest prefix so far, which eliminates the others. A first search ordered by bounds proves the
cost, a second one in ASCII order with that cost as incumbent meets the least audit first. Segments
are then chained by their 4 x 4 costs and the order of their audits, so a conversation of any
length is never in one task as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knnhard.llm._common import attach, col, crc_mod, materialise, table

#: rows of a segment: 2 to this power
_SEGMENT_BITS = 12
_COST = {"K": 0, "R": 1, "D": 2, "I": 5}
_TRUNCATED = 5
#: states of the pattern: nothing yet, after system, after user, after assistant
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = {_START: "u", _SYSTEM: "u", _USER: "a", _ASSISTANT: "u"}
_AFTER = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}
_NEVER = 1 << 30

Row = tuple[str, int]  # initial of the role (s, u, a or anything else); 0 sound, 1 must go, 2 truncated


def _children(row: Row | None, state: int) -> list[tuple[str, int, int, int]]:
    """(edit, cost, rows taken, state after) of every edit that the pattern allows, in ASCII order of the edits."""
    want = _NEXT[state]
    out = []
    if row is not None:
        out.append(("D", _COST["D"], 1, state))
    out.append(("I", _COST["I"], 0, _AFTER[want]))
    if row is not None and row[1] != 1:
        more = _TRUNCATED if row[1] == 2 else 0
        if row[0] == want or row[0] == "s" and state == _START:
            out.append(("K", more, 1, _AFTER[row[0]]))
        if row[0] != want:
            out.append(("R", _COST["R"] + more, 1, _AFTER[want]))
    return out


def suffix_bounds(rows: list[Row]) -> list[list[int]]:
    """For every row and state the cost of the rest at least, when the pattern may end anywhere."""
    out = [[0, 0, 0, 0]]
    for row in reversed(rows):
        below = out[-1]
        out.append([min(cost + below[after] for _, cost, taken, after in _children(row, s) if taken) for s in range(4)])
    return out[::-1]


def _search(rows: list[Row], bounds: list[list[int]], entry: int, leave: int, most: int, ascii_order: bool) -> tuple[int, str] | None:
    """Cheapest edits from ``entry`` to ``leave`` under cost ``most``, by depth-first branch-and-bound.

    With ``ascii_order`` edits are tried in that order and the first whole solution ends the search; prefixes are then met in
    ASCII order, so an equal cost met later is a larger audit. Otherwise the most promising edit is tried
    first and the search ends when no open prefix can beat the incumbent.
    """
    n = len(rows)
    cheapest: dict[tuple[int, int], int] = {}
    incumbent, audit = most, None
    stack = [(0, entry, 0, None)]
    while stack:
        at, state, cost, trail = stack.pop()
        if cost + bounds[at][state] >= incumbent or cheapest.get((at, state), _NEVER) <= cost:
            continue
        cheapest[at, state] = cost
        if at == n and state == leave:
            incumbent, audit = cost, trail
            if ascii_order:
                break
            continue
        new = []
        for edit, price, taken, after in _children(rows[at] if at < n else None, state):
            total = cost + price + bounds[at + taken][after]
            if total < incumbent:
                new.append((total, edit, (at + taken, after, cost + price, (trail, edit))))
        if not ascii_order:
            new.sort(key=lambda c: c[0])
        stack.extend(c[2] for c in reversed(new))
    if audit is None and not (incumbent < most):
        return None
    edits = []
    while audit is not None:
        audit, edit = audit
        edits.append(edit)
    return incumbent, "".join(reversed(edits))


def cheapest_edits(rows: list[Row], entry: int, leave: int, bounds: list[list[int]] | None = None) -> tuple[int, str] | None:
    """(cost, ASCII-least audit) of the cheapest edits of ``rows`` from state ``entry`` to ``leave``; None if there are none."""
    if leave == _START and entry != _START or leave == _SYSTEM and entry not in (_START, _SYSTEM):
        return None
    if leave == _SYSTEM and entry == _START and not any(r == "s" and f != 1 for r, f in rows):
        return None
    bounds = bounds or suffix_bounds(rows)
    proved = _search(rows, bounds, entry, leave, _NEVER, False)
    return proved and _search(rows, bounds, entry, leave, proved[0] + 1, True)


def replay(rows: list[Row], audit: str, state: int) -> list[tuple[str, str, str]]:
    """(inserted initials before the row, its edit, its initial afterwards) of every row; the last one's insertions
    after it follow its edit as ``edit + initials``."""
    out, before = [], ""
    it = iter(rows)
    for edit in audit:
        if edit == "I":
            before += _NEXT[state]
            state = _AFTER[_NEXT[state]]
            continue
        row = next(it)
        initial = "" if edit == "D" else row[0] if edit == "K" else _NEXT[state]
        out.append((before, edit, initial))
        before = ""
        state = _AFTER.get(initial, state)
    if before:
        out[-1] = (out[-1][0], out[-1][1] + before, out[-1][2])
    return out


_TABLE = ("costs array<int>, audits array<string>, ranks array<int>, illegal long, first string, last string")


def _rows(syms: list[dict]) -> list[Row]:
    return [(s["initial"], s["fault"]) for s in syms]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 4 x 4 table of every segment; only states that the conversation can enter and leave it by."""
    for b in batches:
        out = []
        for r in b.to_pylist():
            rows = _rows(r.pop("rows"))
            bounds = suffix_bounds(rows)
            entries = {_START} if r.pop("is_first") else {0, 1, 2, 3}
            leaves = {_START, _ASSISTANT} if r.pop("is_last") else {0, 1, 2, 3}
            found = [cheapest_edits(rows, e, x, bounds) if e in entries and x in leaves else None for e in range(4) for x in range(4)]
            order = {a: i for i, a in enumerate(sorted({f[1] for f in found if f}))}
            illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
            out.append(r | {"costs": [f[0] if f else None for f in found], "audits": [f[1] if f else None for f in found],
                            "ranks": [order[f[1]] if f else None for f in found], "illegal": illegal,
                            "first": rows[0][0], "last": rows[-1][0]})
        yield _batch(out, {"conv": pa.string(), "seg": pa.int64(), "costs": pa.list_(pa.int32()), "audits": pa.list_(pa.string()),
                           "ranks": pa.list_(pa.int32()), "illegal": pa.int64(), "first": pa.string(), "last": pa.string()})


def _batch(rows: list[dict], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in fields.items()], names=list(fields))


def chain(segments: list[dict]) -> tuple[int, list[tuple[int, int]]]:
    """(cost, (entry, leave) of every segment) of the cheapest, then ASCII-least way through all segments."""
    best = {_START: (0, 0)}  # state -> (cost, rank of the audit so far)
    back = []
    for s in segments:
        ways: dict[int, tuple[int, int, int, int]] = {}
        for e, (cost, rank) in best.items():
            for x in range(4):
                if s["costs"][4 * e + x] is not None:
                    way = (cost + s["costs"][4 * e + x], rank, s["ranks"][4 * e + x], e)
                    ways[x] = min(ways.get(x, way), way)
        order = {k: i for i, k in enumerate(sorted({w[1:3] for w in ways.values()}))}
        best = {x: (w[0], order[w[1:3]]) for x, w in ways.items()}
        back.append({x: w[3] for x, w in ways.items()})
    cost, _, state = min((*best[x], x) for x in (_START, _ASSISTANT) if x in best)
    path = []
    for step in reversed(back):
        path.append((step[state], state))
        state = step[state]
    return cost, path[::-1]


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            parts = r["parts"]
            cost, path = chain(parts)
            illegal = sum(p["illegal"] for p in parts) + sum(
                a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))
            out.append({"conv": r["conv"], "cost": cost, "illegal": illegal, "seg": [p["seg"] for p in parts],
                        "way": [4 * e + x for e, x in path]})
        yield _batch(out, {"conv": pa.string(), "cost": pa.int64(), "illegal": pa.int64(), "seg": pa.list_(pa.int64()),
                           "way": pa.list_(pa.int32())})


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for r in b.to_pylist():
            for s, (before, edit, initial) in zip(r["rows"], replay(_rows(r["rows"]), r["audit"], r["entry"])):
                out.append({"pos": s["pos"], "before": before, "edit": edit[0], "initial": initial, "after": edit[1:]})
        yield _batch(out, {"pos": pa.int64(), "before": pa.string(), "edit": pa.string(), "initial": pa.string(), "after": pa.string()})


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every conversation's lines, read as a sorted stream: one line at a time is held."""
    now, sha = None, None
    for b in batches:
        done = []
        for conv, line in zip(b.column("conv"), b.column("line")):
            conv, line = conv.as_py(), line.as_py()
            if conv != now:
                if sha is not None:
                    done.append((now, sha.hexdigest()))
                now, sha = conv, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(line.encode())
        yield _batch([{"conv": c, "sha": h} for c, h in done], {"conv": pa.string(), "sha": pa.string()})
    if sha is not None:
        yield _batch([{"conv": now, "sha": sha.hexdigest()}], {"conv": pa.string(), "sha": pa.string()})


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row per conversation, one row per repaired row).

    The first: conv, gaps, blank, duplicate, truncated, illegal, cost (longs), audit. The second: conv,
    place (ascending), role, text, edit (K, R or I). Null roles and texts count as one space. Rows go by turn (nulls first), of equal turns
    by role and digest of the row. Each row's first fault counts: blank (nothing but white space), duplicate
    (role and text seen earlier in the conversation), truncated (the last visible character is none of ``.!?``). An
    empty role, or one whose initial is not s, u or a, cannot be kept. Rows of a null conversation id are one
    conversation. An empty table gives empty results; other columns are not read.
    """
    c = F.when(col(conv_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), col(conv_col).cast("string")))
    rows = conversations.select(
        c.alias("conv"), col(turn_col).alias("turn"), F.coalesce(col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(col(text_col).cast("string"), F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("digest", F.sha2(F.concat_ws("\n", F.length("conv"), F.length("role"), "conv", "role", "text"), 256))
    order = ["conv", "turn", "role", "digest", "row"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    seen = F.expr(r"rtrim(' \t\n\u000b\f\r', text)")
    rows = materialise(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row")
        .select("*", F.monotonically_increasing_id().alias("pos"), (seen == "").alias("blank"),
                (~F.right(seen, F.lit(1)).isin(".", "!", "?")).alias("cut")), "repair-rows")
    again = rows.groupBy("digest").agg(F.min("pos").alias("begin"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = attach(rows.select("digest", "pos"), "digest", again, F.col("pos")).where("pos > begin").select("pos")
    marked = rows.select("conv", "turn", "pos", "blank", "cut", F.substring("role", 1, 1).alias("initial")) \
        .join(again.withColumn("again", F.lit(True)), "pos", "left") \
        .withColumn("duplicate", ~F.col("blank") & F.coalesce("again", F.lit(False))) \
        .withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("cut"))
    marked = materialise(marked.drop("again", "cut"), "repair-marked")
    one = lambda flag: F.sum(F.col(flag).cast("long")).alias(flag)
    faults = marked.groupBy("conv").agg(one("blank"), one("duplicate"), one("truncated"),
                                        F.min("pos").alias("from"), F.max("pos").alias("to"))
    turns = marked.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(
        F.coalesce(F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    segment = F.shiftright("pos", _SEGMENT_BITS)
    fault = F.when(F.col("blank") | F.col("duplicate"), 1).when(F.col("truncated"), 2).otherwise(0)
    cut = marked.groupBy("conv", segment.alias("seg")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "initial", fault.alias("fault")))).alias("rows"))
    cut = cut.join(faults.select("conv", "from", "to"), "conv").select(
        "conv", "seg", "rows", (F.shiftright("from", _SEGMENT_BITS) == F.col("seg")).alias("is_first"),
        (F.shiftright("to", _SEGMENT_BITS) == F.col("seg")).alias("is_last"))
    cut = materialise(cut, "repair-segments")
    solved = materialise(cut.mapInArrow(_solve, "conv string, seg long, " + _TABLE), "repair-solved")
    chained = solved.groupBy("conv").agg(F.sort_array(F.collect_list(
        F.struct("seg", "costs", "ranks", "illegal", "first", "last"))).alias("parts"))
    chained = materialise(chained.mapInArrow(_chain, "conv string, cost long, illegal long, seg array<long>, way array<int>"),
                          "repair-chained")
    ways = chained.select("conv", F.explode(F.arrays_zip("seg", "way")).alias("w")).select("conv", "w.seg", "w.way")
    chosen = solved.select("conv", "seg", "audits").join(ways, ["conv", "seg"]).select(
        "conv", "seg", F.expr("audits[way]").alias("audit"), F.floor(F.col("way") / 4).cast("int").alias("entry"))
    audits = chosen.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("seg", "audit"))).alias("a")).select(
        "conv", F.array_join(F.expr("transform(a, x -> x.audit)"), "").alias("audit"))
    report = (faults.drop("from", "to").join(turns, "conv", "left").join(chained.select("conv", "cost", "illegal"), "conv")
              .join(audits, "conv"))
    report = report.select("conv", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated",
                           "illegal", "cost", "audit")
    edits = cut.select("conv", "seg", "rows").join(chosen, ["conv", "seg"]).mapInArrow(
        _replay, "pos long, before string, edit string, initial string, after string")
    whole = {"u": "user", "a": "assistant", "s": "system"}
    named = F.create_map(*[F.lit(x) for kv in whole.items() for x in kv])

    def added(initials: str, place: int):
        return F.expr(f"transform(split({initials}, ''), (x, i) -> named_struct('at', {place}, 'i', i, 'initial', x, 'edit', 'I'))")

    new = rows.select("conv", "pos", "role", "text").join(edits, "pos")
    new = new.select("conv", "pos", "role", "text", F.explode(F.filter(F.concat(
        added("before", 0), F.array(F.struct(F.lit(1).alias("at"), F.lit(0).alias("i"), "initial", "edit")), added("after", 2)),
        lambda e: e["initial"] != "")).alias("e"))
    new = new.select(
        "conv", F.struct("pos", "e.at", "e.i").alias("place"),
        F.when(F.col("e.edit") == "K", F.col("role")).otherwise(named[F.col("e.initial")]).alias("role"),
        F.when(F.col("e.edit") == "I", F.lit("")).otherwise(F.col("text")).alias("text"), F.col("e.edit").alias("edit"))
    return report, new


def damage(conversations: DataFrame) -> DataFrame:
    """Damaged rows by crc32(conv_id:turn) % 20: 0 dropped, 1 text emptied, 2 without its ``.!?``, 3 twice, 4 role user."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), crc_mod(key, 20).alias("how")).where("how <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("how") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("how") == 1, F.lit("")).when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of the lines ``role:text`` of every conversation that keeps a row.

    SHA-256 reads its input in order, so the lines of a conversation pass one task, as a sorted stream.
    """
    lines = repaired.select("conv", "place", F.concat_ws(":", "role", "text").alias("line"))
    lines = lines.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "line")
    return lines.mapInArrow(_hash, "conv string, sha string").toDF("conv", "repaired_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` after damage: faults, cheapest edits and digest of the repaired rows, for every original conversation."""
    before = table(spark, sf_dir, "conversations")
    report, repaired = repair(damage(before))
    every = before.select("conv_id").distinct().withColumn(
        "conv", F.when(F.col("conv_id").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string"))))
    out = every.join(report, "conv", "left").join(digests(repaired), "conv", "left")
    zero = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: One state of the pattern is one text "cost, audit, repaired lines": equal costs are told apart by the audit. Insertions
#: are left out: in place of one, deleting a neighbouring row is always cheaper.
SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda ch: ascii(ch)::UBIGINT)),
                lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda i: i::UBIGINT)),
                                           lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT) % 20 AS how
  FROM base),
damaged AS (
  SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE how <> 0),
keyed AS (
  SELECT *, coalesce('+' || conv_id::VARCHAR, '-') AS conv, rtrim(text, E' \t\n\x0b\f\r') AS seen FROM damaged),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role,
      sha256(length(conv)::VARCHAR || E'\n' || length(role)::VARCHAR || E'\n' || conv || E'\n' || role || E'\n' || text)) AS n
  FROM keyed),
faulty AS (
  SELECT conv, turn, role, text, n, left(role, 1) AS r, seen = '' AS blank,
         seen <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 AS duplicate,
         right(seen, 1) NOT IN ('.', '!', '?') AS cut,
         lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY n) AS before
  FROM placed),
judged AS (
  SELECT *, NOT blank AND NOT duplicate AND cut AS truncated, blank OR duplicate AS gone,
         CASE WHEN NOT blank AND NOT duplicate AND cut THEN 5 ELSE 0 END AS more
  FROM faulty),
walk(conv, n, z, s, u, a) AS (
  SELECT conv, 0::BIGINT, '000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM (SELECT DISTINCT conv FROM judged)
  UNION ALL
  SELECT w.conv, j.n,
    step(w.z, 2, 'D', NULL),
    least(step(w.s, 2, 'D', NULL), CASE WHEN j.r = 's' AND NOT j.gone THEN step(w.z, j.more, 'K', j.role || ':' || j.text) END),
    least(step(w.u, 2, 'D', NULL), CASE WHEN NOT j.gone THEN least(
      CASE WHEN j.r = 'u' THEN step(w.z, j.more, 'K', j.role || ':' || j.text) ELSE step(w.z, 1 + j.more, 'R', 'user:' || j.text) END,
      CASE WHEN j.r = 'u' THEN step(w.s, j.more, 'K', j.role || ':' || j.text) ELSE step(w.s, 1 + j.more, 'R', 'user:' || j.text) END,
      CASE WHEN j.r = 'u' THEN step(w.a, j.more, 'K', j.role || ':' || j.text) ELSE step(w.a, 1 + j.more, 'R', 'user:' || j.text) END) END),
    least(step(w.a, 2, 'D', NULL), CASE WHEN NOT j.gone THEN
      CASE WHEN j.r = 'a' THEN step(w.u, j.more, 'K', j.role || ':' || j.text) ELSE step(w.u, 1 + j.more, 'R', 'assistant:' || j.text) END END)
  FROM walk w JOIN judged j ON j.conv = w.conv AND j.n = w.n + 1),
ended AS (
  SELECT conv, n, least(z, a) AS best FROM walk w
  WHERE n = (SELECT max(n) FROM judged j WHERE j.conv = w.conv)),
report AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(left(best, 6)::BIGINT, 0) AS cost, coalesce(substr(best, 7, n), '') AS audit,
       sha256(coalesce(substr(best, 7 + n + 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN report r ON r.conv = coalesce('+' || o.conv_id::VARCHAR, '-')
LEFT JOIN ended e ON e.conv = r.conv
"""


def _step(m_state: str, price: str, edit: str, line: str) -> str:
    """A state's text after one more edit of a row."""
    text = f"lpad((left({m_state}, 6)::BIGINT + {price})::VARCHAR, 6, '0') || substr({m_state}, 7, w.n) || '{edit}' || substr({m_state}, 7 + w.n)"
    return f"({text})" if line == "NULL" else f"({text} || E'\\n' || {line})"


def _expand(sql: str) -> str:
    """``step(state, price, edit, line)`` written out: DuckDB's macros are statements of their own."""
    while "step(" in sql:
        at = sql.index("step(")
        depth, args, begin = 0, [], at + 5
        for i in range(at + 5, len(sql)):
            if sql[i] == "(":
                depth += 1
            elif sql[i] == ")" and depth == 0:
                args.append(sql[begin:i].strip())
                break
            elif sql[i] == ")":
                depth -= 1
            elif sql[i] == "," and depth == 0:
                args.append(sql[begin:i].strip())
                begin = i + 1
        state, price, edit, line = args
        sql = sql[:at] + _step(state, price, edit.strip("'"), line) + sql[i + 1:]
    return sql


SQL = _expand(SQL)

"""Operator 4: chat formatting by a finite-state machine over roles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class ChatTemplate:
    """states: {(state, role): next state}; accept: states in which a conversation
    may end. parts: {role: [(text, loss flag)]}, in which "{text}" stands for the
    message. first, last: segments around the conversation."""

    start: str = "start"
    states: dict = field(
        default_factory=lambda: {
            ("start", "system"): "ready",
            ("start", "user"): "asked",
            ("ready", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accept: tuple = ("answered",)
    parts: dict = field(
        default_factory=lambda: {
            "system": [("<|system|>\n", False), ("{text}", False), ("<|end|>\n", False)],
            "user": [("<|user|>\n", False), ("{text}", False), ("<|end|>\n", False)],
            "assistant": [("<|assistant|>\n", False), ("{text}", True), ("<|end|>\n", True)],
        }
    )
    first: tuple = (("<|begin|>\n", False),)
    last: tuple = (("<|finish|>", False),)


def format_chats(df: DataFrame, template: ChatTemplate | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Validate the order of turns and emit text segments with loss flags.

    Messages of a conversation are taken by turn number, ties by role and text. The
    machine starts in template.start, and each role leads from one state to the
    next; a missing transition, a null or unknown role, a null conversation or turn
    number, or an end outside template.accept makes the conversation invalid.

    Returns (conv_id, segment, turn, segment_text, loss, status). A valid
    conversation has status "ok" and a row for each segment: those of `first`, the
    parts of each message in order, those of `last`; segments of `first` and `last`
    have a null turn. An invalid one has a single row with segment -1, a null text,
    loss false, the turn it failed at (null at its end) and the reason as status. A
    null text counts as empty; an empty text gives an empty segment. Repeated rows
    are further turns, so they usually fail. An empty table gives no rows; other
    columns are not read. A conversation is held in one row, whole.
    """
    t = template or ChatTemplate()
    step = F.create_map(*[F.lit(x) for (s, r), to in t.states.items() for x in (f"{s}\x00{r}", to)])
    rows = df.select(F.col(conv).alias("c"), F.struct(F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("m"))
    chats = rows.groupBy("c").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    # the machine runs over the roles: (state, number of turns passed, reason)
    begin = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("bad"))

    def move(s, m):
        to = F.try_element_at(step, F.concat(s["state"], F.lit("\x00"), m["role"]))
        bad = F.when(m["turn"].isNull(), F.lit("null turn")).when(m["role"].isNull(), F.lit("null role")).when(to.isNull(), F.concat(F.lit("unexpected "), m["role"], F.lit(" when "), s["state"]))
        return F.when(s["bad"].isNotNull(), s).otherwise(F.struct(F.coalesce(to, s["state"]).alias("state"), (s["n"] + F.when(bad.isNull(), 1).otherwise(0)).alias("n"), bad.alias("bad")))

    chats = chats.withColumn("end", F.aggregate("ms", begin, move))
    accepted = F.col("end.state").isin(*t.accept)
    status = F.when(F.col("c").isNull(), F.lit("null conversation")).when(F.col("end.bad").isNotNull(), F.col("end.bad")).when(~accepted, F.concat(F.lit("ends when "), F.col("end.state"))).otherwise(F.lit("ok"))
    chats = chats.withColumn("status", status)

    def piece(part, m=None):
        body, loss = part
        at = F.lit(None).cast("long") if m is None else m["turn"]
        if m is None or "{text}" not in body:
            return F.struct(at.alias("turn"), F.lit(body).alias("segment_text"), F.lit(loss).alias("loss"))
        a, b = body.split("{text}", 1)
        return F.struct(at.alias("turn"), F.concat(F.lit(a), m["text"], F.lit(b)).alias("segment_text"), F.lit(loss).alias("loss"))

    def spread(m):
        expr = None
        for r, parts in t.parts.items():
            made = F.array(*[piece(p, m) for p in parts])
            expr = F.when(m["role"] == r, made) if expr is None else expr.when(m["role"] == r, made)
        return F.coalesce(expr, F.array().cast("array<struct<turn:bigint,segment_text:string,loss:boolean>>"))

    whole = F.concat(*[F.array(piece(p)) for p in t.first], F.flatten(F.transform("ms", spread)), *[F.array(piece(p)) for p in t.last])
    good = chats.where("status = 'ok'").select("c", F.posexplode(whole).alias("segment", "s"), "status")
    good = good.select(F.col("c").alias("conv_id"), "segment", "s.turn", "s.segment_text", "s.loss", "status")
    failed_at = F.when(F.col("end.bad").isNotNull(), F.get("ms", F.col("end.n"))["turn"])
    bad = chats.where("status <> 'ok'").select(F.col("c").alias("conv_id"), F.lit(-1).alias("segment"), failed_at.alias("turn"), F.lit(None).cast("string").alias("segment_text"), F.lit(False).alias("loss"), "status")
    return good.union(bad)


def op4_chat_format(spark, sf_dir):
    return format_chats(table(spark, sf_dir, "conversations"))


SQL = r"""
WITH m AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text,
         row_number() OVER w AS k, lag(role) OVER w AS prev, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text)),
s AS (
  SELECT *, CASE WHEN k = 1 THEN 'start' WHEN prev = 'system' THEN 'ready' WHEN prev = 'user' THEN 'asked' ELSE 'answered' END AS state FROM m),
b AS (
  SELECT *, CASE WHEN turn IS NULL THEN 'null turn' WHEN role IS NULL THEN 'null role'
    WHEN (state, role) NOT IN (('start', 'system'), ('start', 'user'), ('ready', 'user'), ('asked', 'assistant'), ('answered', 'user'))
    THEN 'unexpected ' || role || ' when ' || state END AS bad FROM s),
c AS (
  SELECT conv_id, min(k) FILTER (bad IS NOT NULL) AS bad_k, arg_min(bad, k) FILTER (bad IS NOT NULL) AS bad,
         arg_min(turn, k) FILTER (bad IS NOT NULL) AS bad_turn, arg_max(role, k) AS last_role, max(k) AS n FROM b GROUP BY conv_id),
d AS (
  SELECT *, CASE WHEN conv_id IS NULL THEN 'null conversation' WHEN bad IS NOT NULL THEN bad WHEN last_role = 'assistant' THEN 'ok'
    ELSE 'ends when ' || CASE last_role WHEN 'user' THEN 'asked' ELSE 'ready' END END AS status FROM c),
p AS (SELECT * FROM (VALUES (0), (1), (2)) v(j))
SELECT conv_id, CAST(-1 AS INTEGER) AS segment, bad_turn AS turn, CAST(NULL AS VARCHAR) AS segment_text, false AS loss, status FROM d WHERE status <> 'ok'
UNION ALL SELECT conv_id, 0, NULL, '<|begin|>' || chr(10), false, 'ok' FROM d WHERE status = 'ok'
UNION ALL SELECT conv_id, CAST(3 * n + 1 AS INTEGER), NULL, '<|finish|>', false, 'ok' FROM d WHERE status = 'ok'
UNION ALL SELECT m.conv_id, CAST(3 * (k - 1) + 1 + j AS INTEGER), m.turn,
  CASE j WHEN 0 THEN '<|' || role || '|>' || chr(10) WHEN 1 THEN text ELSE '<|end|>' || chr(10) END,
  role = 'assistant' AND j > 0, 'ok'
FROM m JOIN d ON m.conv_id = d.conv_id CROSS JOIN p WHERE status = 'ok'
"""

"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names, per role, how its turns open and whether their text is
trained on; every turn ends with the same closing string.  The output is a list
of text segments with a loss flag each, and the formatted text (the segments
joined).  Inside a text the control strings are escaped, so the formatted text
can be read back without loss.

Defined cases: rows are ordered by turn, then role, then text (nulls first);
repeated rows are repeated turns; a null text or role is empty; rows of a null
``conv_id`` form one conversation; roles that the template doesn't name open
with their own escaped name and carry no loss; a conversation that the state
machine rejects is formatted all the same, with ``valid`` false and ``n_read``
the number of turns accepted before the first wrong one; an empty table gives
an empty table.

Scale: one shuffle by conversation.  A formatted conversation is one record by
definition, so its turns are gathered into one row; nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

TEMPLATE = {
    "turns": {
        "system": {"open": "### System: ", "loss": False},
        "user": {"open": "### User: ", "loss": False},
        "assistant": {"open": "### Assistant: ", "loss": True},
    },
    "other": {"before": "### =", "after": ": "},
    "close": "</turn>\n",
    # control string -> what stands for it inside a text; the escape sign itself comes first
    "escapes": {"\\": "\\b", "###": "\\h", "</turn>": "\\t"},
    "role_escapes": {":": "\\c"},
    # state -> roles it accepts; the state after a turn is its role
    "machine": {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "accepting": ["assistant"],
}


def escape(text: Column, escapes: dict[str, str]) -> Column:
    """After this every escape sign is followed by the letter of what it stands for, so
    replacing in the opposite order restores the text."""
    for raw, mark in escapes.items():
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text


def unescape(text: Column, escapes: dict[str, str]) -> Column:
    for raw, mark in reversed(list(escapes.items())):
        text = F.replace(text, F.lit(mark), F.lit(raw))
    return text


def _choose(cases: list[tuple[Column, Column]], other: Column) -> Column:
    out = None
    for when, then in cases:
        out = F.when(when, then) if out is None else out.when(when, then)
    return other if out is None else out.otherwise(other)


def _state(turns: Column, machine: dict[str, list[str]]) -> Column:
    """Last state of the machine and the number of turns it accepted."""
    def step(acc: Column, turn: Column) -> Column:
        ok = F.lit(False)
        for state, roles in machine.items():
            ok = ok | ((acc.state == state) & turn.role.isin(roles))
        go = ok & (acc.state != "error")
        return F.struct(F.when(go, turn.role).otherwise(F.lit("error")).alias("state"),
                        (acc.n_read + go.cast("bigint")).alias("n_read"))

    return F.aggregate(turns, F.struct(F.lit("start").alias("state"), F.lit(0).cast("bigint").alias("n_read")), step)


def format_chats(rows: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, n_read, segments
    (array of text and loss) and formatted."""
    roles, other = template["turns"], template["other"]

    def opening(role: Column) -> Column:
        named = F.concat(F.lit(other["before"]), escape(role, template["escapes"] | template["role_escapes"]),
                         F.lit(other["after"]))
        return _choose([(role == r, F.lit(x["open"])) for r, x in roles.items()], named)

    def segments(turn: Column) -> Column:
        loss = turn.role.isin([r for r, x in roles.items() if x["loss"]])
        return F.array(F.struct(opening(turn.role).alias("text"), F.lit(False).alias("loss")),
                       F.struct(escape(turn.text, template["escapes"]).alias("text"), loss.alias("loss")),
                       F.struct(F.lit(template["close"]).alias("text"), F.lit(False).alias("loss")))

    turns = (rows.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                                             F.coalesce("text", F.lit("")).alias("text")).alias("t"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))
    made = turns.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                        _state(F.col("turns"), template["machine"]).alias("s"),
                        F.flatten(F.transform("turns", segments)).alias("segments"))
    return made.select("conv_id", "n_turns", F.col("s.state").isin(template["accepting"]).alias("valid"),
                       F.col("s.n_read").alias("n_read"), "segments",
                       F.array_join(F.transform("segments", lambda x: x.text), "").alias("formatted"))


def read_back(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns (array of role and text) of a formatted conversation."""
    roles, other = template["turns"], template["other"]
    close = "\\Q" + template["close"] + "\\E"
    parts = F.split(formatted, close)
    parts = F.slice(parts, 1, F.size(parts) - 1)          # nothing follows the last closing string

    def turn(part: Column) -> Column:
        head = F.split(part, "\\Q" + other["after"] + "\\E", 2)
        role = _choose([(F.startswith(part, F.lit(x["open"])), F.lit(r)) for r, x in roles.items()],
                       unescape(F.substring(head[0], len(other["before"]) + 1, 2**31 - 1),
                                template["escapes"] | template["role_escapes"]))
        text = _choose([(F.startswith(part, F.lit(x["open"])), F.substring(part, len(x["open"]) + 1, 2**31 - 1))
                        for x in roles.values()], head[1])
        return F.struct(role.alias("role"), unescape(text, template["escapes"]).alias("text"))

    return F.transform(parts, turn)


def loss_text(segments: Column, template: dict = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss),
                                    lambda s: unescape(s.text, template["escapes"])), "")


PROBE = "\\### Assistant: </turn> ok"


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted, read back and digested."""
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(PROBE).alias("text"))
    rows = C.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    made = format_chats(rows).withColumn("turns", read_back(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return (made.withColumn("loss_text", loss_text(F.col("segments")))
            .select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                    F.sha2(told, 256).alias("turns_sha256"),
                    F.length("loss_text").cast("bigint").alias("loss_chars"),
                    F.sha2("loss_text", 256).alias("loss_sha256"),
                    F.length("formatted").cast("bigint").alias("formatted_chars"),
                    "valid", "n_read"))


# Written apart from the operator: the plain statement of what a row must hold.
OP6_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15
      ELSE 7 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c')) END
    + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) + 8 AS chars
  FROM rows),
judged AS (
  SELECT *, NOT coalesce(CASE WHEN pos = 1 THEN role IN ('system', 'user')
    WHEN role = 'user' THEN before IN ('system', 'assistant')
    WHEN role = 'assistant' THEN before = 'user' ELSE false END, false) AS wrong
  FROM marked)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(NOT wrong) AND arg_max(role, pos) = 'assistant' AS valid,
  coalesce(min(pos) FILTER (wrong) - 1, count(*))::BIGINT AS n_read
FROM judged GROUP BY conv_id
"""

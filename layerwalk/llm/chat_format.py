"""Operator 5: chat formatting by event-sourced reconstruction. DataFrame functions only.

A log holds events of conversations: (conv_id, seq, msg, kind, role, text). Sorted by ``seq`` they fold into messages:

- ``message`` starts or restarts message ``msg`` with a text; null or unknown kinds count as ``message``;
- ``delta`` appends its text to message ``msg``;
- ``edit`` replaces the text of message ``msg``; later deltas append to that;
- ``regenerate`` empties message ``msg`` (its deltas follow) and withdraws every message first seen between the
  message's own first event and the regeneration.

Messages stand in the order of their first events. The fold of a message needs only its own events, so the events of
a long conversation are dealt over many tasks until its messages are rendered; one row then holds the conversation.

The template writes a turn as ``<s>[role]text[/role]</s>``. In roles and texts ``&``, ``<``, ``[`` and ``]`` become
character references, so that no control string can appear in a text, and unescaping in reverse order gives back every
text. The loss mask covers the texts of assistant turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

#: Each escaped string and its replacement, in the order of escaping.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("]", "&#93;"))
LEARNT = "assistant"


def escape(text: Column) -> Column:
    for a, b in ESCAPES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for a, b in reversed(ESCAPES):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, ord, role, text) of the final messages.

    Null texts are empty, a null ``msg`` makes a message of its own of the event's ``seq``. Ties of ``seq`` are broken
    by kind, role and text; an event repeated under one ``msg`` counts as often as it is there. The role is that of
    the last event that has one, else null. Rows without conv_id form a conversation of their own. Other columns are
    ignored; no rows give no rows.
    """
    e = events.select(
        "conv_id", "seq", "msg", F.when(F.col("msg").isNull(), F.col("seq")).alias("own"),
        F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"),
    )
    m = e.groupBy("conv_id", "msg", "own").agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("ev"))
    m = m.select(
        "conv_id", F.col("ev")[0]["seq"].alias("first"), "ev",
        F.expr("coalesce(array_max(transform(ev, (x, i) -> if(x.kind <> 'delta', i, null))), 0)").alias("reset"),
        F.expr("array_max(transform(ev, x -> if(x.kind = 'regenerate', x.seq, null)))").alias("redo"),
    )
    m = m.select(
        "conv_id", "first", "redo",
        F.expr("try_element_at(filter(transform(ev, x -> x.role), r -> r is not null), -1)").alias("role"),
        F.expr("array_join(transform(filter(ev, (x, i) -> i >= reset and x.kind <> 'regenerate'), x -> x.text), '')").alias("text"),
    )
    before = W.partitionBy("conv_id").orderBy("first").rangeBetween(W.unboundedPreceding, -1)
    m = m.withColumn("until", F.max("redo").over(before)).filter("until is null or until <= first")
    return m.select("conv_id", F.col("first").alias("ord"), "role", "text")


def log_of_turns(turns: DataFrame) -> DataFrame:
    """The event log of a table of finished turns: one ``message`` event a row, also where turns repeat."""
    nth = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy("role", "text"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("seq"), F.struct("turn", nth.alias("nth")).alias("msg"), F.lit("message").alias("kind"), "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of each conversation: the text, and the (lo, hi) of what is learnt, in code points.

    A null role is written as an empty one; messages of one ``ord`` stand by role and text.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.col("text"))
    part = messages.select(
        "conv_id", "ord", (F.coalesce("role", F.lit("")) == LEARNT).alias("learnt"),
        F.concat(F.lit("<s>["), role, F.lit("]")).alias("head"), text.alias("body"), F.concat(F.lit("[/"), role, F.lit("]</s>")).alias("tail"),
    )
    part = part.withColumn("a", F.length("head")).withColumn("b", F.length("body"))
    whole = F.col("a") + F.col("b") + F.length("tail")
    before = W.partitionBy("conv_id").orderBy("ord", "head", "body").rowsBetween(W.unboundedPreceding, -1)
    part = part.withColumn("lo", F.coalesce(F.sum(whole).over(before), F.lit(0)).cast("int") + F.col("a"))
    turn = F.struct("ord", "head", "body", "tail", "learnt", "lo", (F.col("lo") + F.col("b")).alias("hi"))
    conv = part.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return conv.select(
        "conv_id", F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["learnt"]), lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"))).alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, learnt): (role, text) of each turn parsed from ``formatted``, and the text under each loss span, all unescaped."""
    turn = F.transform(F.filter(F.split("formatted", "</s>"), lambda x: x != ""), lambda x: F.struct(x.alias("x"), F.instr(x, "]").alias("p")))
    role = lambda x: unescape(F.substring(x["x"], F.lit(5), x["p"] - 5))
    text = lambda x: unescape(F.substring(x["x"], x["p"] + 1, F.length(x["x"]) - 2 * x["p"] + 2))
    back = rendered.select("conv_id", "formatted", "loss_spans", turn.alias("turn"))
    return back.select(
        "conv_id", "formatted", F.transform("turn", lambda x: F.struct(role(x).alias("role"), text(x).alias("text"))).alias("turns"),
        F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["lo"] + 1, s["hi"] - s["lo"]))).alias("learnt"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    back = read_back(render(fold_events(log_of_turns(turns))))
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("learnt", "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), ']', '&#93;')"
QUERIES = {"op5_chat_format": op5_chat_format}
ORACLE_SQL = {
    "op5_chat_format": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(12 + 2 * length({_ESC.format("role")}) + length({_ESC.format("text")}))::BIGINT AS formatted_chars
  FROM t GROUP BY conv_id
)
SELECT conv_id::BIGINT AS conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
}

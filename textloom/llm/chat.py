"""Chat formatting with Spark expressions only: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import col

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _runs(turns: Column) -> Column:
    """Where runs of one role begin: 1-based places, in order."""
    places = F.sequence(F.lit(1), F.size(turns))
    return F.filter(places, lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, i - 2)["role"]))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns int, n_messages int, roles, chat): a row for each conversation.

    chat is <|im_start|>role, newline, text, <|im_end|>, newline for each message, in the order of turn; a
    message is a run of turns of one role, joined by newlines. roles names the messages' roles, by commas.

    Nulls: a null role is "user"; a null text is empty, and its turn still counts; null turns come first. A
    turn of null conv_id belongs to no other: it is a conversation by itself. Turns of equal number go by
    role, then text; repeated rows are repeated turns. A marker inside a text or role gets a space after its
    "<", so that no text can forge one; nothing else is changed. An empty table gives no rows. Long texts
    are kept whole. Other columns aren't read.
    """

    def plain(c: Column) -> Column:
        for marker in (OPEN, CLOSE):
            c = F.replace(c, F.lit(marker), F.lit("< " + marker[1:]))
        return c

    one = F.struct(col(turn_col).cast("long").alias("turn"), plain(F.coalesce(col(role_col).cast("string"), F.lit("user"))).alias("role"), plain(F.coalesce(col(text_col).cast("string"), F.lit(""))).alias("text"))
    conv = col(conv_col).alias("conv_id")
    grouped = turns.where(col(conv_col).isNotNull()).groupBy(conv).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    alone = turns.where(col(conv_col).isNull()).select(conv, F.array(one).alias("turns"))
    grouped = grouped.unionByName(alone).withColumn("begins", _runs(F.col("turns")))
    begins, n = F.col("begins"), F.size("turns")
    # Each run is a slice, so that a conversation of n turns takes n steps, not n * n.
    message = F.transform(begins, lambda b, i: F.struct(F.get(F.col("turns"), b - 1)["role"].alias("role"), F.array_join(F.transform(F.slice("turns", b, F.coalesce(F.get(begins, i + 1), n + 1) - b), lambda t: t["text"]), "\n").alias("text")))
    rows = grouped.select("conv_id", n.alias("n_turns"), message.alias("messages"))
    chat = F.array_join(F.transform("messages", lambda m: F.concat(F.lit(OPEN), m["role"], F.lit("\n"), m["text"], F.lit(CLOSE), F.lit("\n"))), "")
    return rows.select("conv_id", "n_turns", F.size("messages").alias("n_messages"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), chat.alias("chat"))


_PLAIN = "replace(replace({}, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>')"
CHAT_SQL = f"""
WITH t AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS own, turn, {_PLAIN.format("coalesce(role, 'user')")} AS role, {_PLAIN.format("coalesce(text, '')")} AS text FROM conversations),
a AS (SELECT *, row_number() OVER w AS rn, CASE WHEN role = lag(role) OVER w THEN 0 ELSE 1 END AS begins FROM t WINDOW w AS (PARTITION BY conv_id, own ORDER BY turn NULLS FIRST, role, text)),
b AS (SELECT *, sum(begins) OVER (PARTITION BY conv_id, own ORDER BY rn) AS msg FROM a),
m AS (SELECT conv_id, own, msg, min(role) AS role, count(*) AS n, string_agg(text, chr(10) ORDER BY rn) AS text FROM b GROUP BY conv_id, own, msg)
SELECT conv_id, CAST(sum(n) AS INTEGER) AS n_turns, CAST(count(*) AS INTEGER) AS n_messages, string_agg(role, ',' ORDER BY msg) AS roles,
 string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY msg) AS chat
FROM m GROUP BY conv_id, own
"""

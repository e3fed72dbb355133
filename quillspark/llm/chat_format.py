"""Chat formatting after collapsing cumulative snapshots of conversations.

Logs often hold one conversation several times, each copy a prefix of a longer one. A rolling hash
over (position, role, text) identifies every prefix of every conversation; equal conversations are
counted as one, and those whose whole hash is a proper prefix of another are removed by an anti-join.
What is left, the maximal conversations, is rendered. DataFrame functions only.

Prefix hashes are window sums, so a conversation is never collected to be hashed; both sides of the
anti-join are aggregated to one row per hash first, so a common first turn or a conversation logged a
million times brings each task one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The text around a turn: before the role, between role and text, after the text.
MARKS = ("<|im_start|>", "\n", "<|im_end|>\n")


def _key(n: str) -> list[Column]:
    return [F.col(n), F.col("_s1"), F.col("_s2")]


def rolled(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (_conv, _pos, _n, _role, _text, _s1, _s2): each turn once, with its position, its conversation's length and the hashes of the prefix up to it.

    Turns are ordered by turn (null first), role and text; a turn repeated with equal role and text counts once.
    """
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col(text), F.lit("")).alias("_text")
    )
    order = Window.partitionBy("_conv").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text")
    last = lambda c: F.lag(c).over(order)
    again = (F.lag(F.lit(1)).over(order) == 1) & last("_turn").eqNullSafe(F.col("_turn")) & (last("_role") == F.col("_role")) & (last("_text") == F.col("_text"))
    once = rows.withColumn("_again", F.coalesce(again, F.lit(False))).where("not _again")
    placed = once.withColumn("_pos", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_conv")))
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), "_pos", "_role", "_text").cast("decimal(38,0)")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_s1", total(1)).withColumn("_s2", total(2)).drop("_turn", "_again")


def maximal(turns: DataFrame) -> DataFrame:
    """Rows (_conv, _copies) of the conversations in rolled() turns that prefix no longer one; the smallest id stands for equal ones."""
    whole = turns.where("_pos = _n").groupBy(*_key("_n")).agg(F.min("_conv").alias("_conv"), F.count("*").alias("_copies"))
    proper = turns.where("_pos < _n").select(*_key("_pos")).distinct().toDF("_n", "_s1", "_s2")
    return whole.join(proper, ["_n", "_s1", "_s2"], "left_anti").select("_conv", "_copies")


def format_chats(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv, n_turns, n_copies, n_reply_chars, text), one for each maximal conversation.

    n_copies counts equal conversations; n_reply_chars the characters of assistant turns. Null role or text count as
    empty; rows with a null conversation id belong to none and are left out. An empty table gives no rows. Other
    columns are not read. A conversation becomes one row, as long as its turns, however many and long they are.
    """
    turns = rolled(conversations, conv, turn, role, text)
    kept = turns.join(maximal(turns).withColumnRenamed("_conv", "_kept"), F.col("_conv") == F.col("_kept"))
    begin, middle, end = map(F.lit, MARKS)
    shown = F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_role", "_text"))), lambda t: F.concat(begin, t["_role"], middle, t["_text"], end))
    reply = F.when(F.col("_role") == "assistant", F.length("_text")).otherwise(0)
    out = kept.groupBy("_conv").agg(F.first("_n").alias("n_turns"), F.first("_copies").alias("n_copies"), F.sum(reply).cast("long").alias("n_reply_chars"), F.array_join(shown, "").alias("_shown"))
    return out.select(F.col("_conv").alias(conv), F.col("n_turns").cast("long").alias("n_turns"), "n_copies", "n_reply_chars", F.col("_shown").alias("text"))


ORACLE_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM t GROUP BY conv_id),
d AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns)
SELECT d.conv_id, CAST(len(d.turns) AS BIGINT) AS n_turns, d.n_copies,
  CAST(list_sum(list_transform(d.turns, lambda x: CASE WHEN x.role = 'assistant' THEN length(x.text) ELSE 0 END)) AS BIGINT) AS n_reply_chars,
  array_to_string(list_transform(d.turns, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS text
FROM d WHERE NOT EXISTS (SELECT 1 FROM d AS e WHERE len(e.turns) > len(d.turns) AND e.turns[1:len(d.turns)] = d.turns)
"""

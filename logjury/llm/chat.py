"""Operator 2: chat formatting by rotating the perspective over all parties.

For every participant of a dialogue the dialogue is rendered once with that speaker as the
assistant and all others as named users; system turns stay system turns. Loss masks cover what the
assistant says and its end mark. Dialogues are rendered in parts of at most ``PART`` turns, so the
one dialogue that holds a third of all turns is many rows; its places are found by a sort over
ranges of (dialogue, turn), and the parts are dealt by dialogue and part. Built-in expressions only.

Result: ``(conv_id, perspective, part, n_turns, text, n_chars, masks)``; masks are pairs of the
first character and the one behind the last, counted in the part's text.

Defined cases: a null role speaks as ``unknown``; a null text is empty; null dialogues form one
dialogue; turns with equal numbers follow by role and text, null numbers come first; repeated rows
are turns of their own; a dialogue of system turns only has no participant and no row; control
marks inside a text are broken up by a space, so a text cannot end a turn; an empty table gives an
empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logjury.llm.shared import table, with_position

PART = 256
SALTS = 64
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _rendered(turn: Column, perspective: Column) -> Column:
    """``(head, body)``: the body is what a mask may cover."""
    role = turn["role"]
    is_own = role == perspective
    speaker = (
        F.when(is_own, F.lit("assistant"))
        .when(role == SYSTEM, F.lit(SYSTEM))
        .otherwise(F.concat(F.lit("user name="), role))
    )
    return F.struct(
        F.concat(F.lit(OPEN), speaker, F.lit("\n")).alias("head"),
        F.concat(turn["text"], F.lit(CLOSE)).alias("body"),
        is_own.alias("own"),
    )


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART) -> DataFrame:
    said = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|im_"), F.lit("< |im_")).alias("text"),
    )
    placed = with_position(said, "conv_id", "turn", "role", "text")
    # What a dialogue is known by goes to its turns by a salt of their places, so one dialogue is many tasks.
    salted = placed.withColumn("salt", F.pmod("_position", F.lit(SALTS)).cast("int"))
    role_of_party = F.when(F.col("role") != SYSTEM, F.col("role"))
    shares = salted.groupBy("conv_id", "salt").agg(F.min("_position").alias("first"), F.collect_set(role_of_party).alias("own"))
    dialogues = shares.groupBy(F.col("conv_id").alias("of")).agg(
        F.min("first").alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("speakers"),
        F.collect_list("salt").alias("salts"),
    )
    dialogues = dialogues.select("of", "first", "speakers", F.explode("salts").alias("part_of"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part_of"))
    numbered = salted.join(dialogues, same).select(
        "conv_id", "speakers", "role", "text", "_position",
        F.floor((F.col("_position") - F.col("first")) / part).alias("part"),
    )
    parts = (
        numbered.repartition("conv_id", "part")
        .groupBy("conv_id", "part")
        .agg(
            F.first("speakers").alias("speakers"),
            F.array_sort(F.collect_list(F.struct("_position", "role", "text"))).alias("turns"),
        )
    )
    views = parts.select("conv_id", "part", "turns", F.explode("speakers").alias("perspective"))
    lines = views.withColumn("lines", F.transform("turns", lambda t: _rendered(t, F.col("perspective"))))
    lengths = lambda x: F.length(x["head"]) + F.length(x["body"]) + 1
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first: int, stop: int>>").alias("masks"))
    walked = F.aggregate(
        "lines",
        start,
        lambda acc, x: F.struct(
            (acc["at"] + lengths(x)).alias("at"),
            F.when(
                x["own"],
                F.concat(
                    acc["masks"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.length(x["head"])).alias("first"), (acc["at"] + lengths(x) - 1).alias("stop")
                        )
                    ),
                ),
            )
            .otherwise(acc["masks"])
            .alias("masks"),
        ),
    )
    return lines.select(
        "conv_id",
        "perspective",
        F.col("part").cast("long").alias("part"),
        F.size("turns").cast("long").alias("n_turns"),
        F.concat_ws("", F.transform("lines", lambda x: F.concat(x["head"], x["body"], F.lit("\n")))).alias("text"),
        walked["masks"].alias("masks"),
    ).withColumn("n_chars", F.length("text").cast("long"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks are told as their number, their characters, and the text they cover, so SQL can follow."""
    rotated = rotate(table(spark, sf_dir, "conversations"))
    covered = F.concat_ws(
        "", F.transform("masks", lambda m: F.substring(F.col("text"), m["first"] + 1, m["stop"] - m["first"]))
    )
    return rotated.select(
        "conv_id", "perspective", "part", "n_turns", "text", "n_chars",
        F.size("masks").cast("long").alias("n_masks"), covered.alias("masked_text"),
    )


OP2_SQL = f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|im_', '< |im_') AS text FROM conversations
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM said
), speakers AS (
  SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'
), rendered AS (
  SELECT n.conv_id, s.perspective, n.place // {PART} AS part, n.place, n.role = s.perspective AS own,
    '<|im_start|>' || CASE WHEN n.role = s.perspective THEN 'assistant' WHEN n.role = 'system' THEN 'system'
      ELSE 'user name=' || n.role END || chr(10) || n.text || '<|im_end|>' || chr(10) AS line,
    n.text || '<|im_end|>' AS body
  FROM numbered n JOIN speakers s ON n.conv_id IS NOT DISTINCT FROM s.conv_id
)
SELECT conv_id, perspective, part::BIGINT AS part, count(*) AS n_turns,
  string_agg(line, '' ORDER BY place) AS text, sum(length(line))::BIGINT AS n_chars,
  count(*) FILTER (WHERE own) AS n_masks, coalesce(string_agg(body, '' ORDER BY place) FILTER (WHERE own), '') AS masked_text
FROM rendered GROUP BY conv_id, perspective, part
"""

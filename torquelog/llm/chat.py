"""Preference formatting: the shared start of two conversations once, then both ways on.

All steps are on turns, never on whole conversations, so a conversation may have any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>"
PART = ["pair_id", "none", "turn", "place"]


def rendered(role: Column, text: Column) -> Column:
    """One turn in the template; control marks inside a text are broken up."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), plain, F.lit(END + "\n"))


def placed(turns: DataFrame) -> DataFrame:
    """Distinct turns with their place among those of the same pair and turn number.

    Null turn numbers come last. Equal numbers are put in order by role and text, nulls first.
    """
    rows = turns.select("pair_id", "turn", "role", "text").distinct()
    same = Window.partitionBy("pair_id", "turn").orderBy("role", "text")
    return rows.select(
        "pair_id",
        F.col("turn").isNull().alias("none"),
        F.coalesce("turn", F.lit(0)).cast("long").alias("turn"),
        F.row_number().over(same).alias("place"),
        "role",
        "text",
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, trained: str = "assistant") -> DataFrame:
    """Turns of the prompt and of both completions, rendered, for every pair.

    Takes (pair_id, turn, role, text) on both sides. The prompt is the longest run of equal turns
    from the start; it is emitted once. Every turn after it is emitted as ``chosen`` or ``rejected``.
    ``mask_start`` and ``mask_end`` bound the code points of ``rendered`` that count for the loss: the
    text and the end mark of the assistant's turns in the completions, nothing elsewhere. Repeated
    turns count once. A pair with one side has no prompt; equal sides have no completion; rows
    without a pair id are no pair's and are left out. Other columns are not read.
    """
    sides = [placed(side.where("pair_id is not null")) for side in (chosen, rejected)]
    both = sides[0].withColumn("side", F.lit("chosen")).unionByName(
        sides[1].withColumn("side", F.lit("rejected"))
    )
    digest = F.sha2(F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}), 256)
    compared = (
        both.withColumn("digest", digest)
        .groupBy(*PART)
        .agg(F.count("*").alias("n"), F.min("digest").alias("least"), F.max("digest").alias("most"))
    )
    differs = (F.col("n") < 2) | (F.col("least") != F.col("most"))
    at = F.struct("none", "turn", "place")
    ends = compared.groupBy("pair_id").agg(F.min(F.when(differs, at)).alias("end"))
    joined = both.join(ends, "pair_id")
    shared = F.col("end").isNull() | (at < F.col("end"))
    part = F.when(shared, F.lit("prompt")).otherwise(F.col("side"))
    counts = ~shared & F.coalesce(F.col("role") == trained, F.lit(False))
    text = rendered(F.col("role"), F.col("text"))
    head = F.char_length(F.lit(START)) + F.char_length(F.coalesce("role", F.lit(""))) + 1
    return joined.where(~shared | (F.col("side") == "chosen")).select(
        "pair_id",
        part.alias("part"),
        F.when(~F.col("none"), F.col("turn")).alias("turn"),
        "place",
        "role",
        text.alias("rendered"),
        F.when(counts, head).otherwise(0).alias("mask_start"),
        F.when(counts, F.char_length(text) - 1).otherwise(0).alias("mask_end"),
    )


def with_reply_of_neighbour(turns: DataFrame) -> DataFrame:
    """Rejected conversations: the last assistant turn is that of the neighbour (2k and 2k + 1).

    Without a neighbour's reply the turn is missing.
    """
    last = (
        turns.where("role = 'assistant' and turn is not null and conv_id is not null")
        .groupBy("conv_id")
        .agg(F.max(F.struct("turn", "text")).alias("reply"))
    )
    own = last.select(F.col("conv_id").alias("pair_id"), F.col("reply.turn").alias("last_turn"))
    other = last.select(
        F.col("conv_id").bitwiseXOR(F.lit(1)).alias("other_id"), F.col("reply.text").alias("other_text")
    )
    rows = turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    rows = rows.join(own, "pair_id", "left")
    replaced = (F.col("turn") == F.col("last_turn")) & (F.col("role") == "assistant")
    kept = rows.where(~F.coalesce(replaced, F.lit(False))).select("pair_id", "turn", "role", "text")
    swapped = own.join(other, own["pair_id"] == other["other_id"]).select(
        "pair_id", F.col("last_turn").alias("turn"), F.lit("assistant").alias("role"),
        F.col("other_text").alias("text"),
    )
    return kept.unionByName(swapped)


def query(spark: SparkSession, directory: str) -> DataFrame:
    """Each conversation against itself with its last reply exchanged for that of its neighbour."""
    turns = spark.read.parquet(f"{directory}/conversations.parquet")
    chosen = turns.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    return format_preferences(chosen, with_reply_of_neighbour(turns))


SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (
  SELECT pair_id, max({'turn': turn, 'text': text}) AS reply FROM turns
  WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY pair_id),
rejected AS (
  SELECT t.pair_id, t.turn, t.role, t.text FROM turns t LEFT JOIN last l USING (pair_id)
  WHERE NOT coalesce(t.turn = l.reply.turn AND t.role = 'assistant', false)
  UNION
  SELECT a.pair_id, a.reply.turn, 'assistant', b.reply.text
  FROM last a JOIN last b ON a.pair_id = xor(b.pair_id, 1)),
both_sides AS (
  SELECT side, pair_id, turn, role, text, row_number() OVER (
      PARTITION BY side, pair_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS place
  FROM (SELECT 'chosen' AS side, * FROM turns UNION ALL SELECT 'rejected', * FROM rejected)),
marked AS (
  SELECT *, count(*) OVER same = 2 AND min(coalesce(role, chr(0)) || chr(1) || coalesce(text, chr(0))) OVER same
      = max(coalesce(role, chr(0)) || chr(1) || coalesce(text, chr(0))) OVER same AS equal_turn
  FROM both_sides WINDOW same AS (PARTITION BY pair_id, turn, place)),
shared AS (
  SELECT *, bool_and(equal_turn) OVER (PARTITION BY pair_id ORDER BY turn NULLS LAST, place
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_prompt
  FROM (SELECT pair_id, turn, place, min(equal_turn) AS equal_turn FROM marked GROUP BY ALL)),
parts AS (
  SELECT m.*, s.in_prompt, '<|im_start|>' || coalesce(m.role, '') || chr(10)
      || replace(coalesce(m.text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS rendered
  FROM marked m JOIN shared s ON m.pair_id = s.pair_id AND m.place = s.place
    AND m.turn IS NOT DISTINCT FROM s.turn)
SELECT pair_id, CASE WHEN in_prompt THEN 'prompt' ELSE side END AS part, turn, place, role, rendered,
  CASE WHEN NOT in_prompt AND role = 'assistant' THEN 12 + length(role) + 1 ELSE 0 END AS mask_start,
  CASE WHEN NOT in_prompt AND role = 'assistant' THEN length(rendered) - 1 ELSE 0 END AS mask_end
FROM parts WHERE NOT in_prompt OR side = 'chosen'
"""

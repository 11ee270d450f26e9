"""Perspective rotation: a dialogue rendered once for each participant.

In the rendering of participant P, P's turns are the assistant's, everybody else's are
users' with their name in the header, and system turns stay the system's. The loss
mask covers what the assistant says and its end marker, not the headers.

A rendering is a table of segments with their character offsets, so a dialogue of any length
is never gathered in one row or task; putting its segments one after another gives the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coreloom.llm.registry import query, table

START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"
UNNAMED = "unnamed"
#: Offsets are summed in portions of this many turn numbers.
PORTION = 512


def rotate(turns: DataFrame, system: str = SYSTEM) -> DataFrame:
    """One row per conversation, perspective and turn.

    Input ``conv_id, turn, role, text``; a participant is any role but ``system``. Returns ``conv_id,
    perspective, turn, role, name, segment, start, end, mask_start, mask_end`` (offsets in characters of
    the rendering; mask null where nothing is learnt). Null roles are one participant called "unnamed", null texts are empty,
    null turns come last, rows without conv_id form one conversation. Equal turn numbers
    are ordered by role and text; repeated rows are repeated. A conversation of system turns alone has no
    perspective and no rows.
    """
    rows = turns.select(
        F.col("conv_id").isNull().alias("_none"),
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("_conv"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(UNNAMED)).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    conversation = ["_none", "_conv"]
    people = rows.where(F.col("speaker") != system).select(*conversation, F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    role = F.when(F.col("speaker") == system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    seen = rows.join(people, conversation).withColumn("role", role)
    name = F.when(F.col("role") == "user", F.col("speaker"))
    header = F.concat(
        F.lit(START), "role", F.when(F.col("role") == "user", F.concat(F.lit(" name="), "speaker")).otherwise(""), F.lit("\n")
    )
    seen = seen.withColumn("name", name).withColumn("_header", header)
    seen = seen.withColumn("segment", F.concat("_header", "text", F.lit(END)))
    seen = seen.withColumn("_length", F.char_length("segment").cast("bigint")).withColumn(
        "_portion", F.coalesce(F.floor(F.col("turn") / PORTION), F.lit((1 << 62)))
    )
    one = [*conversation, "perspective"]
    sums = seen.groupBy(*one, "_portion").agg(F.sum("_length").alias("_sum"))
    earlier = Window.partitionBy(*one).orderBy("_portion").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*one, "_portion", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    inside = (
        Window.partitionBy(*one, "_portion")
        .orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = seen.join(offsets, [*one, "_portion"]).withColumn(
        "start", F.col("_offset") + F.coalesce(F.sum("_length").over(inside), F.lit(0))
    )
    end = F.col("start") + F.col("_length")
    learnt = F.col("role") == "assistant"
    return placed.select(
        F.when(~F.col("_none"), F.col("_conv")).alias("conv_id"),
        "perspective",
        "turn",
        "role",
        "name",
        "segment",
        "start",
        end.alias("end"),
        F.when(learnt, F.col("start") + F.char_length("_header")).alias("mask_start"),
        F.when(learnt, end - 1).alias("mask_end"),
    )


SQL = f"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '{UNNAMED}') AS speaker, coalesce(text, '') AS text
  FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'),
s AS (
  SELECT t.*, perspective,
    CASE WHEN speaker = '{SYSTEM}' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (
  SELECT *, CASE WHEN role = 'user' THEN speaker END AS name,
    '{START}' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS header
  FROM s),
g AS (SELECT *, header || text || '<|im_end|>' || chr(10) AS segment FROM h),
o AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective
    ORDER BY turn NULLS LAST, speaker, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM g)
SELECT conv_id, perspective, turn, role, name, segment, "end" - length(segment) AS start, "end",
  CASE WHEN role = 'assistant' THEN "end" - length(segment) + length(header) END AS mask_start,
  CASE WHEN role = 'assistant' THEN "end" - 1 END AS mask_end
FROM o
"""


@query("op2_perspective_rotation", SQL)
def op2(spark, sf_dir):
    return rotate(table(spark, sf_dir, "conversations"))

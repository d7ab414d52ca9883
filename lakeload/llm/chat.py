"""Chat formatting after collapse of cumulative snapshots, with DataFrame functions only.

Logs often hold a conversation once after each turn. A rolling hash over the turns names each
prefix; a conversation that equals a proper prefix of another is dropped by an anti-join, and of
equal conversations the one with the least id stays. What is left is rendered.

Results for odd input: rows equal in all four columns count once; turns of one number are ordered
by role, then text; a null number comes first; a null role or text counts as empty; a null id is
a conversation like any other, and stays only if no equal one has an id; texts are kept whole;
empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeload.llm.common import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_LANES = ("h0", "h1", "h2", "h3")


def _plain(column: str) -> Column:
    """Text that cannot be taken for a marker: a blank is put into its ``<|``."""
    return F.replace(F.col(column), F.lit("<|im_"), F.lit("<| im_"))


def prefixes(conversations: DataFrame) -> DataFrame:
    """Each turn with its place ``at``, the length ``n`` and the rolling hash of the turns so far.

    The hash is a running sum of four 32-bit numbers from a digest of place, role and text, so it
    is made by one sorted pass over a conversation, of any length.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = conversations.select("conv_id", "turn", role, text).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = rows.withColumn("at", F.row_number().over(order))
    digest = F.md5(F.concat_ws(":", "at", F.length("role"), "role", "text"))
    placed = placed.withColumn("digest", digest)
    running = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lanes = [
        F.sum(F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long")).over(running).alias(lane)
        for i, lane in enumerate(_LANES)
    ]
    n = F.lead("at").over(Window.partitionBy("conv_id").orderBy("at")).isNull().alias("last")
    return placed.select("conv_id", "role", "text", "at", n, *lanes)


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id`` of the conversations that no other one continues or equals.

    Equal conversations and equal prefixes are aggregated before the join, so a first turn or a
    whole conversation that is very common is one row of it.
    """
    whole = turns.where("last").groupBy("at", *_LANES).agg(F.min("conv_id").alias("conv_id"))
    proper = turns.where("not last").select("at", *_LANES).distinct()
    return whole.join(proper, ["at", *_LANES], "left_anti").select("conv_id")


def render(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns`` and the ``chat`` of each conversation in one text."""
    piece = F.concat(F.lit(OPEN), _plain("role"), F.lit("\n"), _plain("text"), F.lit(CLOSE + "\n"))
    gathered = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("at", piece.alias("piece")))).alias("pieces"),
    )
    chat = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    return gathered.select("conv_id", "n_turns", chat.alias("chat"))


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns`` and ``chat`` of the maximal conversations."""
    turns = written(prefixes(conversations), "turns")
    kept = maximal(turns).select(F.col("conv_id").alias("kept"))
    stays = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("kept")), "left_semi")
    return render(stays)


CHAT_SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations),
c AS (
  SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn, role, text) AS turns FROM t GROUP BY conv_id),
whole AS (SELECT turns, min(conv_id) AS conv_id FROM c GROUP BY turns),
proper AS (
  SELECT DISTINCT turns[1:i] AS turns FROM whole, unnest(range(1, len(turns))) AS u(i))
SELECT conv_id, len(turns) AS n_turns,
  array_to_string(list_transform(turns, lambda x: concat('{OPEN}',
    replace(x.r, '<|im_', '<| im_'), chr(10), replace(x.t, '<|im_', '<| im_'), '{CLOSE}', chr(10))), '') AS chat
FROM whole w WHERE NOT EXISTS (SELECT 1 FROM proper p WHERE p.turns = w.turns)
"""

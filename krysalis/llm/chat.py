"""Chat formatting: logged snapshots of a conversation collapse into the longest, then are rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from krysalis.llm.common import materialize

#: Turns that are numbered and hashed together; a longer conversation is dealt out in such blocks.
BLOCK = 256


def turn_prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with ``pos`` (from 0), ``n_turns`` and the rolling prefix hash ``h1, h2``.

    The hash of a prefix is the exclusive-or of two 64-bit hashes of (position,
    role, text) over its turns, so it can be summed in blocks: places and hashes
    run inside blocks of turn numbers, and blocks are summed up per conversation.
    No task holds a conversation whole.
    """
    given = turns.select(
        "conv_id",
        F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).filter("conv_id is not null")
    given = given.withColumn("blk", F.floor(F.col("turn") / block))
    key = ["conv_id", "blk"]
    earlier = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv_id")
    sizes = given.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(*key, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(every).alias("n_turns"))
    order = Window.partitionBy(*key).orderBy("turn", "role", "text")
    placed = given.withColumn("rn", F.row_number().over(order) - 1).join(sizes, key).withColumn("pos", F.col("before") + F.col("rn"))
    own = placed.withColumn("x1", F.xxhash64("pos", "role", "text")).withColumn("x2", F.xxhash64("text", F.lit(7), "role", "pos"))
    own = materialize(own.drop("before", "rn"))
    sums = own.groupBy(*key).agg(F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"))
    sums = sums.select(*key, *(F.coalesce(F.bit_xor(b).over(earlier), F.lit(0)).alias(b) for b in ("b1", "b2")))
    inside = Window.partitionBy(*key).orderBy("pos")
    run = own.withColumn("r1", F.bit_xor("x1").over(inside)).withColumn("r2", F.bit_xor("x2").over(inside)).join(sums, key)
    return run.select("conv_id", "pos", "role", "text", "n_turns", F.col("b1").bitwiseXOR(F.col("r1")).alias("h1"), F.col("b2").bitwiseXOR(F.col("r2")).alias("h2"))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_copies)`` of the conversations that no other one continues; equal ones count once, the smallest id stays."""
    key = ["n", "h1", "h2"]
    whole = prefixes.filter("pos = n_turns - 1").select("conv_id", F.col("n_turns").alias("n"), "h1", "h2")
    distinct = whole.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    continued = prefixes.filter("pos < n_turns - 1").select((F.col("pos") + 1).alias("n"), "h1", "h2").distinct()
    return distinct.join(continued, key, "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def chat_format(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per maximal conversation: ``conv_id, n_turns, n_copies, text``.

    A conversation that is a prefix of another is an earlier snapshot of it and
    goes; of equal conversations the smallest id stays. Turns are taken in order
    of (turn, role, text), so rows that repeat a turn stay and have a place; a
    null turn comes first, null role and text are empty, and rows without a
    conversation id belong to none and are left out. Each turn is rendered as
    ``<|im_start|>role``, the text and ``<|im_end|>`` on lines. Extra columns are
    not read; an empty table gives none.
    """
    prefixes = materialize(turn_prefixes(turns, block))
    kept = maximal_conversations(prefixes)
    rendered = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    parts = prefixes.select("conv_id", "pos", rendered.alias("s")).join(kept, "conv_id")
    lines = F.array_sort(F.collect_list(F.struct("pos", "s")))
    return parts.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_join(lines["s"], "").alias("text"))


def op9_chat_format(spark, sf_dir):
    """The maximal conversations of ``conversations``, rendered."""
    return chat_format(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS s
  FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT conv_id, pos, string_agg(s, '') OVER (PARTITION BY conv_id ORDER BY pos) AS text, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t
), w AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, text FROM p WHERE pos = n_turns GROUP BY n_turns, text
)
SELECT w.conv_id, w.n_turns, w.n_copies, w.text FROM w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.pos = w.n_turns AND p.text = w.text)
"""

"""Chat formatting after cumulative-snapshot collapse, in DataFrame operations alone.

Logs that store a conversation after every turn hold many rows that are prefixes of a later
one. Each turn gets a position and a rolling hash of all turns up to it: the running sums of
four 31-bit parts of two 64-bit hashes of (position, role, text). A conversation whose last
hash is an inner hash of another one is a snapshot; an anti-join keeps the others, of exact
copies the one with the smallest id. The kept turns are rendered one by one.

A conversation is cut into blocks of ``block`` turn numbers, so the running sums of a very long
one are spread over many tasks. Texts are shuffled once, by block, and stored with their position and the sums inside their
block; everything up to the anti-join works on the stored numbers without the texts, and the texts of kept blocks are read
back. Copies are collapsed to one hash each, with map-side partial aggregation, before the anti-join, so no hash is hot on
either side of it.

Defined results: rows with a null id form one conversation, whose id is null; turns are ordered
by number (nulls first), then role, then text, and repeated rows are turns of their own; null
roles and texts count as empty; texts of any length are read whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftmark.llm.common import Scratch

MASK = (1 << 31) - 1
SUMS = ["h0", "h1", "h2", "h3"]
#: A conversation (null ids told apart by a flag, so that plain equality serves) and a block of it.
CONV, BLOCK = ["conv", "no_id"], ["conv", "no_id", "block"]


def _before(col: str, order: Window) -> Column:
    return F.coalesce(F.sum(col).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def placed_turns(df: DataFrame, block: int, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Every turn with its block, its position from 1 and s0..s3, the sums of hash parts from its block's begin up to it."""
    conv = F.col(conv_col).cast("long")
    keys = [F.coalesce(conv, F.lit(0).cast("long")).alias("conv"), conv.isNull().alias("no_id"), F.coalesce(F.floor(F.col(turn_col).cast("long") / block), F.lit(-(1 << 62))).cast("long").alias("block")]
    counts = df.select(*keys).groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(*BLOCK, _before("n", Window.partitionBy(*CONV).orderBy("block")).alias("before"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = df.select(*keys, F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    inside = Window.partitionBy(*BLOCK).orderBy("turn", "role", "text")
    # join, numbers and sums use one partitioning: texts move once
    numbered = turns.join(starts.hint("merge"), BLOCK).withColumn("pos", F.col("before") + F.row_number().over(inside))
    a, b = F.xxhash64("pos", "role", "text"), F.xxhash64("text", "pos", F.length("role"), "role")
    parts = [a.bitwiseAND(MASK), F.shiftrightunsigned(a, 33), b.bitwiseAND(MASK), F.shiftrightunsigned(b, 33)]
    hashed = numbered.select(*BLOCK, "turn", "role", "text", "pos", *[p.alias(f"p{k}") for k, p in enumerate(parts)])
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return hashed.select(*BLOCK, "role", "text", "pos", *[F.sum(f"p{k}").over(upto).alias(f"s{k}") for k in range(4)])


def rolling(placed: DataFrame) -> DataFrame:
    """conv, no_id, pos and the rolling hash h0..h3 of the turns up to pos, without the texts."""
    narrow = placed.select(*BLOCK, "pos", *[f"s{k}" for k in range(4)])
    totals = narrow.groupBy(*BLOCK).agg(F.max(F.struct("pos", *[f"s{k}" for k in range(4)])).alias("last")).select(*BLOCK, "last.*")
    by_block = Window.partitionBy(*CONV).orderBy("block")
    earlier = totals.select(*BLOCK, *[_before(f"s{k}", by_block).alias(f"q{k}") for k in range(4)])
    return narrow.join(earlier, BLOCK).select(*CONV, "pos", *[(F.col(f"s{k}") + F.col(f"q{k}")).alias(f"h{k}") for k in range(4)])


def maximal(rolled: DataFrame) -> DataFrame:
    """conv, no_id and n_turns of the conversations that are no proper prefix of another; of copies, the smallest id."""
    ends = rolled.groupBy(*CONV).agg(F.max(F.struct("pos", *SUMS)).alias("last")).select(*CONV, "last.*")
    # a null id only stands for copies that have none else
    whole = ends.groupBy("pos", *SUMS).agg(F.min(F.struct("no_id", "conv")).alias("least"))
    # a prefix is an inner one if more conversations reach its end than end there
    reached = rolled.groupBy("pos", *SUMS).agg(F.count(F.lit(1)).alias("n"))
    ended = ends.groupBy("pos", *SUMS).agg(F.count(F.lit(1)).alias("m"))
    inner = reached.join(ended, ["pos", *SUMS]).where("n > m").select("pos", *SUMS)
    return whole.join(inner, ["pos", *SUMS], "left_anti").select("least.conv", "least.no_id", F.col("pos").alias("n_turns"))


def render(role: Column, text: Column) -> Column:
    """One turn in the chat markup."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def collapse_and_render(df: DataFrame, block: int = 256, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each turn of each maximal conversation; joined in order of ``pos`` they are its formatted text."""
    scratch = Scratch(df.sparkSession, "chat")
    placed = scratch.write(placed_turns(df, block, conv_col, turn_col, role_col, text_col), "turns")
    kept = maximal(scratch.write(rolling(placed), "rolling"))
    # by block, so that the turns of a very long conversation stay spread
    blocks = placed.select(*BLOCK).distinct().join(kept, CONV)
    turns = placed.select(*BLOCK, "pos", "role", "text").join(blocks, BLOCK)
    return turns.select(F.when(~F.col("no_id"), F.col("conv")).alias("conv_id"), "pos", "n_turns", "role", render(F.col("role"), F.col("text")).alias("rendered"))


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns, list(struct_pack(r := role, x := text) ORDER BY pos) AS turns FROM t GROUP BY conv_id),
whole AS (SELECT min(conv_id) AS conv_id, n_turns, turns FROM c GROUP BY n_turns, turns),
kept AS (
  SELECT w.conv_id, w.n_turns FROM whole w
  WHERE NOT EXISTS (SELECT 1 FROM whole d WHERE d.n_turns > w.n_turns AND d.turns[1] = w.turns[1] AND d.turns[1:w.n_turns] = w.turns))
SELECT t.conv_id, t.pos, k.n_turns, t.role, '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) AS rendered
FROM t JOIN kept k ON t.conv_id IS NOT DISTINCT FROM k.conv_id
"""

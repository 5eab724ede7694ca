"""Chat logs: collapse of cumulative snapshots, then rendering.

A logger that stores a conversation after every turn leaves many records of which each is the beginning of a longer one. Each
record gets a rolling hash after every turn; a record is dropped when its last hash, at its own length, is also a hash on the
way of a longer record. Equal records collapse to the smallest id first, so both sides of that anti-join are distinct and
no key of it is hot.

Turns are ordered by (turn, role, text), nulls first; rows that repeat a turn exactly count once. Null role or text count as
empty. Rows without a conversation id belong to no conversation and are left out. Conversations may be of any length: hashes
and texts are built in blocks of ``BLOCK`` turn numbers, so that no task holds a whole long one. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from guidescape.runtime import checkpointed

BLOCK = 512


def _turn_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "pos", "role", "text")


def turn_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, block, pos (1-based), role, text, and the rolling hash (h1, h2) of all turns up to this one.

    The rolling hash is the exclusive or of hashes that include the position, so block totals combine like single turns.
    """
    rows = (
        turns.where("conv_id is not null")
        .select(
            "conv_id",
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .distinct()
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    )
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    placed = (
        rows.join(offsets, ["conv_id", "block"])
        .withColumn("pos", F.col("skip") + F.row_number().over(inside))
        .drop("skip", "turn")
    )
    placed = placed.withColumns({"t1": _turn_hash(1), "t2": _turn_hash(2)})
    so_far = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    before = totals.select(
        "conv_id",
        "block",
        *[F.coalesce(F.bit_xor(s).over(earlier), F.lit(0)).alias(s) for s in ("s1", "s2")],
    )
    return placed.join(before, ["conv_id", "block"]).select(
        "conv_id",
        "block",
        "pos",
        "role",
        "text",
        F.bit_xor("t1").over(so_far).bitwiseXOR(F.col("s1")).alias("h1"),
        F.bit_xor("t2").over(so_far).bitwiseXOR(F.col("s2")).alias("h2"),
    )


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """conv_id, n_turns and copies (records equal to it) of the conversations that begin no longer one."""
    key = ["h1", "h2", "n_turns"]
    ends = hashed.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("last"))
    ends = ends.select("conv_id", "last.h1", "last.h2", F.col("last.pos").alias("n_turns"))
    distinct = ends.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    lengths = ends.select("conv_id", "n_turns")
    on_the_way = hashed.join(lengths, "conv_id").where("pos < n_turns").select("h1", "h2", F.col("pos").alias("n_turns"))
    return distinct.join(on_the_way.distinct(), key, "left_anti").select("conv_id", "n_turns", "copies")


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """Rendered maximal conversations: conv_id, part, n_turns, copies, text.

    ``part`` counts the pieces of a conversation that spans several blocks of turn numbers, from 0; most have one.
    """
    hashed = checkpointed(turn_hashes(turns))
    kept = maximal_conversations(hashed)
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    pieces = (
        hashed.select("conv_id", "block", "pos", line.alias("line"))
        .join(kept, "conv_id")
        .groupBy("conv_id", "block", "n_turns", "copies")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("lines"))
    )
    part = F.row_number().over(Window.partitionBy("conv_id").orderBy("block")) - 1
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return pieces.select("conv_id", part.alias("part"), "n_turns", "copies", text.alias("text"))

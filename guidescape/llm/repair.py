"""Repair of damaged conversations at the least cost, with the ASCII-least list of edits among the cheapest.

Turns are kept (0), given another role (3), deleted (4: the only choice for a blank turn or one seen before), and empty turns
are inserted (3), so that the roles read ``(s?(ua)+)?``; a truncated turn that stays costs 3 more. The audit is the string of
the edits' initials.

The edits of a conversation are the paths of a graph whose nodes are (turns read, state of the role pattern). After a dynamic
program of the costs to go, only arcs that lie on cheapest paths remain. Their nodes are ranked by prefix doubling: the rank by
the first 2^(k+1) letters of a node's least audit is the rank of the pair (rank by 2^k letters, rank of the node that those
letters lead to), and the pointer there is doubled with it, until every pointer is at an end. Ranks then choose each node's arc
- the least letter, then the least rank behind it - and the doubled pointer says where the least path leaves. A node's arcs
carry different letters, so the least path of a length is unique and one pointer per node is enough.

A conversation may hold any number of turns. Turns are sorted across tasks and cut into blocks of at most ``1 << SHIFT``.
Blocks that share a conversation exchange 4 × 4 tables only: costs from each state to each are combined (minimum of sums) with
the block 1, 2, 4, ... further on, which gives every block the costs beyond its end; its least path then maps entry states to
exit states, and these maps are composed in the same doubling way. Nothing but flags, hashes and edits is moved for this; texts
are shuffled by their hash to their edits, and once more to be read in order for the digest of a conversation, as a stream.

Defined cases: null role or text counts as one space; a null conversation id is a conversation of its own; turns that are null
come first. Turns of one number are ordered by role, then by the SHA-256 of role and text; equal rows stand side by side. A
turn is blank if it has no character but white space, else a duplicate if its conversation has the same role and text earlier,
else truncated if its last such character is none of ``.!?``. Roles count by their first character; other ones than s, u and
a can only be changed. Columns other than conv_id, turn, role and text are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from guidescape.llm.text import SPACES
from guidescape.runtime import checkpointed, importable, release

SHIFT = 10
NODES = 1 << 16  # (turn, block) pairs ranked together

# States: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a. A turn's code is 3 × role (other, s, u, a) + fault (none,
# truncated, to be deleted).
_INF = 1 << 40
_NEXT = np.array([2, 2, 3, 2])  # state behind the one role that may be inserted, or given, in a state
_KEPT = np.array([[4, 4, 4, 4], [1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4]])  # state behind a kept role; 4: not allowed
_FINISH = np.array([0, 6, 3, 0])  # costs of the inserts that finish a conversation
_ROLES = {2: "user", 3: "assistant"}

_KEEP_TO = np.array([_KEPT[c // 3] if c % 3 < 2 else [4] * 4 for c in range(12)])
_KEEP_COST = np.array([3 * (c % 3 == 1) for c in range(12)])
_TURN_COST = np.array([_INF if c % 3 == 2 else 3 + 3 * (c % 3) for c in range(12)])


# --- inside a task ---------------------------------------------------------------------------------------------------


def _grouped(codes: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks by falling length, some at a time: their places, lengths, and codes padded to one width."""
    lengths = np.array([len(c) for c in codes])
    order, at = np.argsort(-lengths, kind="stable"), 0
    while at < len(order):
        some = order[at : at + max(1, NODES // (lengths[order[at]] + 1))]
        width = lengths[some[0]]
        table = np.array([list(codes[k].encode().ljust(width)) for k in some], np.int64).reshape(len(some), width) - 65
        yield some, lengths[some], table
        at += len(some)


def costs_to_go(lengths: np.ndarray, table: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least costs (turn, block, state) from before each turn to the block's end, where the costs are ``ends``."""
    out = np.tile(ends, (table.shape[1] + 1, 1, 1))
    for i in range(table.shape[1] - 1, -1, -1):
        n = int((lengths > i).sum())
        code, later = table[:n, i], np.column_stack([out[i + 1, :n], np.full(n, _INF)])
        kept = _KEEP_COST[code][:, None] + np.take_along_axis(later, _KEEP_TO[code], 1)
        moved = np.minimum(np.minimum(4 + later[:, :4], kept), _TURN_COST[code][:, None] + later[:, _NEXT])
        twice = _NEXT[_NEXT]
        out[i, :n] = np.minimum(np.minimum(moved, np.minimum(3 + moved[:, _NEXT], 6 + moved[:, twice])), _INF)
    return out


def _optimal_arcs(lengths, table, cost) -> tuple[np.ndarray, np.ndarray]:
    """For every node and letter D, I, K, R the node it leads to, or -1 if no cheapest path goes there; and which nodes end."""
    turns, blocks = cost.shape[0] - 1, cost.shape[1]
    node = np.arange(cost.size).reshape(cost.shape)
    arcs = np.full((4, *cost.shape), -1)
    inside = np.arange(turns)[:, None] < lengths
    code = np.where(inside, table.T, 2)
    here, later = cost[:-1], np.concatenate([cost[1:], np.full((turns, blocks, 1), _INF)], axis=2)
    onward = np.concatenate([node[1:], np.full((turns, blocks, 1), -1)], axis=2)
    for letter, (price, to, source) in enumerate(
        (
            (4, None, (later[..., :4], onward[..., :4])),
            (3, _NEXT, (here, node[:-1])),
            (_KEEP_COST[code][..., None], _KEEP_TO[code], (later, onward)),
            (_TURN_COST[code][..., None], _NEXT, (later, onward)),
        )
    ):
        if to is not None:
            to = np.broadcast_to(to, here.shape)
            source = [np.take_along_axis(x, to, 2) for x in source]
        arcs[letter, :-1] = np.where((price + source[0] == here) & inside[..., None], source[1], -1)
    ends = np.ones(cost.shape, bool)
    ends[:-1] = ~inside[..., None]
    return arcs.reshape(4, -1), ends.ravel()


def ranked_paths(lengths: np.ndarray, table: np.ndarray, ends: np.ndarray):
    """For every block and entry state: cost, letters of the least cheapest path, and its exit state."""
    cost = costs_to_go(lengths, table, ends)
    arcs, over = _optimal_arcs(lengths, table, cost)
    size, itself = cost.size, np.arange(cost.size)
    least = np.argmax(arcs >= 0, axis=0)
    rank = np.where(over, 0, least + 1)
    pointer = np.where(over, itself, arcs[least, itself])
    while not over[pointer].all():
        rank = np.unique(rank * (size + 1) + rank[pointer], return_inverse=True)[1]
        pointer = pointer[pointer]
    behind = np.where(arcs >= 0, np.arange(4)[:, None] * (size + 1) + rank[arcs], 4 * (size + 1))
    chosen = behind.argmin(axis=0)
    step = np.where(over, itself, arcs[chosen, itself])
    letters, at = [], itself.reshape(cost.shape)[0].ravel()
    leaves = (pointer[at] % 4).reshape(-1, 4)
    while not over[at].all():
        letters.append(np.where(over[at], ord(" "), np.frombuffer(b"DIKR", np.uint8)[chosen[at]]))
        at = step[at]
    written = np.array(letters, np.uint8).reshape(len(letters), -1).T
    audits = np.array([row.tobytes().decode().rstrip() for row in written], object).reshape(-1, 4)
    return cost[0], audits, leaves


def _crossing_costs(codes: pd.Series) -> pd.Series:
    """Costs from each state before the block (rows) to each behind it."""
    out = np.zeros((len(codes), 4, 4), np.int64)
    for some, lengths, table in _grouped(codes.tolist()):
        for r in range(4):
            ends = np.full((len(some), 4), _INF)
            ends[:, r] = 0
            out[some, :, r] = costs_to_go(lengths, table, ends)[0]
    return pd.Series(list(out.reshape(-1, 16)))


def _paths(codes: pd.Series, ends: pd.Series) -> pd.DataFrame:
    rows = len(codes)
    costs, letters = np.zeros((rows, 4), np.int64), np.full((rows, 4), "", object)
    leaves, illegal = np.zeros((rows, 4), np.int32), np.zeros(rows, np.int64)
    ends = np.stack(ends.to_list()).astype(np.int64) if rows else np.zeros((0, 4), np.int64)
    for some, lengths, table in _grouped(codes.tolist()):
        costs[some], letters[some], leaves[some] = ranked_paths(lengths, table, ends[some])
        role = table // 3
        pair = np.isin(4 * role[:, :-1] + role[:, 1:], (4 * 1 + 2, 4 * 2 + 3, 4 * 3 + 2), invert=True)
        illegal[some] = (pair & (np.arange(1, table.shape[1]) < lengths[:, None])).sum(axis=1)
    return pd.DataFrame({"costs": list(costs), "letters": list(letters), "leaves": list(leaves), "illegal": illegal})


def _edits(letters: pd.Series, codes: pd.Series, entry: pd.Series) -> pd.Series:
    """What a block's repaired turns are made of: the turn's number in the block, or none, and a new role, or none."""
    out = []
    for edits, code, state in zip(letters, codes, entry):
        turn, made = 0, []
        for letter in edits:
            if letter == "K":
                state = int(_KEEP_TO[ord(code[turn]) - 65, state])
                made.append((len(made), turn, None))
            elif letter != "D":
                state = int(_NEXT[state])
                made.append((len(made), turn if letter == "R" else None, _ROLES[state]))
            turn += letter != "I"
        out.append(made)
    return pd.Series(out)


# --- in Spark --------------------------------------------------------------------------------------------------------

_KINDS = {
    _crossing_costs: "array<long>",
    _paths: "costs array<long>, letters array<string>, leaves array<int>, illegal long",
    _edits: "array<struct<place: int, turn: int, role: string>>",
}


def _column(function, *columns) -> Column:
    return F.pandas_udf(function, _KINDS[function])(*columns)


def damage(conversations: DataFrame) -> DataFrame:
    """Turns with faults, by crc32 of ``conv_id:turn`` modulo 20, nulls read as one space: 0 drops the turn, 1 empties its
    text, 2 removes ``.!?`` from it, 3 repeats it, 4 makes its role user."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return conversations.where(kind != 0).select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
        text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _conversation() -> Column:
    """A conversation's id as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def _turns(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return rows.select(
        _conversation().alias("_conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        key.alias("_key"),
    )


def _ordered(turns: DataFrame) -> DataFrame:
    """Turns without their texts and with their place; those of a conversation stand in order, in one or more partitions."""
    last = F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1))
    fault = F.when(last == "", 2).when(~last.isin(".", "!", "?"), 1).otherwise(0)
    role = F.coalesce(F.array_position(F.array(F.lit("s"), F.lit("u"), F.lit("a")), F.substring("role", 1, 1)), F.lit(0))
    narrow = turns.select(
        "_conv", "turn", "role", "_key", fault.alias("_fault"), role.alias("_role"), F.monotonically_increasing_id().alias("_tie")
    )
    by = ["_conv", F.asc_nulls_first("turn"), "role", "_key", "_tie"]
    placed = narrow.repartitionByRange(*by).sortWithinPartitions(*by)
    return checkpointed(placed.select("_conv", "turn", "_key", "_fault", "_role", F.monotonically_increasing_id().alias("_pos")))


def _blocks(ordered: DataFrame, shift: int) -> DataFrame:
    """One row per conversation and block: codes and hashes in order, faults counted."""
    repeated = ordered.groupBy("_conv", "_key").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    repeated = repeated.where("_n > 1").drop("_n")
    blank, again = F.col("_fault") == 2, F.coalesce(F.col("_pos") > F.col("_first"), F.lit(False))
    fault = F.when(again, 2).otherwise(F.col("_fault"))
    marked = ordered.join(repeated, ["_conv", "_key"], "left").select(
        "_conv",
        F.shiftright("_pos", shift).alias("_block"),
        F.struct("_pos", F.char(65 + 3 * F.col("_role") + fault).alias("code"), F.col("_key").alias("key")).alias("_turn"),
        blank.cast("long").alias("blank"),
        (again & ~blank).cast("long").alias("duplicate"),
        (~again & (F.col("_fault") == 1)).cast("long").alias("truncated"),
    )
    grouped = marked.groupBy("_conv", "_block").agg(  # at most 1 << shift turns each
        F.sort_array(F.collect_list("_turn")).alias("_turns"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated"))
    )
    own = Window.partitionBy("_conv").orderBy("_block")
    coded = grouped.select(
        "_conv", "_block", F.array_join("_turns.code", "").alias("codes"), F.col("_turns.key").alias("keys"),
        "blank", "duplicate", "truncated",
    )
    return checkpointed(
        coded.withColumns(
            {
                "_next": F.lead("_block").over(own),
                "_before": F.lag("_block").over(own),
                "_follows": F.lead(F.substring("codes", 1, 1)).over(own),
            }
        )
    )


def _doubled(table: DataFrame, link: str, value: str, combine, rounds: int) -> DataFrame:
    """``value`` of each block combined with those of all blocks that its ``link`` leads to, one after the other."""
    for _ in range(rounds):
        there = table.select(
            F.col("_conv").alias("_of"), F.col("_block").alias("_at"), F.col(link).alias("_link"), F.col(value).alias("_value")
        )
        joined = table.join(there, (F.col("_conv") == F.col("_of")) & (F.col(link) == F.col("_at")), "left")
        together = F.when(F.col("_value").isNull(), F.col(value)).otherwise(combine(F.col(value), F.col("_value")))
        step = checkpointed(joined.select("_conv", "_block", F.col("_link").alias(link), together.alias(value)))
        release(table)
        table = step
    return table


def _in_turn(a: Column, b: Column) -> Column:
    """Least costs over two stretches of turns."""
    cells = [F.least(*(a[4 * q + k] + b[4 * k + r] for k in range(4)), F.lit(_INF)) for q in range(4) for r in range(4)]
    return F.array(*cells)


def _solved(blocks: DataFrame) -> DataFrame:
    """Blocks with their least path: letters, entry and exit state, cost to go."""
    whole = F.array(*(F.lit(int(x)) for x in _FINISH)).cast("array<long>")
    longest = blocks.groupBy("_conv").count().agg(F.max("count")).first()[0] or 0
    rounds = math.ceil(math.log2(longest)) if longest > 1 else 0
    if not rounds:
        return blocks.withColumn("_p", _column(_paths, "codes", whole)).withColumn("_entry", F.lit(0))
    shared = blocks.where("_next IS NOT NULL OR _before IS NOT NULL")
    chain = checkpointed(shared.select("_conv", "_block", "_next", _column(_crossing_costs, "codes").alias("_m")))
    chain = _doubled(chain, "_next", "_m", _in_turn, rounds)
    beyond = F.array(*(F.least(*(F.col("_m")[4 * q + r] + int(_FINISH[r]) for r in range(4))) for q in range(4)))
    beyond = chain.select("_conv", F.col("_block").alias("_next"), beyond.alias("_ends"))
    solved = blocks.join(beyond, ["_conv", "_next"], "left").withColumn("_p", _column(_paths, "codes", F.coalesce("_ends", whole)))
    solved = checkpointed(solved.drop("_ends"))
    maps = checkpointed(
        solved.where("_next IS NOT NULL OR _before IS NOT NULL").select(
            "_conv", "_block", "_before", F.col("_p.leaves").alias("_f")
        )
    )
    maps = _doubled(maps, "_before", "_f", lambda mine, earlier: F.transform(earlier, lambda q: mine[q]), rounds)
    entered = maps.select("_conv", F.col("_block").alias("_before"), F.col("_f")[0].alias("_entry"))
    return solved.join(entered, ["_conv", "_before"], "left").withColumn("_entry", F.coalesce("_entry", F.lit(0)))


def repair(rows: DataFrame, shift: int = SHIFT) -> tuple[DataFrame, DataFrame]:
    """Two tables. Of conversations: _conv, gaps, blank, duplicate, truncated, illegal, cost, audit. Of repaired turns: _conv,
    _block and _place to order by, role, text."""
    importable(rows.sparkSession)
    turns = _turns(rows)
    ordered = _ordered(turns)
    blocks = _solved(_blocks(ordered, shift))
    letters, leaves = F.col("_p.letters")[F.col("_entry")], F.col("_p.leaves")[F.col("_entry")]
    inserts = F.array(*(F.lit(int(x) // 3) for x in _FINISH))[leaves]
    letters = F.when(F.col("_next").isNull(), F.concat(letters, F.repeat(F.lit("I"), inserts))).otherwise(letters)
    solved = checkpointed(blocks.withColumn("_letters", letters))

    sides = F.array_join(
        F.transform(F.array(F.right("codes", F.lit(1)), F.col("_follows")), lambda c: F.floor((F.ascii(c) - 65) / 3).cast("string")),
        "",
    )
    between = (F.col("_follows").isNotNull() & ~sides.isin("12", "23", "32")).cast("long")
    cost = F.when(F.col("_before").isNull(), F.col("_p.costs")[0])
    report = solved.groupBy("_conv").agg(
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
        F.sum(F.col("_p.illegal") + between).alias("illegal"),
        F.sum(cost).alias("cost"),
        F.array_join(F.sort_array(F.collect_list(F.struct("_block", "_letters")))["_letters"], "").alias("audit"),
    )
    per_turn = ordered.where("turn IS NOT NULL").groupBy("_conv", "turn").agg(F.count(F.lit(1)))
    span = F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))
    report = report.join(per_turn.groupBy("_conv").agg(span.alias("gaps")), "_conv", "left").fillna(0, ["gaps"])

    made = solved.select("_conv", "_block", "keys", F.explode(_column(_edits, "_letters", "codes", "_entry")).alias("_e")).select(
        "_conv", "_block", F.col("_e.place").alias("_place"), F.col("_e.role").alias("_given"),
        F.when(F.col("_e.turn").isNotNull(), F.col("keys")[F.col("_e.turn")]).alias("_key"),
    )
    # A kept turn is the only kept one of its conversation with its role and text, so equal rows may be collapsed first.
    texts = turns.groupBy("_conv", "_key").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    repaired = made.join(texts, ["_conv", "_key"], "left").select(
        "_conv", "_block", "_place", F.coalesce("_given", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return report, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """_conv and the SHA-256 of its ``role:text`` lines; one conversation is one stream, never held as a whole."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            done = []
            for conv, role, text in zip(pdf["_conv"], pdf["role"], pdf["text"]):
                if conv != current:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode("utf-8", "replace"))
            yield pd.DataFrame(done, columns=["_conv", "digest"])
        if state is not None:
            yield pd.DataFrame([(current, state.hexdigest())], columns=["_conv", "digest"])

    in_order = repaired.repartition("_conv").sortWithinPartitions("_conv", "_block", "_place")
    return in_order.select("_conv", "role", "text").mapInPandas(read, "_conv string, digest string")


def repair_report(originals: DataFrame, rows: DataFrame, shift: int = SHIFT) -> DataFrame:
    """Per conversation of ``originals``: faults found in ``rows``, cost and audit of the repair, digest of the result."""
    report, repaired = repair(rows, shift)
    every = originals.select("conv_id").distinct().withColumn("_conv", _conversation())
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    joined = every.join(report, "_conv", "left").join(digests(repaired), "_conv", "left")
    return joined.select(
        "conv_id",
        *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )

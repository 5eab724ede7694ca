"""Conversation repair against a plain forward search, and that search against all edit lists of short conversations."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from guidescape.llm import repair
from guidescape.llm.queries import QUERIES

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, _key int, _block int, cost string, codes string"
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        out += [(c, t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def in_order(rows):
    def key(r):
        return r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()

    return sorted(((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows), key=key)


def faults_of(rows):
    seen, out = set(), []
    for _, _, r, x in rows:
        end = x.rstrip(SPACE)[-1:]
        out.append("b" if not end else "d" if (r, x) in seen else "t" if end not in ".!?" else "")
        seen.add((r, x))
    return out


def inserts(best):
    todo = list(best)
    while todo:
        q = todo.pop()
        for role in ("user", "assistant"):
            z = STEP.get((q, role[0]))
            c = (best[q][0] + 3, best[q][1] + "I", best[q][2] + ((role, ""),))
            if z is not None and (z not in best or c[:2] < best[z][:2]):
                best[z] = c
                todo.append(z)
    return best


def cheapest(rows, faults):
    """Forward over states, least (cost, audit) first."""
    best = inserts({0: (0, "", ())})
    for (_, _, r, x), f in zip(rows, faults):
        new = {}
        for q, (cost, audit, out) in best.items():
            choices = [(q, (cost + 4, audit + "D", out))]
            if f not in ("b", "d"):
                more = 3 * (f == "t")
                choices.append((STEP.get((q, r[:1])), (cost + more, audit + "K", out + ((r, x),))))
                for role in ("user", "assistant"):
                    choices.append((STEP.get((q, role[0])), (cost + 3 + more, audit + "R", out + ((role, x),))))
            for z, c in choices:
                if z is not None and (z not in new or c[:2] < new[z][:2]):
                    new[z] = c
        best = inserts(new)
    return min((best[q] for q in (0, 3) if q in best), key=lambda b: b[:2])


def expected(original, rows):
    groups = {r[0]: [] for r in original}
    for r in rows:
        groups[r[0]].append(r)
    out = {}
    for c, own in groups.items():
        own = in_order(own)
        turns = [r[1] for r in own if r[1] is not None]
        faults, first = faults_of(own), [r[2][:1] for r in own]
        cost, audit, made = cheapest(own, faults)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in made).encode()).hexdigest()
        out[c] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest)
    return out


def found(df):
    rows = df.collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def random_turns(rng, n):
    text = lambda: rng.choice(["Yes.", "No?", "cut", "", " \t", "A word! ", "end"]) + rng.choice(["", "", str(rng.randrange(99)) + "."])
    return [(rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "User", ""]), text()) for _ in range(n)]


def test_search_against_all_edit_lists():
    rng = random.Random(1)

    def every(i, rows, faults, edits, roles, cost, budget):
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            yield cost, edits
        if cost > budget:
            return
        for r in "ua":
            yield from every(i, rows, faults, edits + "I", roles + r, cost + 3, budget)
        if i < len(rows):
            yield from every(i + 1, rows, faults, edits + "D", roles, cost + 4, budget)
            if faults[i] not in ("b", "d"):
                more = 3 * (faults[i] == "t")
                yield from every(i + 1, rows, faults, edits + "K", roles + (rows[i][2][:1] or "-"), cost + more, budget)
                for r in "ua":
                    yield from every(i + 1, rows, faults, edits + "R", roles + r, cost + 3 + more, budget)

    for _ in range(60):
        rows = [(1, i, r, x) for i, (r, x) in enumerate(random_turns(rng, rng.randrange(5)))]
        faults = faults_of(rows)
        got = cheapest(rows, faults)
        assert got[:2] == min(every(0, rows, faults, "", "", 0, got[0]))


def test_ranked_paths_against_the_search():
    rng = random.Random(2)
    cases, codes = [], []
    for n in [1, 2, 3, 5, 8, 13, 40, 200] * 12:
        rows = [(1, i, r, x) for i, (r, x) in enumerate(random_turns(rng, n))]
        faults = faults_of(rows)
        cases.append(cheapest(rows, faults))
        role = [1 + "sua".find(r[2][:1] or "-") for r in rows]
        codes.append("".join(chr(65 + 3 * k + {"": 0, "t": 1}.get(f, 2)) for k, f in zip(role, faults)))
    for some, lengths, table in repair._grouped(codes):
        ends = np.tile(repair._FINISH, (len(some), 1))
        cost, letters, leaves = repair.ranked_paths(lengths, table, ends)
        for k, b in enumerate(some):
            tail = "I" * (repair._FINISH[leaves[k, 0]] // 3)
            assert (cost[k, 0], letters[k, 0] + tail) == cases[b][:2]


@pytest.mark.parametrize("shift", [1, 3, 10])
def test_long_short_and_odd_conversations(spark, shift):
    rng = random.Random(3)
    rows = []
    for c, n in enumerate([0, 1, 2, 3, 5, 8, 300, 41] * 3):
        rows += [(c, t, r, x) for t, (r, x) in enumerate(random_turns(rng, n))]
    rows += [(50, None, "user", "Null turn."), (50, None, None, None), (50, 7, "assistant", "Fine.\x0b"), (50, 2**40, None, "x.")]
    rows += [(51, 1, "user", "One?"), (51, 1, "user", "One?"), (51, 1, "assistant", "One?"), (51, 1, "assistant", "Other.")] * 2
    rows += [(None, 1, "user", "No id."), (None, 2, "assistant", "No id either.")]
    rows += [(52, t, "user" if t % 2 else "assistant", "the same.") for t in range(90)]
    rows += [(53, 1, "user", "long " * 60_000 + "."), (53, 2, "assistant", "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(4)
    assert found(repair.repair_report(df, df, shift)) == expected(rows, rows)
    assert found(repair.repair_report(df, repair.damage(df), shift)) == expected(rows, damaged(rows))


def test_a_conversation_with_a_third_of_all_rows_is_cut_into_blocks(spark):
    rng = random.Random(4)
    rows = [(c, t, r, x) for c in range(30) for t, (r, x) in enumerate(random_turns(rng, 20))]
    rows += [(99, t, "user", "again and again.") for t in range(150)] + [(99, t % 7, r, x) for t, (r, x) in enumerate(random_turns(rng, 150))]
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA).repartition(4)
    blocks = repair._blocks(repair._ordered(repair._turns(df)), 4)
    assert max(len(r["codes"]) for r in blocks.collect()) <= 16
    assert found(repair.repair_report(df, df, 4)) == expected(rows, rows)


def test_repaired_turns_keep_order_and_pattern(spark):
    rng = random.Random(5)
    rows = [(c, t, r, x) for c in range(20) for t, (r, x) in enumerate(random_turns(rng, 1 + c))]
    df = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in rows], SCHEMA)
    _, turns = repair.repair(df, 2)
    by = {}
    for r in turns.orderBy("_conv", "_block", "_place").collect():
        by.setdefault(r["_conv"], []).append((r["role"], r["text"]))
    for c in range(20):
        made = by.get(f"={c}", [])
        own = in_order([r for r in rows if r[0] == c])
        assert tuple(made) == cheapest(own, faults_of(own))[2]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair.repair_report(df, repair.damage(df)).collect() == []
    one = spark.createDataFrame([(1, 1, "user", "gone.", 1, 2, "x", "y")], SCHEMA)
    row = repair.repair_report(one, df).collect()
    assert [tuple(r) for r in row] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op11_conversation_repair"](spark, folder)) == expected(rows, damaged(rows))

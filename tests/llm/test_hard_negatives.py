"""Hard negatives against brute force: small blocks, ties, repeats, nulls, ragged and huge vectors; bounds against scores."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from guidescape.llm import hard_negatives as hn
from guidescape.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label long, _row int, score string, _anchor boolean"


def scaled(v):
    return [math.floor(256 * x) for x in v]


def brute(rows, positives=5, negatives=3):
    """rows: (id, vector, label); anchors have an id divisible by 50."""
    usable = [
        (i, v, l)
        for i, v, l in rows
        if l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (i, v, l) in enumerate(usable):
        if i is None or i % 50:
            continue
        scored = []
        for k, (j, w, m) in enumerate(usable):
            if k != at:
                s = sum(x * y for x, y in zip(scaled(v), scaled(w)))
                scored.append((-min(max(s, -(1 << 63)), (1 << 63) - 1), j is None, j or 0, j, m))
        scored.sort(key=lambda x: x[:3])
        for minus, _, _, j, _ in [x for x in scored if x[4] == l][:positives]:
            fits = [x for x in scored if x[4] != l and 50 * -minus <= 100 * -x[0] <= 95 * -minus][:negatives]
            out += [(i, j, r + 1, x[3], -minus, -x[0]) for r, x in enumerate(fits)]
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, l, 1, "x", None) for i, v, l in rows], SCHEMA).repartition(3)
    found = hn.hard_negatives(df, F.col("label"), F.col("vec_id") % 50 == 0, **kw)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, found.collect()), key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(hn, "CANDIDATE_VALUES", 256 * 6)
    monkeypatch.setattr(hn, "ANCHOR_VALUES", 64 * 6)
    monkeypatch.setattr(hn, "SEGMENT", 50)


def test_many_blocks_and_a_hot_label(spark, small_blocks):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 6))
    rows = []
    for i in range(900):
        c = 0 if i % 3 else int(rng.integers(6))
        rows.append((i * 10, (centres[c] + 0.4 * rng.normal(size=6)).tolist(), c if rng.random() < 0.7 else int(rng.integers(6))))
    rows += rows[:200:7] * 2
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_ties_copies_nulls_and_odd_vectors(spark, small_blocks):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-2, 3, 4).astype(float).tolist(), i % 3) for i in range(160)]
    rows += [(300 + i, [1.0, 1.0, 1.0, 1.0], i % 2) for i in range(120)]
    rows += [(100, [1.0, 2.0, 0.0, 1.0], 1)] * 3
    rows += [(None, [1.0, 1.0, 1.0, 2.0], 1), (None, [2.0, 0.5, 0.5, 0.5], 0), (None, None, None)]
    rows += [(500, None, 1), (550, [1.0, None], 1), (600, [float("nan"), 1.0], 1), (650, [float("inf")], 1), (700, [1.0], None)]
    rows += [(750, [], 1), (800, [3.0], 2), (850, [1.0] * 7, 2), (-50, [0.1, 0.2, 0.3, 0.4], 1)]
    assert run(spark, rows) == sorted(brute(rows), key=str)
    assert run(spark, rows, positives=2, negatives=1) == sorted(brute(rows, 2, 1), key=str)


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=3) * 10.0 ** int(rng.integers(0, 8))).tolist(), i % 2) for i in range(120)]
    rows += [(150, [1e30, 0.0, 0.0], 0), (151, [1e30, 1.0, 0.0], 0), (152, [1e12, 0.0, 5.0], 1)]
    found = run(spark, rows)
    assert found == sorted(brute(rows), key=str)
    assert any(abs(r[4]) > 1 << 53 for r in found)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == []
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert run(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2)]) == [(0, 1, 1, 2, 65536, 49152)]


def test_bounds_hold_and_rule_out_most_candidates():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(8, 16)) * 4
    anchors = np.round(256 * (np.repeat(centres, 8, 0) + 0.02 * rng.normal(size=(64, 16))))
    vectors = np.round(256 * (centres[rng.integers(8, size=3000)] + 0.5 * rng.normal(size=(3000, 16))))
    tree = hn.spanning_tree(anchors)
    assert sorted(tree.order) == list(range(64)) and tree.store.max() <= 7
    exact = vectors @ anchors.T
    cut = np.sort(exact, axis=0)[-30]

    def wanted(i, low, high):
        assert (low <= exact[:, i]).all() and (exact[:, i] <= high).all()
        return high >= cut[i]

    found = np.zeros(64, int)

    def take(i, at, scores):
        assert (scores == exact[at, i]).all()
        found[i] = (scores >= cut[i]).sum()

    scored = hn.walk(tree, anchors, vectors, np.linalg.norm(vectors, axis=1), wanted, take)
    assert (found == (exact >= cut).sum(axis=0)).all()
    assert scored < 0.5 * exact.size


def test_tree_is_a_minimum_one():
    rng = np.random.default_rng(13)
    anchors = rng.normal(size=(40, 3))
    points = np.vstack([np.zeros(3), anchors])
    gaps = sorted((np.linalg.norm(points[i] - points[j]), i, j) for i in range(41) for j in range(i))
    group, total = list(range(41)), 0.0
    for gap, i, j in gaps:
        if group[i] != group[j]:
            total += gap
            group = [group[i] if g == group[j] else g for g in group]
    assert abs(hn.spanning_tree(anchors).edge.sum() - total) < 1e-9


def test_query_reads_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    found = QUERIES["op13_hard_negatives"](spark, folder).select("anchor_id").distinct().collect()
    ids = spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert len(found) == ids

"""Branch membership and batched branch tests against a loop of dense fits; wide factors against dense least squares."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from guidescape.operators import nested, trajectory

from test_differential import chi2_tail, dummies, rss, spline


def corrected(p):
    order = np.argsort(p)[::-1]
    out, least = np.empty(len(p)), 1.0
    for place, i in enumerate(order):
        least = min(least, p[i] * len(p) / (len(p) - place))
        out[i] = least
    return out


# 0 - 1 - 2 < (3 - 4), (5 < 6, 7)
CENTRES = np.array([[0, 0], [1, 0], [2, 0], [3, 1], [4, 2], [3, -1], [4, -1], [3, -2]], float)
TREE = trajectory.Tree(CENTRES, [(0, 1), (1, 2), (2, 3), (3, 4), (2, 5), (5, 6), (5, 7)])


def test_paths_share_the_way_from_the_root():
    sides = {}
    for point, side, edge in trajectory.branch_paths(TREE, 0):
        sides.setdefault((point, side), set()).add(edge)
    assert sides == {(2, 0): {0, 1, 2, 3}, (2, 1): {0, 1, 4, 5, 6}, (5, 0): {0, 1, 4, 5}, (5, 1): {0, 1, 4, 6}}


def test_paths_from_a_root_that_branches():
    star = trajectory.Tree(np.array([[0, 0], [1, 0], [-1, 0], [0, 1]], float), [(0, 1), (0, 2), (0, 3)])
    assert {(p, s, e) for p, s, e in trajectory.branch_paths(star, 0)} == {(0, 0, 0), (0, 1, 1), (0, 2, 2)}
    assert {(p, s, e) for p, s, e in trajectory.branch_paths(star, 1)} == {(0, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 2)}
    line = trajectory.Tree(np.array([[0, 0], [1, 0], [2, 0]], float), [(0, 1), (1, 2)])
    assert trajectory.branch_paths(line, 0) == []


def off_skeleton(tree, arms):
    """Mean distance of the tree's centres to the planted arms, and the tree's length against theirs."""
    best = np.full(len(tree.centres), np.inf)
    for arm in arms:
        along = np.clip(tree.centres @ arm / (arm @ arm), 0, 1)
        best = np.minimum(best, np.linalg.norm(tree.centres - along[:, None] * arm, axis=1))
    return best.mean(), sum(tree.length(e) for e in tree.edges)


def test_principal_tree_recovers_a_planted_fork(spark):
    rng = np.random.default_rng(21)
    arms = [np.array([0.0, -6.0, 0.0]), np.array([5.0, 4.0, 0.0]), np.array([-5.0, 4.0, 0.0])]
    x = np.concatenate([rng.random((500, 1)) * arm for arm in arms]) + rng.normal(size=(1500, 3)) * 0.9
    points = spark.createDataFrame(pd.DataFrame({"cell_id": range(1500), "values": x.tolist()})).repartition(4)
    history = []
    tree = trajectory.principal_tree(points, 18, history=history)
    assert len(history) > 2 and all(b <= a + 1e-9 * abs(a) for a, b in zip(history, history[1:]))
    plain = trajectory.fit_tree(points, 18)
    away, length = off_skeleton(tree, arms)
    away_plain, length_plain = off_skeleton(plain, arms)
    longest = sum(np.linalg.norm(a) for a in arms)
    assert away < 0.5 * away_plain and away < 0.3
    assert abs(length / longest - 1) < 0.3 < length_plain / longest - 1
    points_of = tree.branch_points()
    assert len(points_of) == 1 and np.linalg.norm(tree.centres[points_of[0]]) < 1.5
    assert len(plain.branch_points()) > 1


def test_principal_tree_of_few_or_equal_cells(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "cell_id long, values array<double>")
    assert np.allclose(trajectory.principal_tree(same, 3).centres, [1.0, 2.0])
    two = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "cell_id long, values array<double>")
    assert len(trajectory.principal_tree(two, 2).edges) == 1


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(4)
    n = 400
    edge = rng.integers(0, len(TREE.edges), n)
    ends = np.array(TREE.edges)[edge]
    share = rng.random((n, 1))
    at = CENTRES[ends[:, 0]] * (1 - share) + CENTRES[ends[:, 1]] * share
    cells = pd.DataFrame({"cell_id": np.arange(n), "values": (at + 0.01 * rng.normal(size=(n, 2))).tolist()})
    placed = trajectory.project_cells(spark.createDataFrame(cells), TREE)
    members = trajectory.branch_members(placed, TREE, 0).toPandas()
    upper = np.isin(edge, [2, 3])
    genes = {
        "noise": rng.normal(size=n),
        "first": rng.normal(size=n) * 0.2 + upper * at[:, 0],
        "second": rng.normal(size=n) * 0.2 + (edge == 6) * 1.5,
        "flat": np.full(n, 1.0),
        "rare": np.where(rng.random(n) < 0.05, 1.0 + rng.random(n), 0.0),
    }
    long = pd.concat([pd.DataFrame({"cell_id": np.arange(n), "gene": g, "value": v}) for g, v in genes.items()])
    return genes, spark.createDataFrame(long), spark.createDataFrame(members), members, edge


def test_members_follow_the_tree(planted):
    *_, members, edge = planted
    for (point, side), part in members.groupby(["branch_point", "side"]):
        wanted = {e for p, s, e in trajectory.branch_paths(TREE, 0) if (p, s) == (point, side)}
        inside = np.isin(edge, list(wanted))
        assert (np.isin(np.arange(len(edge)), part["cell_id"]) == inside).mean() > 0.97
    shared = members[members["branch_point"] == 2].groupby("cell_id")["side"].nunique()
    assert (shared > 1).sum() > 50


@pytest.mark.parametrize("zeros", [True, False])
def test_all_branch_points_equal_a_loop(spark, planted, zeros):
    genes, expr, member_rows, members, _ = planted
    got = nested.branch_tests(expr if zeros else expr.where("value <> 0"), member_rows).toPandas()
    for point, part in members.groupby("branch_point"):
        t = spline(part["pseudotime"].to_numpy())
        side = part["side"].to_numpy()[:, None]
        reduced = np.c_[np.ones(len(part)), t]
        full = np.c_[reduced, side, t * side]
        want = {}
        for gene, y in genes.items():
            if gene != "flat":
                y = y[part["cell_id"]]
                want[gene] = chi2_tail(len(part) * math.log(rss(y, reduced) / rss(y, full)), 4)
        q = dict(zip(want, corrected(np.array(list(want.values())))))
        rows = got[got["branch_point"] == point].set_index("gene")
        assert rows.loc["flat", "status"] == "FAIL"
        for gene, p in want.items():
            assert rows.loc[gene, "pval"] == pytest.approx(p, rel=1e-6, abs=1e-200)
            assert rows.loc[gene, "qval"] == pytest.approx(q[gene], rel=1e-6, abs=1e-200)
    kept = nested.branch_tests(expr, member_rows, cutoff=1e-4).collect()
    found = {(r["branch_point"], r["gene"]) for r in kept}
    assert {(2, "first"), (5, "second")} <= found and all(g in ("first", "second") for _, g in found)


def test_profiles_of_every_side(planted):
    genes, expr, member_rows, members, _ = planted
    got = nested.pseudotime_profile(
        expr.where("value <> 0"), member_rows, bins=10, by=["branch_point", "side"], within=["branch_point"]
    ).toPandas()
    for point, part in members.groupby("branch_point"):
        low, high = part["pseudotime"].min(), part["pseudotime"].max()
        place = np.minimum(np.floor((part["pseudotime"] - low) / (high - low) * 10), 9)
        for side, rows in part.groupby("side"):
            for b, inside in rows.groupby(place[rows.index]):
                for gene in ("rare", "first"):
                    hit = got[(got.branch_point == point) & (got.side == side) & (got.bin == b) & (got.gene == gene)]
                    assert hit["mean"].item() == pytest.approx(genes[gene][inside["cell_id"]].mean(), abs=1e-12)


def test_no_branch_points_give_no_rows(spark, planted):
    _, expr, *_ = planted
    line = trajectory.Tree(np.array([[0, 0], [1, 0], [2, 0]], float), [(0, 1), (1, 2)])
    points = spark.createDataFrame([(1, [0.1, 0.0]), (2, [1.5, 0.0])], "cell_id long, values array<double>")
    members = trajectory.branch_members(trajectory.project_cells(points, line), line, 0)
    assert members.collect() == []
    assert nested.branch_tests(expr, members).collect() == []


# --- factors of many levels ------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def wide(spark):
    rng = np.random.default_rng(8)
    guides, clusters, n = 282, 12, 12_000
    cells = pd.DataFrame(
        {
            "cell_id": np.arange(n),
            "guide": rng.integers(0, guides, n),
            "louvain": rng.integers(0, clusters, n),
            "donor": rng.integers(0, 3, n),
            "depth": rng.random(n),
        }
    )
    cells["guide"] = cells["guide"].map("G{}".format)
    cells["both"] = cells["louvain"].astype(str) + "-" + cells["guide"]
    level = rng.normal(size=guides)[cells["guide"].str[1:].astype(int)]
    genes = {
        "a": rng.normal(size=n) + 30 + 0.5 * cells["louvain"] + level,
        "b": rng.normal(size=n) + 0.1 * cells["donor"],
        "c": np.where(rng.random(n) < 0.1, rng.random(n) + cells["depth"], 0.0),
        "d": rng.normal(size=n) + cells["depth"],
    }
    genes = {g: np.asarray(v, float) for g, v in genes.items()}
    long = pd.concat([pd.DataFrame({"cell_id": np.arange(n), "gene": g, "value": v}) for g, v in genes.items()])
    expr = spark.createDataFrame(long[long["value"] != 0])
    return genes, expr, spark.createDataFrame(cells), cells


def within(y, levels):
    """Residual sum of squares of level means."""
    frame = pd.DataFrame({"y": y, "l": levels})
    return ((frame["y"] - frame.groupby("l")["y"].transform("mean")) ** 2).sum()


def log_tail(lr, df):
    """Upper χ² tail for even or odd degrees, by the recurrence of ``chi2_tail`` in a loop."""
    x = lr / 2
    value = math.erfc(math.sqrt(x)) if df % 2 else math.exp(-x)
    a = 0.5 if df % 2 else 1.0
    while a < df / 2 - 1e-9:
        value += math.exp(a * math.log(x) - x - math.lgamma(a + 1))
        a += 1
    return value


def compare(found, n, less, full, df):
    got = {r["gene"]: r for r in found.collect()}
    for gene in less:
        assert got[gene]["status"] == "OK"
        assert got[gene]["pval"] == pytest.approx(log_tail(n * math.log(less[gene] / full[gene]), df), rel=1e-5, abs=1e-12)


def test_absorbed_factor_of_3384_levels(wide):
    genes, expr, cells, frame = wide
    n, levels = len(frame), frame["both"].nunique()
    assert levels > 3_200
    louvain = nested.factor_term(cells, "louvain")
    found = nested.de_nested(expr, cells, [louvain], [], absorbed="both", absorbed_in="full")
    less = {g: within(y, frame["louvain"]) for g, y in genes.items()}
    full = {g: within(y, frame["both"]) for g, y in genes.items()}
    compare(found, n, less, full, levels - 12)


def test_absorbed_factor_beside_others(wide):
    genes, expr, cells, frame = wide
    n = len(frame)
    louvain, donor, depth = (
        nested.factor_term(cells, "louvain"),
        nested.factor_term(cells, "donor"),
        nested.spline_term(cells, "depth"),
    )
    found = nested.de_nested(expr, cells, [louvain], [donor, depth], absorbed="guide")
    small = np.c_[dummies(frame["guide"]), dummies(frame["louvain"])]
    large = np.c_[small, dummies(frame["donor"]), spline(frame["depth"].to_numpy())]
    less = {g: rss(y, small) for g, y in genes.items()}
    full = {g: rss(y, large) for g, y in genes.items()}
    compare(found, n, less, full, 5)
    dense = nested.de_nested(expr, cells, [louvain, nested.factor_term(cells, "guide")], [donor, depth])
    a, b = ({r["gene"]: r["pval"] for r in x.collect()} for x in (found, dense))
    assert all(a[g] == pytest.approx(b[g], rel=1e-5, abs=1e-12) for g in a)


def test_rank_of_two_factors_is_levels_less_components(spark):
    """Two groups of cells without a common level: one more level than usual is redundant."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(400):
        part = i % 2
        rows.append((i, f"u{part}{rng.integers(0, 4)}", f"v{part}{rng.integers(0, 3)}", i % 5, float(rng.normal())))
    cells = spark.createDataFrame([r[:4] for r in rows], "cell_id long, u string, v string, w int")
    expr = spark.createDataFrame([(r[0], "g", r[4]) for r in rows], "cell_id long, gene string, value double")
    frame = pd.DataFrame(rows, columns=["c", "u", "v", "w", "y"])
    v = nested.factor_term(cells, "v")
    found = nested.de_nested(expr, cells, [], [v], absorbed="u").first()
    less, full = rss(frame["y"], dummies(frame["u"])), rss(frame["y"], np.c_[dummies(frame["u"]), dummies(frame["v"])])
    assert found["pval"] == pytest.approx(chi2_tail(400 * math.log(less / full), 6 - 2), rel=1e-6)


def test_too_wide_a_design_names_the_way_out(spark):
    cells = spark.range(3_000).select(F.col("id").alias("cell_id"), F.col("id").alias("many"))
    with pytest.raises(ValueError, match="levels"):
        nested.factor_term(cells, "many")

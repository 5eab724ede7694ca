"""Fitted curves against dense least squares, the gene tree against Ward's merges one by one."""

import numpy as np
import pandas as pd
import pytest

from guidescape.operators import curves

from test_differential import spline


@pytest.fixture(scope="module")
def wave(spark):
    rng = np.random.default_rng(31)
    n = 300
    cells = pd.DataFrame({"cell_id": range(n), "pseudotime": rng.random(n) * 5 + 2, "side": np.arange(n) % 2})
    t = cells["pseudotime"].to_numpy()
    genes = {
        "up": t + rng.normal(size=n) * 0.2,
        "arch": -((t - 4) ** 2) + rng.normal(size=n) * 0.2,
        "rare": np.where(rng.random(n) < 0.2, rng.random(n), 0.0),
        "none": np.zeros(n),
    }
    long = pd.concat([pd.DataFrame({"cell_id": range(n), "gene": g, "value": v}) for g, v in genes.items()])
    listed = spark.createDataFrame([(g,) for g in genes], "gene string")
    return genes, spark.createDataFrame(long[long["value"] != 0]), spark.createDataFrame(cells), cells, listed


def dense_curve(t, y, points):
    """The fit on cells and grid together, so that the independent basis of the tests has the same knots for both."""
    basis = np.c_[np.ones(len(t)), spline(t)]
    beta = np.linalg.lstsq(basis, y, rcond=None)[0]
    grid = np.linspace(t.min(), t.max(), points)
    at = basis @ beta
    order = np.argsort(t)
    return grid, np.interp(grid, t[order], at[order])


@pytest.mark.parametrize("by", [[], ["side"]])
def test_curves_equal_dense_fits(wave, by):
    genes, expr, cell_rows, cells, listed = wave
    got = curves.fitted_curves(expr, cell_rows, points=40, by=by, genes=listed).toPandas()
    for key, part in cells.groupby(by) if by else [((), cells)]:
        t = part["pseudotime"].to_numpy()
        rows = got if not by else got[got["side"] == key[0]]
        for gene, y in genes.items():
            own = rows[rows["gene"] == gene].sort_values("point")
            assert len(own) == 40
            grid, want = dense_curve(t, y[part["cell_id"]], 40)
            assert own["pseudotime"].to_numpy() == pytest.approx(grid)
            # between cells the dense curve is interpolated, hence the tolerance; at the ends it is exact
            assert own["curve"].to_numpy() == pytest.approx(want, abs=0.02)
            assert own["curve"].iloc[[0, -1]].to_numpy() == pytest.approx(want[[0, -1]], abs=1e-8)
            if gene == "none":
                assert own["z"].isna().all()
            else:
                assert own["z"].mean() == pytest.approx(0, abs=1e-9) and own["z"].std() == pytest.approx(1)


def ward(x):
    """One merge after another, from the definition."""
    groups = {i: ([i], x[i]) for i in range(len(x))}
    merges = []
    while len(groups) > 1:
        best = min(
            (2 * len(p) * len(q) / (len(p) + len(q)) * ((m - k) ** 2).sum(), a, b)
            for a, (p, m) in groups.items()
            for b, (q, k) in groups.items()
            if a < b
        )
        (p, m), (q, k) = groups.pop(best[1]), groups.pop(best[2])
        groups[len(x) + len(merges)] = (p + q, (len(p) * m + len(q) * k) / (len(p) + len(q)))
        merges.append((frozenset(p + q), best[0] ** 0.5))
    return merges


def test_tree_equals_ward(spark, monkeypatch):
    monkeypatch.setattr(curves, "TASK_ROWS", 10)
    rng = np.random.default_rng(32)
    x = rng.normal(size=(64, 12)) + 2 * rng.integers(0, 4, (64, 1))
    rows = [(f"g{i:02d}", j, float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    df = spark.createDataFrame(rows, "gene string, point int, z double").repartition(4)
    tree = curves.gene_tree(df)
    held = [frozenset([i]) for i in range(64)]
    for a, b, _ in tree.merges:
        held.append(held[a] | held[b])
    want = ward(x)
    assert held[64:] == [g for g, _ in want]
    assert [h for *_, h in tree.merges] == pytest.approx([h for _, h in want])
    for groups in (1, 4, 64):
        cut = tree.cut(groups)
        assert len(set(cut.values())) == groups
    found = {r["gene"]: r["group"] for r in curves.tree_groups(df, 4).collect()}
    assert found == tree.cut(4)


def test_tree_with_equal_and_few_genes(spark):
    rows = [(g, j, v) for g, v in (("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", 5.0), ("e", None)) for j in range(3)]
    df = spark.createDataFrame(rows, "gene string, point int, z double")
    cut = curves.gene_tree(df).cut(3)
    assert cut["a"] == cut["b"] == cut["c"] and len({cut["a"], cut["d"], cut["e"]}) == 3
    assert curves.gene_tree(df.where("gene = 'a'")).cut(2) == {"a": 0}
    assert curves.tree_groups(df.limit(0), 2).collect() == []

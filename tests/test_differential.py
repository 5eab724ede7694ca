import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from guidescape.operators import expression, nested

N = 240
RNG = np.random.default_rng(11)
CELLS = pd.DataFrame(
    {
        "cell_id": np.arange(N),
        "louvain": np.arange(N) % 3,
        "guide": [f"G{g}" for g in RNG.integers(0, 4, N)],
        "pseudotime": RNG.random(N) * 7,
        "branch": np.arange(N) % 2,
    }
)
GENES = {
    "noise": RNG.normal(size=N) + 50,
    "cluster": RNG.normal(size=N) + CELLS["louvain"],
    "wave": RNG.normal(size=N) * 0.3 + np.sin(CELLS["pseudotime"]),
    "split": RNG.normal(size=N) * 0.3 + CELLS["branch"] * CELLS["pseudotime"],
    "flat": np.full(N, 2.5),
}


@pytest.fixture(scope="module")
def data(spark):
    long = pd.concat([CELLS.assign(gene=g, value=np.asarray(v, dtype=float)) for g, v in GENES.items()])
    return spark.createDataFrame(long), spark.createDataFrame(CELLS)


def rss(y, x):
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    return ((y - x @ beta) ** 2).sum()


def dummies(values):
    return pd.get_dummies(values).to_numpy(dtype=float)


def chi2_tail(x, df):
    """Survival function for whole degrees of freedom by recurrence."""
    if df == 1:
        return math.erfc(math.sqrt(x / 2))
    if df == 2:
        return math.exp(-x / 2)
    return chi2_tail(x, df - 2) + (x / 2) ** (df / 2 - 1) * math.exp(-x / 2) / math.gamma(df / 2)


def spline(t):
    """Natural cubic basis by an independent construction: cubic pieces with linear ends, from constraints."""
    s = (t - t.min()) / (t.max() - t.min())
    knots = [0.0, *np.quantile(s, [1 / 3, 2 / 3]), 1.0]
    power = np.stack([s, s**2, s**3, *[np.maximum(s - k, 0) ** 3 for k in knots[1:3]]], axis=1)
    # second derivative is zero at both ends: 2 c2 = 0, and 2 c2 + 6 c3 + 6 Σ d (1 − k) = 0
    constraint = np.array([[0, 2, 0, 0, 0], [0, 2, 6, *[6 * (1 - k) for k in knots[1:3]]]])
    basis = np.linalg.svd(constraint)[2][2:].T
    return power @ basis


def check(result, full, reduced, df):
    got = {r["gene"]: r for r in result.collect()}
    for gene, y in GENES.items():
        y = np.asarray(y, dtype=float)
        if gene == "flat":
            assert (got[gene]["status"], got[gene]["pval"], got[gene]["qval"]) == ("FAIL", 1.0, 1.0)
            continue
        lr = N * math.log(rss(y, reduced) / rss(y, full))
        assert got[gene]["status"] == "OK"
        assert got[gene]["pval"] == pytest.approx(chi2_tail(lr, df), rel=1e-6, abs=1e-250)
    return got


ONE = np.ones((N, 1))


def test_one_factor(data):
    expr, _ = data
    got = check(nested.de_one_factor(expr, "louvain"), dummies(CELLS["louvain"]), ONE, 2)
    assert got["cluster"]["qval"] < 1e-6


def test_additive_factors(data):
    expr, cells = data
    louvain, guide = nested.factor_term(cells, "louvain"), nested.factor_term(cells, "guide")
    full = np.c_[dummies(CELLS["louvain"]), dummies(CELLS["guide"])]
    check(nested.de_nested(expr, cells, [louvain], [guide]), full, dummies(CELLS["louvain"]), 3)


def test_one_factor_agrees_with_the_general_test(data):
    expr, cells = data
    a = {r["gene"]: r["pval"] for r in nested.de_one_factor(expr, "guide").collect()}
    general = nested.de_nested(expr, cells, [], [nested.factor_term(cells, "guide")])
    for r in general.collect():
        assert r["pval"] == pytest.approx(a[r["gene"]], rel=1e-8)


def test_spline_of_pseudotime(data):
    expr, cells = data
    full = np.c_[ONE, spline(CELLS["pseudotime"].to_numpy())]
    got = check(nested.de_pseudotime(expr, cells, cutoff=None), full, ONE, 3)
    kept = {r["gene"] for r in nested.de_pseudotime(expr, cells).collect()}
    assert "wave" in kept and "noise" not in kept and "flat" not in kept
    assert got["wave"]["pval"] < 1e-20


def test_branch_interaction(data):
    expr, cells = data
    b = spline(CELLS["pseudotime"].to_numpy())
    side = CELLS["branch"].to_numpy()[:, None]
    reduced = np.c_[ONE, b]
    result = nested.branch_test(expr, cells)
    check(result, np.c_[reduced, side, b * side], reduced, 4)
    assert result.first()["gene"] == "split"


def test_redundant_factor_fails(data):
    expr, cells = data
    derived = cells.withColumn("copy", F.concat(F.lit("c"), F.col("louvain").cast("string")))
    louvain, copy = nested.factor_term(derived, "louvain"), nested.factor_term(derived, "copy")
    got = nested.de_nested(expr, derived, [louvain], [copy]).collect()
    assert {(r["status"], r["pval"], r["qval"]) for r in got} == {("FAIL", 1.0, 1.0)}


def test_zero_variance_within_groups_fails(spark):
    rows = [(i, i % 2, "g", float(i % 2)) for i in range(10)]
    df = spark.createDataFrame(rows, "cell_id long, louvain int, gene string, value double")
    assert nested.de_one_factor(df, "louvain").first()["status"] == "FAIL"


def test_inverse_gaussian(spark):
    rng = np.random.default_rng(2)
    y = rng.wald(3.0, 5.0, 90)
    rows = [(i, i % 3, "pos", float(v)) for i, v in enumerate(y)]
    rows += [(i, i % 3, "neg", float(v)) for i, v in enumerate(y - 1.0)]
    df = spark.createDataFrame(rows, "cell_id long, louvain int, gene string, value double")
    got = {r["gene"]: r for r in nested.de_one_factor(df, "louvain", "inverse_gaussian").collect()}
    groups = [y[i::3] for i in range(3)]
    d0 = (1 / y).sum() - len(y) / y.mean()
    d1 = sum((1 / g).sum() - len(g) / g.mean() for g in groups)
    assert got["pos"]["pval"] == pytest.approx(chi2_tail(90 * math.log(d0 / d1), 2))
    assert got["neg"]["status"] == "FAIL"


def test_profiles_and_groups(data):
    expr, cells = data
    scaled = cells.withColumn("pseudotime", F.col("pseudotime") / 7.0001)
    profile = nested.pseudotime_profile(expr, scaled, bins=10)
    table = profile.toPandas()
    wave = table[table["gene"] == "wave"]
    assert len(wave) == 10
    assert wave["z"].mean() == pytest.approx(0, abs=1e-9) and wave["z"].std() == pytest.approx(1)
    assert table[table["gene"] == "flat"]["z"].isna().all()
    groups = nested.gene_groups(profile, 2, bins=10).toPandas()
    assert set(groups["gene"]) == set(GENES) and groups["group"].nunique() == 2


def test_sparse_means_divide_by_cells(spark):
    cells = spark.createDataFrame([(1, 0, "A"), (2, 0, "A"), (3, 1, "A")], "cell_id long, louvain int, guide string")
    expr = spark.createDataFrame([(1, 0, "A", "x", 4.0)], "cell_id long, louvain int, guide string, gene string, value double")
    assert expression.guide_mean_expr(expr, cells).first()["value"] == 2.0
    assert expression.guide_mean_expr(expr).first()["value"] == 4.0


def test_gene_lists_need_every_gene(spark):
    expr = spark.createDataFrame(
        [(1, 0, "x", 1.0), (1, 0, "y", 1.0), (2, 0, "x", 1.0), (2, 0, "y", 0.0), (3, 1, "z", 1.0)],
        "cell_id long, louvain int, gene string, value double",
    )
    lists = spark.createDataFrame([(0, "x"), (0, "y"), (0, "y"), (1, "z")], "list_id int, gene string")
    got = sorted((r["list_id"], r["cell_id"]) for r in expression.genelist_cells(expr, lists).collect())
    assert got == [(0, 1), (1, 3)]

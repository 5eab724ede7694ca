import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from guidescape.functions import chi2_upper, hypergeom_tails, normal_upper, student_two_sided
from guidescape.functions.tails import hypergeom_tail_values
from guidescape.operators import correlation, enrichment, ranking
from guidescape.sources import sample_cells, sample_fraction


def exact_tails(q, m, n, k):
    low, high, whole = max(0, k - n), min(m, k), math.comb(m + n, k)
    mass = [math.comb(m, i) * math.comb(n, k - i) for i in range(low, high + 1)]
    up = sum(v for i, v in enumerate(mass, low) if i >= q)
    down = sum(v for i, v in enumerate(mass, low) if i <= q)
    return float(Fraction(up, whole)), float(Fraction(down, whole))


CASES = [
    (9, 100, 900, 60),
    (0, 100, 900, 60),
    (50, 3000, 12000, 90),
    (20, 3000, 12000, 90),
    (5, 5, 20, 5),
    (7, 10, 3, 8),
    (3, 4, 0, 3),
    (400, 30000, 120000, 1845),
    (300, 30000, 120000, 1845),
]


def test_hypergeometric_against_whole_numbers(spark):
    df = spark.createDataFrame([*CASES, (5, 3, 4, 8)], "q long, m long, n long, k long")
    tails = hypergeom_tails(F.col("q"), F.col("m"), F.col("n"), F.col("k"))
    got = df.select("*", tails.alias("t")).collect()
    for r in got:
        if r["k"] > r["m"] + r["n"]:
            assert r["t"]["upper"] is None and r["t"]["lower"] is None
            continue
        up, down = exact_tails(r["q"], r["m"], r["n"], r["k"])
        assert r["t"]["upper"] == pytest.approx(up, rel=1e-11)
        assert r["t"]["lower"] == pytest.approx(down, rel=1e-11)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 60), st.integers(0, 60), st.integers(0, 120), st.integers(0, 70))
def test_tails_overlap_in_one_mass(m, n, k, q):
    if m + n == 0 or k > m + n:
        return
    up, down = (v[0] for v in hypergeom_tail_values([q], [m], [n], [k]))
    expected = exact_tails(q, m, n, k)
    assert up == pytest.approx(expected[0], abs=1e-12)
    assert down == pytest.approx(expected[1], abs=1e-12)


def test_large_totals_stay_accurate():
    q, m, n, k = 252_000, 250_000_000, 750_000_000, 1_000_000
    up, down = (v[0] for v in hypergeom_tail_values([q], [m], [n], [k]))

    def log_choose(n, k):
        i = np.arange(k, dtype=float)
        return math.fsum(np.log(n - i) - np.log(i + 1))

    mass = math.exp(log_choose(m, q) + log_choose(n, k - q) - log_choose(m + n, k))
    expected, term, x = 0.0, mass, q
    while term > expected * 1e-17:
        expected += term
        term *= (m - x) * (k - x) / ((x + 1) * (n - k + x + 1))
        x += 1
    assert up == pytest.approx(expected, rel=1e-8)
    assert up + down == pytest.approx(1.0 + mass, abs=1e-12)


def test_other_tails(spark):
    df = spark.createDataFrame([(3.0, 4.0), (None, 4.0), (0.0, 4.0)], "x double, d double")
    got = df.select(
        chi2_upper(F.col("x"), F.col("d")), normal_upper(F.col("x")), student_two_sided(F.col("x"), F.col("d"))
    ).collect()
    assert got[0][0] == pytest.approx(math.exp(-1.5) * 2.5)
    assert got[0][1] == pytest.approx(0.5 * math.erfc(3 / math.sqrt(2)))
    assert got[0][2] == pytest.approx(0.039941968)
    assert tuple(got[1]) == (None, None, None)
    assert tuple(got[2]) == (1.0, pytest.approx(0.5), pytest.approx(1.0))


def by_hand(ps):
    kept = [p for p in ps if p is not None]
    order = sorted(range(len(kept)), key=lambda i: kept[i])
    out, best = [None] * len(kept), 1.0
    for rank in range(len(order), 0, -1):
        best = min(best, kept[order[rank - 1]] * len(kept) / rank)
        out[order[rank - 1]] = best
    it = iter(out)
    return [None if p is None else next(it) for p in ps]


@pytest.mark.parametrize(
    "ps",
    [
        [0.01, 0.04, 0.03, 0.005],
        [0.2],
        [0.5, 0.5, 0.5, 1.0, 1.0, 0.001, None],
        [0.0, 0.0, 1e-300, 1e-200, 0.9],
        list(np.round(np.random.default_rng(1).random(400) ** 3, 3)),
    ],
)
def test_bh_against_hand_calculation(spark, ps):
    data = [(i, g, None if p is None else float(p)) for g in ("a", "b") for i, p in enumerate(ps)]
    df = spark.createDataFrame(data, "i int, g string, p double").repartition(7)
    got = {(r["g"], r["i"]): (r["p"], r["qval"]) for r in enrichment.bh_adjust(df, "p", ["g"]).collect()}
    for g in ("a", "b"):
        for i, expected in enumerate(by_hand([None if p is None else float(p) for p in ps])):
            p, q = got[(g, i)]
            if expected is None:
                assert q is None
            else:
                assert q == pytest.approx(expected, rel=1e-12)
                assert q >= p
    assert len(got) == len(data)


def test_weights_stand_for_repeated_rows(spark):
    single = spark.createDataFrame([(0.01, 2), (0.2, 3), (0.9, 1)], "p double, w int")
    many = spark.createDataFrame([(0.01,), (0.01,), (0.2,), (0.2,), (0.2,), (0.9,)], "p double")
    a = {r["p"]: r["qval"] for r in enrichment.bh_adjust(single, "p", weight="w").collect()}
    b = {r["p"]: r["qval"] for r in enrichment.bh_adjust(many, "p").collect()}
    assert a == b


def test_enrichment_of_a_planted_pair(spark):
    cells = [(i, 0 if i < 40 else 1, "A" if i < 30 or 90 < i < 95 else "0") for i in range(100)]
    df = spark.createDataFrame(cells, "cell_id long, louvain int, guide string")
    pairs = spark.createDataFrame([("A", "x"), ("B", "y")], "guide string, gene string")
    got = {r["louvain"]: r for r in enrichment.hypergeom_test(df, pairs).collect()}
    assert set(got) == {0, 1}
    up, down = exact_tails(30, 40, 60, 34)
    assert got[0]["p_value_enrich"] == pytest.approx(up)
    assert got[0]["p_value_deplete"] == pytest.approx(down)
    assert got[0]["p_adj_enrich"] == pytest.approx(up)
    assert got[1]["p_value_deplete"] < 1e-9


def test_qq_points_spread_long_ties(spark):
    n = 9001
    df = spark.createDataFrame(pd.DataFrame({"p": [1.0] * (n - 1) + [0.5]}))
    got = enrichment.qq_points(df, "p").toPandas().sort_values("rank")
    assert list(got["rank"]) == list(range(1, n + 1))
    assert got["observed"].iloc[0] == pytest.approx(-math.log10(0.5))
    assert got["expected"].iloc[-1] == pytest.approx(-math.log10((n - 0.5) / n))


def test_small_qq_uses_the_other_offset(spark):
    got = enrichment.qq_points(spark.createDataFrame([(0.1,), (0.9,)], "p double"), "p").collect()
    assert sorted(r["expected"] for r in got) == pytest.approx([-math.log10((2 - 0.375) / 2.25), -math.log10(0.625 / 2.25)])


def test_quantiles_are_exact(spark):
    values = np.random.default_rng(3).normal(size=997).round(2)
    df = spark.createDataFrame(pd.DataFrame({"x": values}))
    probs = [0.0, 0.1, 1 / 3, 0.5, 2 / 3, 1.0]
    assert ranking.exact_quantiles(df, "x", probs) == pytest.approx(np.quantile(values, probs))


@pytest.mark.parametrize("n", [0, 1, 137, 999, 1000, 5000])
def test_sample_size_is_exact_and_repeatable(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "cell_id")
    one = {r[0] for r in sample_cells(df, n, seed=7).collect()}
    two = {r[0] for r in sample_cells(df.repartition(13), n, seed=7).collect()}
    assert one == two and len(one) == min(n, 1000)


def test_fraction_sample(spark):
    df = spark.range(20000).withColumnRenamed("id", "cell_id")
    assert sample_fraction(df, 1.0).count() == 20000
    assert 800 < sample_fraction(df, 0.05).count() < 1200


def matrix_long(spark, matrix, prefix):
    data = [(i, f"{prefix}{j}", float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)]
    return spark.createDataFrame(data, "row long, col string, value double")


def test_block_products_match_dense_algebra(spark, monkeypatch):
    monkeypatch.setattr(correlation, "ROW_CHUNK", 7)
    monkeypatch.setattr(correlation, "COLUMN_BLOCK", 3)
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(40, 8)), rng.normal(size=(40, 5)) + 100
    long_a, long_b = matrix_long(spark, a, "a"), matrix_long(spark, b, "b")
    got = correlation.cross_corr(long_a, long_b).toPandas().pivot(index="col_a", columns="col_b", values="r")
    expected = np.corrcoef(a, b, rowvar=False)[:8, 8:]
    assert np.allclose(got.to_numpy(), expected)
    values = correlation.singular_values(correlation.cross_corr(long_a, long_b), 5).toPandas()["singular_value"]
    assert np.allclose(values, np.linalg.svd(expected, compute_uv=False), atol=1e-6)
    canonical = correlation.canonical_correlation(long_a, long_b).toPandas()["correlation"]
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    assert np.allclose(canonical, np.linalg.svd(qa.T @ qb, compute_uv=False), atol=1e-8)
    table = correlation.canonical_coefficients(long_a, long_b).toPandas()
    x, y = (
        table[table["side"] == side].pivot(index="col", columns="component", values="coefficient").to_numpy() for side in "ab"
    )
    left, right = a @ x, b @ y
    assert np.allclose(left.T @ left, np.eye(5), atol=1e-8) and np.allclose(right.T @ right, np.eye(5), atol=1e-8)
    assert np.allclose(left.T @ right, np.diag(canonical), atol=1e-8)


def test_correlation_p_values(spark):
    corr = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 1.0)], "col_a string, col_b string, r double")
    got = {r["col_b"]: r for r in correlation.corr_pvalues(corr, 12).collect()}
    assert got["b"]["t"] == pytest.approx(0.5 * math.sqrt(10 / 0.75))
    assert got["b"]["p_value"] == pytest.approx(0.0978546, rel=1e-5)
    assert got["c"]["p_value"] == 0.0


def test_histogram_keeps_every_value(spark):
    df = spark.createDataFrame([("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 2.0), ("b", 2.0)], "g string, p double")
    got = {(r["g"], r["bin"]): r["n"] for r in enrichment.facet_histogram(df, "p", ["g"], 10).collect()}
    assert got == {("a", 1): 1, ("a", 6): 1, ("a", 10): 1, ("b", 1): 2}

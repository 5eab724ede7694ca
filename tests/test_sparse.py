"""Every operator that accepts a matrix without its zeros gives what it gives on the full one."""

import numpy as np
import pandas as pd
import pytest

from guidescape.operators import expression, nested
from guidescape.operators.sparse import CellMatrix

N, GENES = 90, 12


@pytest.fixture(scope="module")
def both(spark):
    rng = np.random.default_rng(6)
    x = np.where(rng.random((N, GENES)) < 0.3, rng.random((N, GENES)) * 4 + 0.5, 0.0)
    x[:, 0] = 0.0  # a gene that no cell expresses
    x[np.arange(N) % 3 != 1, 1] = 0.0  # expressed in one cluster only
    x[:, 2] += 1.0  # no zeros at all
    cells = pd.DataFrame(
        {
            "cell_id": np.arange(N),
            "louvain": np.arange(N) % 3,
            "guide": [f"G{i % 4}" for i in range(N)],
            "pseudotime": rng.random(N),
            "branch": np.arange(N) % 2,
        }
    )
    dense = pd.concat([cells.assign(gene=f"g{j}", value=x[:, j]) for j in range(GENES)])
    genes = spark.createDataFrame([(j, f"g{j}") for j in range(GENES)], "pos int, gene string")
    full, listed = spark.createDataFrame(dense), spark.createDataFrame(cells)
    matrix = CellMatrix.from_long(full.select("cell_id", "gene", "value"), listed, genes)
    return full, matrix.long(), listed, genes, matrix, x


def same(a, b, keys):
    a, b = (df.toPandas().sort_values(keys).reset_index(drop=True) for df in (a, b))
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)], check_dtype=False, rtol=1e-9, atol=1e-12)


def test_layout(spark, both):
    full, long, cells, genes, matrix, x = both
    assert long.count() == (x != 0).sum() and long.where("value = 0").count() == 0
    for r in matrix.rows.collect():
        assert r["indices"] == np.flatnonzero(x[r["cell_id"]]).tolist()
        assert r["values"] == x[r["cell_id"]][x[r["cell_id"]] != 0].tolist()
    totals = {r["cell_id"]: r["total"] for r in matrix.cell_totals().collect()}
    assert [totals[i] for i in range(N)] == pytest.approx(x.sum(axis=1))
    assert matrix.cells.columns == cells.columns
    wide = spark.createDataFrame([(1, [0.0, 2.0, None]), (2, [0.0, 0.0, 0.0])], "cell_id long, values array<double>")
    rows = CellMatrix.from_dense(wide, genes).rows.orderBy("cell_id").collect()
    assert [(r["indices"], r["values"]) for r in rows] == [([1], [2.0]), ([], [])]


def test_grand_mean_counts_zeros(spark, both):
    full, long, cells, genes, *_ = both
    same(expression.grand_mean(full), expression.grand_mean(long, cells, genes), ["avg_tot"])
    four = spark.range(4).withColumnRenamed("id", "cell_id")
    two = spark.createDataFrame([("a",), ("b",)], "gene string")
    one = spark.createDataFrame([(1, "a", 1.0)], "cell_id long, gene string, value double")
    assert expression.grand_mean(one, four, two).first()["avg_tot"] == 0.125


def test_detection(both):
    full, long, cells, genes, *_ = both
    detected = expression.genes_detected(long, genes=genes)
    same(expression.genes_detected(full), detected, ["gene"])
    same(expression.cells_detected(full), expression.cells_detected(long, cells=cells), ["cell_id"])
    same(
        expression.gene_detection_summary(expression.genes_detected(full)),
        expression.gene_detection_summary(detected),
        ["min"],
    )
    with pytest.raises(ValueError):
        expression.genes_detected(long, limit=-1.0, genes=genes)


def test_dispersion(both):
    full, long, cells, genes, *_ = both
    factors = expression.size_factors(full)
    same(factors, expression.size_factors(long), ["cell_id"])
    same(expression.dispersion_table(full, factors), expression.dispersion_table(long, factors, genes), ["gene"])


@pytest.mark.parametrize("family", ["gaussian", "inverse_gaussian"])
@pytest.mark.parametrize("factor", ["louvain", "guide"])
def test_one_factor(both, factor, family):
    full, long, cells, genes, *_ = both
    sparse = nested.de_one_factor(long, factor, family, cells=cells, genes=genes)
    same(nested.de_one_factor(full, factor, family), sparse, ["gene"])


def test_nested_models_and_profiles(both):
    full, long, cells, genes, *_ = both
    louvain, guide = nested.factor_term(cells, "louvain"), nested.factor_term(cells, "guide")
    a, b = (nested.de_nested(m, cells, [louvain], [guide], genes=genes) for m in (full, long))
    same(a, b, ["gene"])
    a, b = (nested.de_nested(m, cells, [louvain], [], absorbed="guide", absorbed_in="full", genes=genes) for m in (full, long))
    same(a, b, ["gene"])
    a, b = (nested.de_pseudotime(m, cells, cutoff=None, genes=genes) for m in (full, long))
    same(a, b, ["gene"])
    a, b = (nested.branch_test(m, cells, genes=genes) for m in (full, long))
    same(a, b, ["gene"])
    a, b = (nested.pseudotime_profile(m, cells, bins=8, by=["branch"], genes=genes) for m in (full, long))
    same(a, b, ["gene", "branch", "bin"])

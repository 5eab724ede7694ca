"""Components without a gene × gene matrix against dense algebra."""

import numpy as np
import pandas as pd
import pytest

from guidescape.operators import components
from guidescape.operators.sparse import CellMatrix


def dense(x, k):
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    return (s**2 / (len(x) - 1))[:k], vt[:k].T, (s**2).sum() / (len(x) - 1)


def test_equal_to_dense_components_up_to_sign(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 150)) @ np.diag(1.05 ** -np.arange(150.0)) + 5
    df = spark.createDataFrame(pd.DataFrame({"cell_id": range(300), "values": x.tolist()})).repartition(5)
    values, vectors, everything = dense(x, 20)
    found = components.principal_components(df, 20)
    assert found.variances == pytest.approx(values, rel=1e-8)
    assert found.everything == pytest.approx(everything, rel=1e-10)
    assert np.abs((found.vectors * vectors).sum(axis=0)) == pytest.approx(np.ones(20), abs=1e-6)
    placed = components.pca_embedding(df, 20).toPandas().sort_values("cell_id")
    assert np.abs(np.stack(placed["values"])) == pytest.approx(np.abs((x - x.mean(axis=0)) @ vectors), abs=1e-5)


def test_a_block_as_wide_as_the_matrix_takes_one_product():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(40, 40))
    a = a @ a.T
    calls = []
    values, vectors = components.leading_eigenvectors(lambda b: calls.append(1) or a @ b, 40, 5)
    assert len(calls) == 1
    assert values == pytest.approx(np.sort(np.linalg.eigvalsh(a))[::-1][:5])
    assert np.allclose(a @ vectors, vectors * values)


def test_restarts_keep_what_was_found():
    rng = np.random.default_rng(3)
    d = 2_000
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    spectrum = 1.0 / np.sqrt(1 + np.arange(d))
    a = (q * spectrum) @ q.T
    widest = []
    values, _ = components.leading_eigenvectors(lambda b: widest.append(b.shape[1]) or a @ b, d, 30)
    assert values == pytest.approx(spectrum[:30], rel=1e-8)
    assert max(widest) <= components.BLOCK


def test_fifty_thousand_sparse_columns(spark):
    """d × d would be 20 GB; nothing wider than the basis is held."""
    rng = np.random.default_rng(4)
    n, d = 240, 50_000
    rows, x = [], np.zeros((n, d))
    for i in range(n):
        at = np.sort(rng.choice(d, 400, replace=False))
        at = np.union1d(at, np.arange(i % 4 * 300, i % 4 * 300 + 200))
        v = rng.random(len(at)) + (at < 1_200) * 3
        x[i, at] = v
        rows.append((i, at.astype("int32").tolist(), v.tolist()))
    df = spark.createDataFrame(rows, "cell_id long, indices array<int>, values array<double>").repartition(6)
    values, vectors, everything = dense(x, 6)
    found = components.principal_components(df, 6, width=d)
    assert found.variances == pytest.approx(values, rel=1e-7)
    assert found.vectors.shape == (d, 6) and found.everything == pytest.approx(everything, rel=1e-9)
    shares = components.pc_variance(df, 3, width=d).toPandas()["explained"]
    assert shares.to_numpy() == pytest.approx(values[:3] / everything, rel=1e-7)


def test_sparse_and_dense_rows_agree(spark):
    rng = np.random.default_rng(5)
    x = np.where(rng.random((80, 30)) < 0.2, rng.normal(size=(80, 30)), 0.0)
    x[3] = 0.0
    df = spark.createDataFrame(pd.DataFrame({"cell_id": range(80), "values": x.tolist()}))
    genes = spark.createDataFrame([(i, f"g{i}") for i in range(30)], "pos int, gene string")
    sparse = CellMatrix.from_dense(df, genes).rows
    a = components.pca_embedding(df, 4).toPandas().sort_values("cell_id")
    b = components.pca_embedding(sparse, 4, width=30).toPandas().sort_values("cell_id")
    assert np.stack(a["values"]) == pytest.approx(np.stack(b["values"]), abs=1e-8)


def test_degenerate_matrices(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "cell_id long, values array<double>")
    assert components.principal_components(same, 2).variances == pytest.approx([0, 0])
    empty = same.limit(0)
    assert components.pca_embedding(empty, 2).collect() == []
    one = same.limit(1)
    assert np.allclose(components.pca_embedding(one, 2).first()["values"], 0)
